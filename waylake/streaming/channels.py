"""Messages by channel, and counters and gauges over them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from waylake.functions.storage import fresh_path

MESSAGE = "channel string, message string"


def publish(messages: DataFrame, path: str) -> None:
    """Add (channel, message) rows to the messages of a folder (R2)."""
    messages.select("channel", "message").write.mode("append").parquet(path)


def on_channels(channels: list[str]) -> Column:
    """Whether a message's channel is one of these; * and ? stand for any letters and for one."""
    if not channels:
        return F.lit(False)
    exact = [c for c in channels if not re.search(r"[*?]", c)]
    wild = [re.escape(c).replace(r"\*", ".*").replace(r"\?", ".") for c in channels if re.search(r"[*?]", c)]
    chosen = F.col("channel").isin(*exact) if exact else F.lit(False)
    return chosen | F.col("channel").rlike(f"(?s)^(?:{'|'.join(wild)})$") if wild else chosen


def subscribe(
    stream: DataFrame,
    channels: list[str],
    handle: Callable[[DataFrame, int], None],
    failed: Callable[[Exception], None] | None = None,
    once: bool = False,
) -> Callable[[], None]:
    """Give each batch of messages on the channels to ``handle``; calling the result stops it.

    An error goes to ``failed``, after which the stream goes on, and ends the stream where there is none. With ``once`` the
    stream ends after what is there now, and stopping waits for that.
    """

    def each(batch: DataFrame, number: int) -> None:
        try:
            handle(batch, number)
        except Exception as error:
            if failed is None:
                raise
            failed(error)

    writer = stream.where(on_channels(channels)).writeStream.foreachBatch(each)
    writer = writer.option("checkpointLocation", fresh_path(stream.sparkSession, "subscription"))
    query = (writer.trigger(availableNow=True) if once else writer).start()

    def stop() -> None:
        if once:
            query.awaitTermination()
        query.stop()

    return stop


def metrics(events: DataFrame, by: list[str], value: str, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """(by, n, counter, gauge): how many events, the sum of their increments and the last value, for tables and streams.

    ``tie`` orders events of one time. Negative increments count as none, as a counter never falls; the gauge takes them.
    """
    last = F.max_by(value, F.struct(*[c for c in (ts, tie) if c]))
    return events.groupBy(*by).agg(F.count(value).alias("n"), F.sum(F.greatest(F.col(value), F.lit(0))).alias("counter"), last.alias("gauge"))
