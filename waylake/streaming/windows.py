"""Event-time windows and trailing state (R5, R7); each function takes a batch or a streaming table."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from waylake.functions.storage import fresh_path


def tumbling(events: DataFrame, size: str, by: list[str]) -> DataFrame:
    """Events per window and group."""
    return _counts(events, F.window("ts", size), by)


def sliding(events: DataFrame, size: str, every: str, by: list[str]) -> DataFrame:
    return _counts(events, F.window("ts", size, every), by)


def sessions(events: DataFrame, gap: str, by: list[str]) -> DataFrame:
    """Events per session: a session ends after a gap without events of the group."""
    return _counts(events, F.session_window("ts", gap), by)


def instants(events: DataFrame) -> DataFrame:
    """Event times as timestamps; times without a zone are taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _counts(events: DataFrame, window, by: list[str]) -> DataFrame:
    g = events.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def trailing(events: DataFrame, seconds: int, by: list[str]) -> DataFrame:
    """For every event, count, sum and average over the group's last seconds, the cutoff included."""
    micros = F.unix_micros("ts")
    w = W.partitionBy(*by).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumns({"n": F.count("*").over(w), "total": F.sum("value").over(w), "mean": F.avg("value").over(w)})


def trailing_stream(events: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """The same over a stream, per key: each group's values younger than the watermark less ``seconds`` are
    kept as state. Events later than the watermark are dropped; others count from their own time on.

    events: key string, ts timestamp, value double. Returns key, ts, n, total, mean.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (old_ts, old_v) = state.get if state.exists else ([], [])
        new = pd.concat(list(batches)).sort_values("ts")
        new_ts = (new["ts"].astype("datetime64[us]").astype("int64")).tolist()
        held = [*zip(old_ts, old_v), *zip(new_ts, new["value"].tolist())]
        held.sort()
        out = []
        times, span = [u for u, _ in held], seconds * 1_000_000
        for t in new_ts:
            inside = [v for _, v in held[bisect_left(times, t - span) : bisect_right(times, t)]]
            out.append((key[0], pd.Timestamp(t, unit="us"), len(inside), sum(inside), sum(inside) / len(inside)))
        # an event as old as the watermark may still come and looks back from its own time
        cutoff = min(times[-1], state.getCurrentWatermarkMs() * 1000) - span
        kept = [(u, v) for u, v in held if u >= cutoff]
        state.update(([u for u, _ in kept], [v for _, v in kept]))
        yield pd.DataFrame(out, columns=["key", "ts", "n", "total", "mean"])

    return (
        events.withWatermark("ts", late)
        .groupBy("key")
        .applyInPandasWithState(step, "key string, ts timestamp, n long, total double, mean double", "ts array<long>, v array<double>", "append", "NoTimeout")
    )


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is available now and return its rows; a repeated batch replaces itself."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, "stream"), fresh_path(spark, "stream-state")

    def write(batch: DataFrame, number: int) -> None:
        # in complete mode each batch holds the whole result
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")


def file_stream(spark, path: str, schema, per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder (or of a pattern) as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
