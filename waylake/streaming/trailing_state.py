"""Trailing sums over a stream with keyed state and timers.

A key's state is one partial sum per bucket of time and one running sum, so it is bounded by the window and the lateness
whatever the rate of events. Every bucket has two timers on event time: once the watermark has passed its end, its events
are complete, it joins the running sum and a row comes out; once no later bucket looks back on it, it leaves the running sum
and the state. Timers fire in order of time, and each touches one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SUMS = StructType([StructField("n", LongType()), StructField("total", LongType())])
_BUCKET = StructType([StructField("start", LongType())])


class TrailingSums(StatefulProcessor):
    """Rows of (start, n, total) in; per bucket the sums over it and the window before it out."""

    def __init__(self, key: str, window_ms: int, grain_ms: int):
        self.key, self.window, self.grain = key, window_ms, grain_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", _BUCKET, _SUMS)
        self.running = handle.getValueState("running", _SUMS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for start, found in batch.groupby("start")[["n", "total"]].sum().iterrows():
                at, n, total = (int(start),), int(found["n"]), int(found["total"])
                if self.buckets.containsKey(at):
                    old = self.buckets.getValue(at)
                    n, total = n + old[0], total + old[1]
                else:
                    self.handle.registerTimer(at[0] + self.grain)
                    self.handle.registerTimer(at[0] + self.window + 2 * self.grain)
                self.buckets.updateValue(at, (n, total))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        n, total = self.running.get() if self.running.exists() else (0, 0)
        old, due = (now - self.window - 2 * self.grain,), (now - self.grain,)
        if self.buckets.containsKey(old):
            gone = self.buckets.getValue(old)
            n, total = n - gone[0], total - gone[1]
            self.buckets.removeKey(old)
        out = []
        if self.buckets.containsKey(due):
            own = self.buckets.getValue(due)
            n, total = n + own[0], total + own[1]
            out.append((key[0], due[0], own[0], n, total))
        if n:
            self.running.update((n, total))
        else:
            self.running.clear()
        if out:
            yield pd.DataFrame(out, columns=[self.key, "start_ms", "own", "n", "total"])


def trailing_sums(events: DataFrame, seconds: int, grain_ms: int = 1000, late: str = "1 hour", key: str = "key") -> DataFrame:
    """For every key and bucket of ``grain_ms`` with events, count and sum over it and the ``seconds`` before it.

    events: a stream of key, ts timestamp, value long (say cents: whole numbers keep running sums exact). A row comes once
    the watermark, ``late`` behind the newest event, has passed its bucket; later events are dropped. Returns key,
    start_ms, own (events of the bucket), n, total. Sets the session's state store to RocksDB, which
    timers need.
    """
    window = seconds * 1000
    if window % grain_ms:
        raise ValueError("the window must hold whole buckets")
    events.sparkSession.conf.set(PROVIDER, ROCKS)
    start = F.floor(F.unix_millis("ts") / grain_ms) * grain_ms
    slim = events.withWatermark("ts", late).select(key, "ts", start.alias("start"), F.lit(1).cast("long").alias("n"), F.col("value").cast("long").alias("total"))
    kind = events.schema[key].dataType.simpleString()
    return slim.groupBy(key).transformWithStateInPandas(
        TrailingSums(key, window, grain_ms), f"{key} {kind}, start_ms long, own long, n long, total long", "Append", "EventTime"
    )
