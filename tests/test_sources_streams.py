"""Services that break off or don't count, and keyed state with timers."""

import io
import random

import pytest
from pyspark.sql import functions as F

from waylake.sources import config, readers
from waylake.streaming import trailing_state, windows


class Response(io.BytesIO):
    def __init__(self, data, breaks_at=None):
        super().__init__(data)
        self.breaks_at = breaks_at

    def read(self, n=-1):
        if self.breaks_at is not None:
            if self.tell() >= self.breaks_at:
                raise ConnectionResetError("lost")
            n = self.breaks_at - self.tell()
        return super().read(n)


def test_lines_of_a_broken_try_are_not_given_out():
    tries = [Response(b"a\nb\nc\n", breaks_at=4), Response(b"a\nb\nc\n")]
    assert list(config.http_get("http://example.invalid/", {}, wait=0, open_url=lambda _: tries.pop(0))) == ["a", "b", "c"]
    tries = [Response(b"a\nb", breaks_at=2) for _ in range(3)]
    with pytest.raises(ConnectionResetError):
        list(config.http_get("http://example.invalid/", {}, tries=2, wait=0, open_url=lambda _: tries.pop(0)))


@pytest.mark.parametrize("n", [0, 3, 10, 25, 40, 73])
def test_pages_without_a_count(spark, n):
    rows = [(i, f"r{i}") for i in range(n)]
    name = f"uncounted_{n}"
    spark.dataSource.register(readers.paged_source(name, "id int, name string", lambda at, size: rows[at : at + size], size=10, wait=0.0))
    df = spark.read.format(name).load()
    assert sorted(map(tuple, df.collect())) == rows
    assert df.rdd.getNumPartitions() == n // 10 + 1


def test_a_service_with_smaller_pages(spark):
    rows = [(i,) for i in range(35)]
    spark.dataSource.register(readers.paged_source("small_pages", "id int", lambda at, size: rows[at : at + min(size, 4)], size=10, wait=0.0))
    assert spark.read.format("small_pages").load().count() == 35


def test_a_lost_page_is_an_error(spark):
    rows = [(i,) for i in range(95)]

    def fetch(at, size):
        return rows[at : at + size - (1 if at == 50 else 0)]  # one row of a page in the middle is missing

    spark.dataSource.register(readers.paged_source("lossy", "id int", fetch, size=10, wait=0.0))
    with pytest.raises(Exception, match="page 5 has 9 of 10 rows"):
        spark.read.format("lossy").load().collect()


def test_trailing_sums_of_shuffled_late_events(spark, tmp_path):
    """Equal to the batch window over the same events, whatever their order within the allowed lateness."""
    random.seed(4)
    events = [(random.choice("ab"), 1_700_000_000 + i // 2 + random.randint(0, 3), random.randint(-50, 50)) for i in range(300)]
    order = sorted(events, key=lambda e: e[1] + random.uniform(-20, 20))
    flush = [(k, 1_700_010_000, 0) for k in "ab"]
    schema = "key string, s long, value long"
    folder = str(tmp_path / "in")
    for k, part in enumerate([order[:100], order[100:200], order[200:], flush]):
        spark.createDataFrame(part, schema).select("key", F.timestamp_seconds("s").alias("ts"), "value").coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    stream = windows.file_stream(spark, f"{folder}/*", spark.read.parquet(f"{folder}/0").schema)
    out = windows.run_available(trailing_state.trailing_sums(stream, 30, late="60 seconds"))
    got = {(r["key"], r["start_ms"] // 1000): (r["own"], r["n"], r["total"]) for r in out.collect()}
    batch = windows.trailing(spark.createDataFrame(events, schema).withColumn("ts", F.timestamp_seconds("s")), 30, ["key"])
    want = {}
    for r in batch.collect():
        want.setdefault((r["key"], r["s"]), [0, r["n"], r["total"]])[0] += 1
    assert got == {k: tuple(v) for k, v in want.items()} and len(got) == out.count()
    with pytest.raises(ValueError):
        trailing_state.trailing_sums(stream, 30, grain_ms=7000)
