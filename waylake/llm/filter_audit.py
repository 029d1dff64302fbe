"""Operator 13: how filters of documents interact, by a packed bitmap index.

Five filters are judged once per document. Every task packs its documents' verdicts into NumPy bitsets: one per filter,
one per label and one per part (here a source). For each set of filters that may come before a filter, AND-NOT of the
bitsets and a popcount give what the filter then removes, keeps and finds removed already. The tasks' counts add up by
(part, set, filter): 80 rows a part, from which all 120 orders of five steps follow.

Filters (words are runs of characters other than ASCII white space, letter case matters):

    A  under 50 words
    B  fewer than 65 distinct words in 100
    C  more than 5 characters A-Z in 100
    D  a character of #$%&*|
    E  equal to the text of a smaller doc_id, whether that one was removed or not

Cases: null text counts as empty; texts are read whole; a text without words fails A alone, of the first four; a null
doc_id has no smaller one and is never the smaller one; rows that repeat a doc_id and its text are no copies of each
other; a document with several labels is good (or toxic) if one of them says so; a null part is the empty string; an
empty table gives an empty result; other columns are ignored. A text that a third of all documents share meets its first
id by broadcast (fewer than a thousand texts are that frequent), as does a doc_id.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from waylake.llm.common import join_uneven, materialise

FILTERS = "ABCDE"
MARKS = re.compile(rb"[#$%&*|]")
UPPER = bytes(range(ord("A"), ord("Z") + 1))
COUNTS = ["documents", "removed", "redundant", "good_lost", "toxic_lost", "others_pass"]
#: Documents packed at once, and parts whose counts a task holds before it hands them on.
BLOCK, MOST_PARTS = 1 << 16, 4096


def own_failures(data: bytes) -> int:
    """Bits 0 to 3: the text in UTF-8 fails filter A, B, C, D."""
    words = data.split()  # ASCII white space, as the filters have it
    few, same = len(words) < 50, 100 * len(set(words)) < 65 * len(words)
    loud = 100 * (len(data) - len(data.translate(None, UPPER))) > 5 * len(data.decode())
    return few | same << 1 | loud << 2 | (MARKS.search(data) is not None) << 3


def judged(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, fails, key) for every row, written once; key names the text."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fails, keys = [], []
            for value in b.column("text"):  # one text at a time
                data = value.as_buffer().to_pybytes()
                fails.append(own_failures(data))
                keys.append(hashlib.blake2b(data, digest_size=20).digest())
            columns = [b.column("doc_id"), b.column("part"), pa.array(fails, pa.int32()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "fails", "key"])

    return materialise(slim.mapInArrow(run, "doc_id long, part string, fails int, key binary"), "audit")


def with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` with bit 4 of ``fails`` where a smaller doc_id has the same text."""
    firsts = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    firsts = materialise(firsts.where("first < last").select("key", "first", "n"), "audit-copies")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return join_uneven(rows, firsts, "key", "n").select("doc_id", "part", F.col("fails").bitwiseOR(copy * 16).alias("fails"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic)."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = marks.where("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    often = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    marks = marks.join(often, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    met = join_uneven(rows, materialise(marks, "audit-labels"), "doc_id", "n")
    return met.select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _pairs() -> list[tuple[int, int]]:
    """(set of filters before, filter): every filter with every set of the others."""
    return [(s, f) for s in range(32) for f in range(5) if not s >> f & 1]


def popcounts(fails: np.ndarray, good: np.ndarray, toxic: np.ndarray, part: np.ndarray, n_parts: int) -> np.ndarray:
    """Counts by part (rows), pair of _pairs() and COUNTS, of documents in the order of their part."""
    pack = lambda bits: np.packbits(bits, axis=-1)
    ones = lambda sets: np.bitwise_count(sets).sum(axis=-1, dtype=np.int64)
    out = np.zeros((n_parts, len(_pairs()), len(COUNTS)), np.int64)
    starts = np.searchsorted(part, np.arange(n_parts + 1))
    for p in range(n_parts):  # a part's bitset covers its own stretch of the documents only
        at = slice(starts[p], starts[p + 1])
        member = pack(np.ones(starts[p + 1] - starts[p], bool))
        failed = [pack((fails[at] >> f & 1).astype(bool)) for f in range(5)]
        is_good, is_toxic = pack(good[at]), pack(toxic[at])
        gone = [np.zeros_like(member)]  # by set of filters
        for s in range(1, 32):
            low = (s & -s).bit_length() - 1
            gone.append(gone[s & (s - 1)] | failed[low])
        for k, (s, f) in enumerate(_pairs()):
            removed = member & failed[f] & ~gone[s]
            out[p, k] = [ones(member), ones(removed), ones(member & failed[f] & gone[s]), ones(removed & is_good), ones(removed & is_toxic), ones(member & ~(gone[s] | failed[f]))]
    return out


def prefix_counts(rows: DataFrame) -> DataFrame:
    """(part, before, filter, COUNTS...): sums over all tasks. ``before`` is a set of filters as bits."""
    pairs = _pairs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                codes = b.column("part").dictionary_encode()
                names = codes.dictionary.to_pylist()
                part = codes.indices.to_numpy()
                order = np.argsort(part, kind="stable")
                column = lambda c: b.column(c).to_numpy(zero_copy_only=False)[order]  # noqa: B023, E731
                found = popcounts(column("fails"), column("good"), column("toxic"), part[order], len(names))
                for name, counts in zip(names, found):
                    held[name] = held[name] + counts if name in held else counts
                if len(held) > MOST_PARTS:
                    yield _as_rows(held, pairs)
                    held = {}
        if held:
            yield _as_rows(held, pairs)

    schema = "part string, before int, filter int, " + ", ".join(f"{c} long" for c in COUNTS)
    partial = rows.mapInArrow(run, schema)
    return partial.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _as_rows(held: dict[str, np.ndarray], pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    names, counts = list(held), np.concatenate(list(held.values()))
    columns = {
        "part": pa.array([x for x in names for _ in pairs], pa.string()),
        "before": pa.array(np.tile([s for s, _ in pairs], len(names)), pa.int32()),
        "filter": pa.array(np.tile([f for _, f in pairs], len(names)), pa.int32()),
    }
    return pa.RecordBatch.from_pydict(columns | {c: pa.array(counts[:, i], pa.int64()) for i, c in enumerate(COUNTS)})


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step, with counts of documents."""
    counts = materialise(prefix_counts(with_labels(with_copies(judged(docs, part)), labels)), "audit-counts")
    steps = []
    for order in itertools.permutations(range(5)):
        before = 0
        for k, f in enumerate(order):
            steps.append(("".join(FILTERS[x] for x in order), k + 1, before, f))
            before |= 1 << f
    orders = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, filter int")  # 600 rows, whatever the input
    unique = counts.where("before + shiftleft(1, filter) = 31").select("part", "filter", F.col("removed").alias("unique_fails"))
    rows = counts.join(F.broadcast(orders), ["before", "filter"])
    by_filter = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley")).join(unique, ["part", "filter"])
    return rows.join(by_filter, ["part", "filter"]).select(
        "part", "filter_order", "step", F.col("others_pass").alias("kept"), "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


AUDIT_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), f as (
  select part, (len(words) < 50)::int + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::int
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int
    + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int as fails,
    coalesce(doc_id in (select doc_id from labels where quality = 1 and doc_id is not null), false) as good,
    coalesce(doc_id in (select doc_id from labels where toxic = 1 and doc_id is not null), false) as toxic
  from d
), c as (
  select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by all
), l as (
  select unnest([0, 1, 2, 3, 4]) as x
), orders as (
  select [a.x, b.x, c.x, d.x, e.x] as o from l a, l b, l c, l d, l e
  where a.x + b.x + c.x + d.x + e.x = 10 and len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps as (
  select list_aggregate(list_transform(o, lambda x: substr('ABCDE', x + 1, 1)), 'string_agg', '') as filter_order, s as step, 1 << o[s] as own,
    list_sum(list_transform(o[1:s - 1], lambda x: 1 << x))::int as before_or_null, o from orders, range(1, 6) t(s)
), r as (
  select part, filter_order, step, own, coalesce(sum(n) filter (fails & (before | own) = 0), 0) as kept,
    coalesce(sum(n) filter (fails & own <> 0 and fails & before = 0), 0) as removed,
    coalesce(sum(n) filter (fails & own <> 0 and fails & before <> 0), 0) as redundant, coalesce(sum(n) filter (fails = own), 0) as unique_fails,
    coalesce(sum(good) filter (fails & own <> 0 and fails & before = 0), 0) as good_lost, coalesce(sum(toxic) filter (fails & own <> 0 and fails & before = 0), 0) as toxic_lost
  from c, (select *, coalesce(before_or_null, 0) as before from steps) group by part, filter_order, step, own
)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from r
"""
