"""Operator 8: SimHash near-duplicates, compared by bit planes.

A document's fingerprint is the majority vote of the XXH64 values of its 3-word shingles.
Fingerprints within ``radius`` bits share all bits of some choice of ``blocks - radius`` out of
``blocks`` blocks (pigeonhole), so each choice is a bucket key. Within a bucket the fingerprints
are stored vertically, one bit vector per bit plane. A query adds the planes that differ from it
into carry-save counters, one lane per fingerprint, and stops once every lane exceeds the radius.
Each bucket emits only a spanning forest of its links, at most one row per member. Buckets larger
than a tile are split into pairs of tiles, so no task holds an unbounded group.

Cases: null text counts as empty; a text with no word has fingerprint zero and is linked like any
other; repeated rows stay and share a component; a null doc_id stays and takes the component of its
fingerprint; an empty table gives an empty result; other columns are
ignored, and carried along by keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from waylake.llm.common import connected_components, materialise, packed

BITS = 64
SEED = 42
_UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def text_key(text: str = "text") -> Column:
    return F.xxhash64(text, F.length(text))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text as an unsigned 64-bit number."""
    # bytes.split() splits at exactly the six ASCII white space characters
    words = (text or "").encode("utf-8", "replace").translate(_UPPER_TO_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(words[i : i + shingle]), SEED) for i in range(n)), np.uint64, n)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        bits = np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, th, fp): one row per input row, fp as a signed long; th names the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("th", text_key())
    return slim.mapInArrow(run, "doc_id long, th long, fp long")


class BitPlanes:
    """Fingerprints stored vertically: plane i holds bit i of every fingerprint."""

    def __init__(self, fps: np.ndarray):
        self.fps = [int(x) for x in fps]
        self.full = (1 << len(fps)) - 1
        bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        # lane j of a plane is bit j of a Python integer, so a plane is one machine-speed word operation
        self.planes = [
            int.from_bytes(np.packbits(bits[:, i], bitorder="little").tobytes(), "little") for i in range(BITS)
        ]

    def near(self, query: int, radius: int, skip: int = 0) -> int:
        """Lanes within the radius of the query, without those in ``skip``."""
        counters = [0] * max(1, radius.bit_length())
        over = skip
        full = self.full
        limit = radius + 1
        for i, plane in enumerate(self.planes):
            carry = plane ^ full if query >> (BITS - 1 - i) & 1 else plane
            carry &= ~over
            for k, c in enumerate(counters):  # carry-save addition of one bit to every lane
                counters[k] = c ^ carry
                carry &= c
                if not carry:
                    break
            else:
                over |= carry
            if limit < 1 << len(counters):  # counters can hold more than the radius
                reached = full
                for k, c in enumerate(counters):
                    reached &= c if limit >> k & 1 else ~c & full
                over |= reached
            if i >= radius and over == full:
                return 0
        return full & ~over


def forest(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """(member, root) for a spanning forest of the links among distinct fingerprints."""
    if len(fps) == 2:
        if (int(fps[0]) ^ int(fps[1])).bit_count() <= radius:
            yield 1, 0
        return
    planes = BitPlanes(fps)
    seen = 0
    for start in range(len(fps)):
        if seen >> start & 1:
            continue
        seen |= 1 << start
        frontier = [start]
        while frontier:
            found = planes.near(planes.fps[frontier.pop()], radius, seen)
            seen |= found
            while found:
                low = found & -found
                j = low.bit_length() - 1
                found ^= low
                frontier.append(j)
                yield j, start
        if seen == planes.full:
            return


def bucket_masks(blocks: int, radius: int) -> list[int]:
    """Bit masks of all choices of ``blocks - radius`` blocks out of 64 bits."""
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(blocks)]
    return [sum(block[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct_fps: DataFrame, radius: int = 3, blocks: int = 5, tile: int = 8192) -> DataFrame:
    """(a, b): a spanning forest, per bucket, of the fingerprints within the radius."""
    masks = bucket_masks(blocks, radius)
    keyed = distinct_fps.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(masks)])
        ).alias("bucket"),
    ).select("fp", "bucket.k", "bucket.v")
    sizes = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    # fingerprint rows per bucket are joined with the bucket's size; singletons go
    sized = keyed.join(sizes, ["k", "v"]).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("tiles")).cast("int")
    placed = (
        sized.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("k", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    group = ["k", "v", "i", "j"]
    dealt = placed.repartition(*group).sortWithinPartitions(*group, "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            edges, keep = _batch_links(b, group, radius)
            rest = b.iloc[keep:]
            yield edges
        if rest is not None and len(rest):
            yield _batch_links(rest.reset_index(drop=True), group, radius, last=True)[0]

    return dealt.mapInPandas(run, "a long, b long")


def _batch_links(b: pd.DataFrame, group: list[str], radius: int, last: bool = False) -> tuple[pd.DataFrame, int]:
    """Links of the complete groups of sorted rows, and where the last, open group starts."""
    keys = b[group].to_numpy(np.int64)
    fps = b["fp"].to_numpy(np.int64)
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(b) else np.zeros(0, int)
    ends = np.r_[starts[1:], len(b)]
    keep = len(b) if last or not len(b) else int(starts[-1])
    a_out: list[int] = []
    b_out: list[int] = []
    for s, e in zip(starts.tolist(), ends.tolist()):
        if e - s < 2 or (s >= keep and not last):
            continue
        part = fps[s:e]
        for x, y in forest(part.view(np.uint64), radius):
            a_out.append(int(part[x]))
            b_out.append(int(part[y]))
    return pd.DataFrame({"a": np.array(a_out, np.int64), "b": np.array(b_out, np.int64)}), keep


def _labelled(distinct: DataFrame, radius: int, blocks: int, tile: int) -> DataFrame:
    """``distinct`` (one row per fp) with the component of its fingerprint."""
    parts = connected_components(links(distinct.select("fp"), radius, blocks, tile)).withColumnRenamed("node", "fp")
    return distinct.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, blocks: int = 5, tile: int = 8192) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    fps = materialise(fingerprints(docs, shingle), "simhash")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-distinct")
    labelled = _labelled(distinct, radius, blocks, tile)
    smallest = labelled.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    by_fp = labelled.join(smallest, "component").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, radius: int = 3, shingle: int = 3, blocks: int = 5, tile: int = 8192) -> DataFrame:
    """One row of ``docs`` per group, the first by doc_id (nulls last), then by a hash of the text.

    Of rows that repeat both doc_id and text one stays, the first by a hash of the other columns."""
    fps = materialise(fingerprints(docs, shingle), "simhash")
    place = F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "th")
    distinct = materialise(fps.groupBy("fp").agg(F.min(place).alias("first")), "simhash-distinct")
    keepers = _labelled(distinct, radius, blocks, tile).groupBy("component").agg(F.min("first").alias("k"))
    repeated = fps.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").toDF("r_doc", "r_th", "n")
    same = F.col("k_doc").eqNullSafe(F.col("r_doc")) & F.col("k_th").eqNullSafe(F.col("r_th"))
    chosen = keepers.select(F.col("k.doc_id").alias("k_doc"), F.col("k.th").alias("k_th")).join(repeated, same, "left")
    chosen = materialise(chosen.select("k_doc", "k_th", F.col("n").isNotNull().alias("repeats")), "simhash-kept")
    rows = packed(docs)
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text")).withColumn("th", text_key())
    rows = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("k_doc")) & F.col("th").eqNullSafe(F.col("k_th")))
    single = rows.where("not repeats").select("row")
    once = rows.where("repeats").groupBy("k_doc", "k_th").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return single.union(once).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
