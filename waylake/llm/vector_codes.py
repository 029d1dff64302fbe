"""Operator 12: product codes of vectors, found by partial-distance search.

A component x counts as the integer floor(1024 x). A vector is cut into four consecutive parts; every part position has
a codebook of at most 256 integer entries, which starts as that part of the first vectors by id. A round assigns each
part to its nearest entry (ties to the lower index) and replaces each entry by the componentwise floor of the mean of
its parts. A round is one pass over all vectors: every task adds its parts up by entry, Spark adds the tasks' sums up,
and the driver holds the codebooks alone (parts x 256 x width integers, whatever the number of vectors).

The nearest entry comes by partial distances: dimensions are taken in the order of falling variance in the codebook,
a few at a time. A first complete distance for each part is that to its nearest entry over the first dimensions; pairs
of part and entry whose sum over the dimensions so far strictly exceeds the part's best complete distance are dropped
by a mask, and after each step the pair that leads is completed, which lowers the best distance. A pair that stays to
the end has its exact distance, so no nearest entry is ever dropped, nor one that ties with it.

Cases: a vector that is null or holds a null, NaN or infinite component is dropped; vectors shorter than the longest
one are filled with zeros at the end, and so is a length that four doesn't divide; components count as at most 2^26 in
size after scaling, so that distances of 512 components a part fit in 64 bits; vectors of equal id are ordered by their
components, null ids come last; with fewer than 256 vectors there are as many entries as vectors; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from waylake.llm.common import join_uneven, materialise

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Bound of a scaled component.
LARGEST = 1 << 26
#: Dimensions added between two maskings.
STEP = 4
#: Vectors searched at once; with 256 entries their distances take 8 MB.
BLOCK = 4096


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of ``book`` for each row of ``parts``, both of integers."""
    n, width = parts.shape
    if not width or not n:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-book.astype(float).var(axis=0), kind="stable")
    x, b = np.ascontiguousarray(parts[:, order]), np.ascontiguousarray(book[:, order])
    acc = np.zeros((n, len(b)), np.int64)
    for d in range(min(STEP, width)):
        acc += (x[:, d, None] - b[None, :, d]) ** 2
    lead = acc.argmin(axis=1)
    best = ((x - b[lead]) ** 2).sum(axis=1)
    row, entry = np.nonzero(acc <= best[:, None])
    acc = acc[row, entry]
    for at in range(STEP, width, STEP):
        acc = acc + ((x[row, at : at + STEP] - b[entry, at : at + STEP]) ** 2).sum(axis=1)
        live = acc <= best[row]
        row, entry, acc = row[live], entry[live], acc[live]
        if len(row) == n:
            continue
        starts = np.searchsorted(row, np.arange(n))  # every row keeps a pair: its nearest entry is never dropped
        low = np.minimum.reduceat(acc, starts)
        leads = np.flatnonzero(acc == low[row])
        lead[row[leads[::-1]]] = entry[leads[::-1]]  # the first of equal ones is written last
        best = np.minimum(best, ((x - b[lead]) ** 2).sum(axis=1))
    starts = np.searchsorted(row, np.arange(n))
    low = np.minimum.reduceat(acc, starts)
    hits = np.flatnonzero(acc == low[row])
    lead[row[hits[::-1]]] = entry[hits[::-1]]
    return lead, low


def scaled(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(kept, vectors): which values are whole vectors, and those as integers, filled up to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    owner = np.repeat(np.arange(len(column)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    bad = np.zeros(len(column), bool)
    bad[owner[~np.isfinite(flat)]] = True
    kept = column.is_valid().to_numpy(zero_copy_only=False).astype(bool) & ~bad
    whole = np.zeros((len(column), width), np.int64)
    use = kept[owner]
    whole[owner[use], place[use]] = np.clip(np.floor(SCALE * flat[use]), -LARGEST, LARGEST).astype(np.int64)
    return kept, whole[kept]


def _whole(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null and holds finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vector).isNotNull() & ~bad)


def first_books(vectors: DataFrame, entries: int = ENTRIES) -> tuple[list[np.ndarray], int]:
    """The starting codebooks of the four parts, from the ``entries`` first vectors by id, and the common width."""
    whole = _whole(vectors, "vector")
    longest = whole.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return [], 0
    width = -(-longest // PARTS) * PARTS
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()  # bounded by ``entries``
    _, ints = scaled(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), width)
    return np.split(ints, PARTS, axis=1), width


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            block = batch.slice(at, BLOCK)
            kept, ints = scaled(block.column("vector"), width)
            if len(ints):
                yield block, kept, ints


def improved(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over all vectors."""
    k, part_width = books[0].shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, k, part_width), np.int64)
        count = np.zeros((PARTS, k), np.int64)
        for _, _, ints in _blocks(batches, part_width * PARTS):
            for p, part in enumerate(np.split(ints, PARTS, axis=1)):
                index, _ = nearest(part, books[p])
                order = np.argsort(index, kind="stable")
                used, starts = np.unique(index[order], return_index=True)
                if part_width:
                    total[p, used] += np.add.reduceat(part[order], starts, axis=0)
                count[p] += np.bincount(index, minlength=k)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(count[p, e], pa.int64()),
            "total": pa.array(list(total[p, e]), pa.list_(pa.int64())),
        })

    partial = vectors.select("vector").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    each = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(part_width)]
    rows = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect()  # at most parts x entries rows
    better = [b.copy() for b in books]
    for r in rows:
        better[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(part_width)]
    return better


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) by the nearest entries; code holds two hex digits a part."""
    part_width = books[0].shape[1]
    label = vectors.schema["label"].dataType.simpleString()
    vec_id = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, kept, ints in _blocks(batches, part_width * PARTS):
            found = [nearest(part, book) for part, book in zip(np.split(ints, PARTS, axis=1), books)]
            packed = np.stack([index.astype(np.uint8) for index, _ in found], axis=1)
            digits = packed.tobytes().hex()
            mask = pa.array(kept)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("vec_id").filter(mask), block.column("label").filter(mask),
                    pa.array([digits[i : i + 2 * PARTS] for i in range(0, len(digits), 2 * PARTS)], pa.string()),
                    pa.array(sum(error for _, error in found), pa.int64()),
                ],
                ["vec_id", "label", "code", "error"],
            )

    return vectors.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id {vec_id}, label {label}, code string, error long")


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every whole vector. ``entries`` is at most 256."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    slim = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    books, _ = first_books(slim, entries)
    if not books:
        id_type = slim.schema["vec_id"].dataType.simpleString()
        return slim.sparkSession.createDataFrame([], f"vec_id {id_type}, code string, error long, label_error long, codebooks_sha256 string")
    for _ in range(rounds):
        books = improved(slim, books)
    coded = materialise(encode(slim, books).withColumn("k", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))), "codes")
    per_label = coded.groupBy("k").agg(F.count("*").alias("n"), F.sum("error").alias("label_error"))
    both = join_uneven(coded.select("vec_id", "code", "error", "k"), materialise(per_label, "code-labels"), "k", "n")
    return both.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


def _codes_sql() -> str:
    """The same rows in SQL: assignments by sums of squares, one common table expression a step."""
    steps = [
        "whole as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings where embedding is not null"
        " and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "parts as materialized (select vec_id, p, v[p * w + 1 : (p + 1) * w] as x from (select *, len(v) // 4 as w from whole), range(4) t(p))",
        "b0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, x as b from parts"
        " where vec_id in (select vec_id from whole order by vec_id limit 256))",
    ]
    for k in range(5):
        steps.append(
            f"a{k} as materialized (select vec_id, p, min(d) as d, arg_min(e, d * 256 + e) as e from (select vec_id, s.p, e, list_inner_product(x, x)"
            f" - 2 * list_inner_product(x, b) + list_inner_product(b, b) as d from parts s join b{k} on s.p = b{k}.p) group by vec_id, p)"
        )
        if k < 4:
            steps.append(
                f"m{k} as (select p, e, list(m order by i) as b from (select a.p, e, i, floor(sum(x[i]) / count(*)) as m from a{k} a join parts using (vec_id, p),"
                f" range(1, len(x) + 1) t(i) group by a.p, e, i) group by p, e)"
            )
            steps.append(f"b{k + 1} as materialized (select b.p, b.e, coalesce(m.b, b.b) as b from b{k} b left join m{k} m on b.p = m.p and b.e = m.e)")
    steps.append("books as (select sha256(string_agg(list_aggregate(list_transform(b, lambda x: x::bigint::varchar), 'string_agg', ','), ',' order by p, e)) as h from b4)")
    steps.append("coded as (select vec_id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' order by p) as code, sum(d)::bigint as error from a4 group by vec_id)")
    return (
        "with " + ",\n".join(steps) + "\nselect vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256"
        " from coded join whole using (vec_id), books"
    )


#: For tables of unique ids whose vectors have one length that four divides.
CODES_SQL = _codes_sql()
