"""Operator 3: packing by shortest-pack-first over the length histogram.

Documents are encoded once, without moving their text. A document longer than a sequence is cut into
full pieces and a rest. Only the histogram of piece lengths (at most one row per length) reaches the
driver, which places lengths longest first into the pattern with the most room left, the shortest
pack, and counts how often each pattern is used. Pieces then meet the patterns by rank: all pieces
of one length have ranks, and every slot of a pattern owns a range of ranks. Ranks are counted
within hashed parts of a length and offset by the parts before, so a length that a third of all
pieces share is still dealt over many tasks.

Cases: null or empty text is a document of one token, the end id; repeated rows are packed one by
one; a null doc_id is packed like any other; an empty table gives no sequences; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from waylake.llm.common import materialise
from waylake.llm.tokens import WordBpe, loaded, read_model

END_ID = 1
ROWS, KNOWN_WORDS = 512, 500_000  # texts encoded at once, and words whose ids a worker remembers
PARTS = 256  # hashed parts of a length's pieces


class Slots(NamedTuple):
    """Every slot of every pattern, sorted by length and then by the first rank that it takes."""

    length: np.ndarray
    first_rank: np.ndarray
    sequence: np.ndarray  # sequence of the first rank; the others follow one by one
    offset: np.ndarray  # position in the sequence


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(uses, lengths in order) of each packing pattern; counts: pieces by length."""
    open_at: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms = 0  # bit r is set while a pattern has r tokens of room
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(room: int, uses: int, pattern: tuple[int, ...]) -> None:
        nonlocal rooms
        if room:
            open_at.setdefault(room, []).append((uses, pattern))
            rooms |= 1 << room
        else:
            done.append((uses, pattern))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = rooms.bit_length() - 1
            if room < length:  # no pack can take it
                fit = size // length
                put(size - length, left, (length,)) if fit == 1 else None
                if fit > 1:
                    whole, rest = divmod(left, fit)
                    if whole:
                        put(size - fit * length, whole, (length,) * fit)
                    if rest:
                        put(size - rest * length, 1, (length,) * rest)
                break
            uses, pattern = open_at[room].pop()
            if not open_at[room]:
                rooms ^= 1 << room
            placed = min(left, uses)
            if uses > placed:
                put(room, uses - placed, pattern)
            put(room - length, placed, (*pattern, length))
            left -= placed
    for packs in open_at.values():
        done += packs
    return done


def slots_of(patterns: list[tuple[int, tuple[int, ...]]]) -> Slots:
    rows: list[tuple[int, int, int, int]] = []
    taken: dict[int, int] = {}
    sequence = 0
    for uses, pattern in sorted(patterns, key=lambda p: p[1], reverse=True):
        offset = 0
        for length in pattern:
            rows.append((length, taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + uses
            offset += length
        sequence += uses
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Slots(*table.T)


def encoded_pieces(docs: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) for every piece of every document."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(tokenizer).decode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(WordBpe, model.value)
        bpe.pool.limit = KNOWN_WORDS
        for b in (big.slice(at, ROWS) for big in batches for at in range(0, big.num_rows, ROWS)):
            rows: list[tuple] = []
            for doc_id, ids in zip(b.column(0).to_pylist(), bpe.encode(b.column(1).to_pylist())):
                ids = np.append(ids, END_ID).astype("<u4")
                for at in range(0, len(ids), size):
                    piece = ids[at : at + size]
                    rows.append((doc_id, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str, size: int = 2048) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece."""
    part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(PARTS)).cast("int")
    pieces = materialise(encoded_pieces(docs, tokenizer, size).withColumn("part", part), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    slots = slots_of(pack_histogram(histogram, size))

    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    in_part = W.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(in_part) - 1).join(offsets, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # slots are sorted, so length and rank as one number find their slot by binary search
        wide = np.int64(1) << 48
        starts = slots.length * wide + slots.first_rank
        for b in batches:
            i = np.searchsorted(starts, b["length"].to_numpy() * wide + b["rank"].to_numpy(), side="right") - 1
            b["sequence_id"] = slots.sequence[i] + b["rank"].to_numpy() - slots.first_rank[i]
            b["offset"] = slots.offset[i]
            yield b.drop(columns="rank")

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return ranked.select(*columns, "rank").mapInPandas(
        place, ", ".join(f"{c} long" for c in [*columns, "sequence_id", "offset"])
    )


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
