"""Operator 2: token ids in ORC files, with run-length encoding, row indexes and Bloom filters.

Documents are dealt by ranges of doc_id, sorted, encoded in place and written as ORC: ids are an
integer array column, which ORC stores with its run-length encoding; every ``row_index_stride`` rows
get index entries, and doc_id has a Bloom filter. Only texts are shuffled, ids never are. Files read
in parallel by stripe, and a read for given documents skips stripes and row groups by their minimum,
maximum and Bloom filter. Positions across the whole corpus come from per-file totals (one row per
file) and a running sum inside each file.

Cases: null or empty text is a document that holds just the end id; null doc_ids come first; rows
with the same doc_id are put in order by their text, and ``row`` keeps the order of a file; an empty table gives an empty file set; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from waylake.llm.common import fresh_path
from waylake.llm.tokens import WordBpe, loaded, read_model

SCHEMA = "doc_id long, n_tokens long, ids array<int>, row long"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """(doc_id, n_tokens, ids, row) with the end id appended; row counts the rows of a partition, in its order."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(tokenizer).decode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(WordBpe, model.value)
        row = 0
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                b = big.slice(at, 1000)
                found = bpe.encode(b.column(1).to_pylist())
                lens = np.fromiter(map(len, found), np.int64, len(found)) + 1
                bounds = np.r_[0, np.cumsum(lens)]
                flat = np.full(int(bounds[-1]), end_id, np.int32)
                for x, s in zip(found, bounds[:-1].tolist()):
                    flat[s : s + len(x)] = x
                ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
                rows = pa.array(np.arange(row, row + len(found), dtype=np.int64))
                row += len(found)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lens), ids, rows], ["doc_id", "n_tokens", "ids", "row"])

    return docs.mapInArrow(run, SCHEMA)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, row_index_stride: int = 1000, stripe_mb: int = 16
) -> None:
    """Write the ids of all documents in ascending doc_id order."""
    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = slim.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )
    (
        encode_documents(ordered, tokenizer, end_id)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.stripe.size", str(stripe_mb << 20))
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, row); given documents only if listed, by metadata pruning."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat = memoryview(lists.values.to_numpy().astype("<u4")).cast("B")
            cuts = (lists.offsets.to_numpy() * 4).tolist()
            crc = [zlib.crc32(flat[s:e]) for s, e in zip(cuts[:-1], cuts[1:])]
            n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(crc, pa.int64()), b.column(2), b.column(3)], ["doc_id", "n_tokens", "ids_crc32", "row", "file"])

    stored = read_token_files(spark, path).select("doc_id", "ids", "row", F.col("_metadata.file_name").alias("file"))
    rows = stored.mapInArrow(digest, "doc_id long, n_tokens long, ids_crc32 long, row long, file string")
    # totals come from the n_tokens column alone: ids are not read for them
    files = (
        read_token_files(spark, path)
        .groupBy(F.col("_metadata.file_name").alias("file"))
        .agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("first"))
    )
    in_order = W.orderBy(F.col("first").asc_nulls_first(), "file").rowsBetween(W.unboundedPreceding, -1)
    bases = files.select("file", F.coalesce(F.sum("total").over(in_order), F.lit(0)).alias("base"))
    in_file = W.partitionBy("file").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0)))
        .join(bases, "file")
        .select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "token-ids")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_index(spark, path)
