"""Operator 4: token-count rollups maintained by deltas.

A batch of changes carries signed rows: an insert adds a document's counts, a delete takes them
back, a revision is a delete of the old counts and an insert of the new ones. Each batch is
pre-aggregated by source, language and tokenizer version and written under its own batch id, so
writing a batch again (a retry, a replayed stream batch) replaces it and changes nothing. Totals are
the sum over all batches; ``compact`` folds batches into one base without losing their ids.

Cases: null source, language and version are group values of their own; null counts count as zero;
null texts have no tokens; repeated rows count each time; an empty batch is recorded and adds
nothing; groups whose documents and tokens are all taken back disappear from the totals.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waylake.llm.common import WORD, fresh_path, materialise
from waylake.llm.pieces import PieceBpe
from waylake.llm.tokens import WordBpe, loaded, read_model

KEYS = ["source", "lang", "tokenizer_version"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


class TokenRollup:
    """A rollup in a folder: ``batch=<id>`` holds one batch's sums."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def commit(self, batch_id: int, changes: DataFrame) -> None:
        """Record one batch of (source, lang, tokenizer_version, n_tokens, sign) rows; sign is +1 or -1.

        A batch id that is already part of a compacted base is left alone.
        """
        if batch_id in self._compacted():
            return
        sums = changes.groupBy(*KEYS).agg(
            F.sum(F.col("sign").cast("long")).alias("n_docs"),
            F.coalesce(F.sum(F.col("sign") * F.coalesce(F.col("n_tokens"), F.lit(0))), F.lit(0)).cast("long").alias("n_tokens"),
        )
        sums.select(*KEYS, "n_docs", "n_tokens").write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens) after all batches."""
        return self._sum(self._folders())

    def compact(self) -> None:
        """Fold all batches into a new base of the next generation. It becomes visible by one rename, with the ids that
        it holds; only then are the folders that it replaces deleted, so a crash at any point loses nothing."""
        folders = self._folders()
        bases = [int(f.rsplit("=", 1)[1]) for f in folders if "/base=" in f]
        ids = sorted(self._compacted() | {int(f.rsplit("=", 1)[1]) for f in folders if "/batch=" in f})
        if not ids:
            return
        generation = max(bases, default=0) + 1
        staging, base = f"{self.path}/_staging-{uuid.uuid4().hex}", f"{self.path}/base={generation}"
        self._sum(folders).write.parquet(f"{staging}/sums")
        self.spark.createDataFrame([(i,) for i in ids], "id long").write.parquet(f"{staging}/ids")
        fs, path = self._fs()
        if fs.exists(path(base)) or not fs.rename(path(staging), path(base)):
            raise RuntimeError(f"another writer made {base}")
        for f in folders:
            fs.delete(path(f), True)

    def _sum(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        files = [f"{f}/sums" if "/base=" in f else f for f in folders]
        read = self.spark.read.schema(SCHEMA).parquet(*files)
        return read.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 or n_tokens != 0")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _folders(self) -> list[str]:
        """The newest base and the batches that it doesn't hold."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        bases = sorted((int(n.split("=")[1]), n) for n in names if n.startswith("base="))
        held = self._held(bases[-1][1]) if bases else set()
        batches = [n for n in names if n.startswith("batch=") and int(n.split("=")[1]) not in held and fs.exists(path(f"{self.path}/{n}/_SUCCESS"))]
        return [f"{self.path}/{n}" for n in sorted(batches) + ([bases[-1][1]] if bases else [])]

    def _held(self, base: str) -> set[int]:
        return {r["id"] for r in self.spark.read.parquet(f"{self.path}/{base}/ids").collect()}  # one row per batch

    def _compacted(self) -> set[int]:
        held: set[int] = set()
        for f in self._folders():
            if "/base=" in f:
                held |= self._held(f.rsplit("/", 1)[1])
        return held


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def n_letters_and_words(text: str = "text") -> Column:
    """The revised counter: words, and each run of signs at a word's end counts too."""
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[.,!?]+|[^\x20\x09-\x0D.,!?]+")).cast("long")


def tokenizer_counts(docs: DataFrame, word_bpe: str, pieces: str) -> DataFrame:
    """(doc_id, source, lang, n_word, n_piece): the tokens of every whole text by two tokenizers, without end ids.

    ``word_bpe`` is a file of the tokenizers library, ``pieces`` one of the sentencepiece library."""
    context = docs.sparkSession.sparkContext
    words, model = context.broadcast(read_model(word_bpe).decode()), context.broadcast(read_model(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = loaded(WordBpe, words.value), loaded(PieceBpe, model.value)
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                texts = b.column(3).to_pylist()
                n_word = pa.array([len(ids) for ids in encoders[0].encode(texts)], pa.int64())
                n_piece = pa.array([len(found.ids) for found in encoders[1].encode(texts)], pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], n_word, n_piece], ["doc_id", "source", "lang", "n_word", "n_piece"])

    slim = docs.select(F.col("doc_id").cast("long"), *[F.col(c).cast("string") for c in ("source", "lang", "text")])
    return slim.mapInArrow(run, "doc_id long, source string, lang string, n_word long, n_piece long")


def changes(df: DataFrame, version: str, tokens: Column, sign: int) -> DataFrame:
    """Signed rows of a batch, from documents with their source and language."""
    return df.select("source", "lang", F.lit(version).alias("tokenizer_version"), tokens.alias("n_tokens"), F.lit(sign).alias("sign"))


def _toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id").distinct()


WORD_VERSION, PIECE_VERSION = "word_bpe_49k", "piece_bpe_32k"


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Batch 0 inserts all documents as one tokenizer counts them, batch 1 deletes the toxic ones, batch 2 inserts
    the others as a second tokenizer counts them, batch 3 revises all counts of the first, which left out the end id;
    then batch 1 is replayed, which must change nothing."""
    import public_tokenizers

    paths = [public_tokenizers.path(f) for f in (f"{WORD_VERSION}.json", f"{PIECE_VERSION}.model")]
    docs = materialise(tokenizer_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), *paths), "token-counts")
    toxic = _toxic(spark, sf_dir)
    rollup = TokenRollup(spark, fresh_path(spark, "token-rollup"))
    rollup.commit(0, changes(docs, WORD_VERSION, F.col("n_word"), 1))
    deletes = changes(docs.join(toxic, "doc_id", "left_semi"), WORD_VERSION, F.col("n_word"), -1)
    rollup.commit(1, deletes)
    left = docs.join(toxic, "doc_id", "left_anti")
    rollup.commit(2, changes(left, PIECE_VERSION, F.col("n_piece"), 1))
    old, new = (changes(left, WORD_VERSION, n, sign) for n, sign in ((F.col("n_word"), -1), (F.col("n_word") + 1, 1)))
    rollup.commit(3, old.unionByName(new))
    rollup.commit(1, deletes)
    rollup.compact()
    return rollup.totals()


def rollup_words(spark, sf_dir: str) -> DataFrame:
    """The same rollup over counts of words, which SQL can check: batch 0 inserts all documents, batch 1 deletes the
    toxic ones, batch 2 revises one source's counts; then batch 1 is replayed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    toxic = _toxic(spark, sf_dir)
    rollup = TokenRollup(spark, fresh_path(spark, "token-rollup"))
    rollup.commit(0, changes(docs, "words-1", n_words(), 1))
    # counting comes before the join, so that no text is shuffled
    counted = docs.select("doc_id", "source", "lang", n_words().alias("n"))
    deletes = changes(counted.join(toxic, "doc_id", "left_semi"), "words-1", F.col("n"), -1)
    rollup.commit(1, deletes)
    revised = docs.where("source = 'src1'").select(
        "doc_id", "source", "lang", n_words().alias("n"), n_letters_and_words().alias("n2")
    ).join(toxic, "doc_id", "left_anti")
    rollup.commit(2, changes(revised, "words-1", F.col("n"), -1).unionByName(changes(revised, "words-2", F.col("n2"), 1)))
    rollup.commit(1, deletes)
    rollup.compact()
    return rollup.totals()


WORDS_SQL = r"""
WITH d AS (
  SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n,
         len(regexp_extract_all(coalesce(text, ''), '[.,!?]+|[^\x20\x09-\x0D.,!?]+')) AS n2
  FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))
SELECT source, lang, CASE WHEN source = 'src1' THEN 'words-2' ELSE 'words-1' END AS tokenizer_version,
       count(*) AS n_docs, CAST(sum(CASE WHEN source = 'src1' THEN n2 ELSE n END) AS BIGINT) AS n_tokens
FROM d GROUP BY 1, 2, 3
"""
