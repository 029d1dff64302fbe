"""Operator 6: quality rules with robust multivariate outliers.

Base rules reject very short texts and texts full of repeated passages. The rest is judged by the
minimum covariance determinant (MCD): per language and source, concentration steps look for the
centre and covariance of the three quarters of documents that lie closest together, and documents
whose Mahalanobis distance from them is beyond a chi-square quantile are rejected.

Every step is one aggregation over all documents: distances fall into bins, sums and cross products
are added up per group and bin (whole numbers, so any order gives the same sums), and the bins up to
the three-quarter mark give the next estimate. Groups are pre-aggregated, so a hot source costs no
more than others. Groups under ``min_group`` documents are pooled by language, and languages under
it are pooled together; a pool still under it gives no verdict, and its documents stay.

Cases: null text has no words and fails the base rules; null language or source is a group value of
its own; repeated rows are judged alike; a null doc_id stays; an empty table gives an empty result; other
columns are ignored by judge() and carried along by filter_documents(), whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from waylake.llm.common import materialise, packed

UNIT = 1024  # statistics are kept as whole numbers of 1/UNIT
#: Added to the spread of each statistic, as a standard deviation of its own: log words, log word length, root of symbols per
#: word, share of repeated lines, share of words in repeated passages, share of capital letters.
FLOORS = (0.5, 0.1, 0.08, 0.1, 0.08, 0.06)
DIM = len(FLOORS)
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Broadcast estimates only up to so many groups (about 300 bytes each); beyond it, a salted join.
MOST_BROADCAST = 20_000
_SPACES = " \t\n\x0b\x0c\r"


def text_stats(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_letters."""
    t = text or ""
    words = t.encode("utf-8", "replace").split()  # splits at the ASCII white space characters only
    n = len(words)
    word_chars = len(t) - sum(map(t.count, _SPACES))
    symbols = sum(map(t.count, "#*$%&|<>"))
    lines = [x for x in t.split("\n") if x.strip(_SPACES)]
    upper = sum(map(str.isupper, t)) if not t.isascii() else None
    if upper is None:
        b = t.encode()
        upper = len(b) - len(b.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        letters = upper + len(b) - len(b.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    else:
        letters = sum(map(str.isalpha, t))
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), upper, letters


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows of five that occur at least twice."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    v = len(seen)
    if v**window < 1 << 63:
        m = n - window + 1
        key = ids[:m].copy()
        for k in range(1, window):
            key = key * v + ids[k : k + m]
    else:  # rank pairs, then pairs of pairs, so that keys stay exact
        two = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
        four = np.unique(two[:-2] * n + two[2:], return_inverse=True)[1]
        key = four[: n - 4] * v + ids[4:]
    order = np.sort(key)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    again = again[np.r_[True, again[1:] != again[:-1]]]
    at = again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key
    starts = np.flatnonzero(at)
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return int((np.cumsum(marks)[:n] > 0).sum())


def _vector(s: np.ndarray) -> np.ndarray:
    """Transformed statistics in whole units, from rows of text_stats()."""
    n, chars, symbols, dup, rep, lines, upper, letters = (s[:, i].astype(float) for i in range(8))
    n = np.maximum(n, 1)
    x = np.stack([
        np.log(n), np.log(np.maximum(chars, 1) / n), np.sqrt(symbols / n), dup / np.maximum(lines, 1), rep / n, upper / np.maximum(letters, 1),
    ], axis=1)
    return np.rint(x * UNIT).astype(np.int64)


def with_stats(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and one struct column ``_q`` with the base counts and statistics."""
    at = docs.columns.index("text")
    fields = [*BASE, *(f"x{i}" for i in range(DIM))]
    names = docs.columns
    counts = T.StructType([T.StructField(f, T.LongType()) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([text_stats(t) for t in b.column(at).to_pylist()], np.int64).reshape(-1, 8)
            values = [*(s[:, i] for i in range(5)), *_vector(s).T]
            q = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v)) for v in values], fields)
            yield pa.RecordBatch.from_arrays([*b.columns, q], [*names, "_q"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_q", counts)]))


def base_failed(q: str = "_q") -> Column:
    n, rep = F.col(f"{q}.n_words"), F.col(f"{q}.n_repeat_words")
    return (n < 10) | (100 * rep > 20 * n)


def _group_names(df: DataFrame) -> DataFrame:
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return df.withColumn("_lang", part("lang")).withColumn("_src", F.concat_ws("\t", "_lang", part("source")))


def small_join(big: DataFrame, small: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join a table of one row per group: broadcast if it is small, else salted against hot groups."""
    if small.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return big.join(F.broadcast(small), key, how)
    salts = 32
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = big.withColumn("_salt", F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")).otherwise(-1))
    return dealt.join(salted, [key, "_salt"], how).drop("_salt")


def assign_groups(stats: DataFrame, min_group: int) -> tuple[DataFrame, DataFrame]:
    """(source group -> estimate group) over the documents that pass the base rules, and its sizes."""
    own = _group_names(stats).groupBy("_src", "_lang").agg(F.count("*").alias("n"))
    small = own.where(F.col("n") < min_group).groupBy("_lang").agg(F.sum("n").alias("n_lang"))
    named = own.join(small, "_lang", "left").withColumn(
        "_g",
        F.when(F.col("n") >= min_group, F.col("_src"))
        .when(F.col("n_lang") >= min_group, F.concat(F.lit("pool\t"), F.col("_lang")))
        .otherwise("pool"),
    )
    groups = materialise(named.select("_src", "_g", "n"), "mcd-groups")
    return groups.select("_src", "_g"), groups.groupBy("_g").agg(F.sum("n").alias("n")).where(F.col("n") >= min_group)


def _chi2_cdf(x: float, even_df: int) -> float:
    term = total = math.exp(-x / 2)
    for k in range(1, even_df // 2):
        term *= x / 2 / k
        total += term
    return 1 - total


def chi2_quantile(p: float, even_df: int = DIM) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, even_df) < p else (lo, mid)
    return hi


def _d2() -> Column:
    """Squared Mahalanobis distance of the statistics from the joined estimate."""
    z = [F.col(f"_q.x{i}") - F.col("_mcd_m")[i] for i in range(DIM)]
    terms = [F.col("_mcd_inv")[k] * z[i] * z[j] * (1 if i == j else 2) for k, (i, j) in enumerate(PAIRS)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _estimate(n: float, sums: np.ndarray, cross: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and inverse covariance (upper triangle) from the sums over the closest documents."""
    mean = sums / n
    cov = np.zeros((DIM, DIM))
    for k, (i, j) in enumerate(PAIRS):
        cov[i, j] = cov[j, i] = cross[k] / n - mean[i] * mean[j]
    if share < 1:  # the closest share of a normal cloud understates its spread
        cov *= share / _chi2_cdf(chi2_quantile(share), DIM + 2)
    cov += np.diag([(f * UNIT) ** 2 for f in FLOORS])
    inv = np.linalg.inv(cov)
    return mean, np.array([inv[i, j] for i, j in PAIRS])


def fit(stats: DataFrame, share: float = 0.75, steps: int = 5, min_group: int = 64) -> tuple[DataFrame, DataFrame]:
    """(source group -> estimate group) and the estimates (_g, _mcd_m, _mcd_inv) from all documents in ``stats``."""
    groups, sizes = assign_groups(stats, min_group)
    vectors = small_join(_group_names(stats).select("_src", "_q"), groups, "_src", "inner").select("_g", "_q")
    vectors = materialise(vectors, "mcd-vectors")

    # start: medians and median absolute deviations, on statistics rounded to 1/64 (few distinct values)
    mids = vectors.groupBy("_g").agg(*[F.expr(f"percentile(round(_q.x{i} / 16), 0.5) * 16").alias(f"c{i}") for i in range(DIM)])
    mids = materialise(mids.join(sizes, "_g"), "mcd-mids")
    spread = small_join(vectors, mids.drop("n"), "_g", "inner").groupBy("_g").agg(
        *[F.expr(f"percentile(round(abs(_q.x{i} - c{i}) / 16), 0.5) * 16").alias(f"s{i}") for i in range(DIM)],
        *[F.first(f"c{i}").alias(f"c{i}") for i in range(DIM)],
    )
    diagonal = {k for k, (i, j) in enumerate(PAIRS) if i == j}
    inv = [
        1 / ((F.col(f"s{PAIRS[k][0]}") * 1.4826) ** 2 + (FLOORS[PAIRS[k][0]] * UNIT) ** 2) if k in diagonal else F.lit(0.0)
        for k in range(len(PAIRS))
    ]
    params = spread.select("_g", F.array(*[f"c{i}" for i in range(DIM)]).alias("_mcd_m"), F.array(*inv).alias("_mcd_inv"))
    params = materialise(params, "mcd-start")

    def step(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin")
        n = bins["n"].to_numpy(float)
        upto = int(np.searchsorted(np.cumsum(n), share * n.sum())) + 1
        part = bins.iloc[:upto]
        mean, inv = _estimate(
            n[:upto].sum(),
            np.array([sum(part[f"s{i}"].tolist()) for i in range(DIM)], float),
            np.array([sum(part[f"p{k}"].tolist()) for k in range(len(PAIRS))], float),
            min(1.0, n[:upto].sum() / n.sum()),
        )
        return pd.DataFrame({"_g": [bins["_g"].iloc[0]], "_mcd_m": [mean.tolist()], "_mcd_inv": [inv.tolist()]})

    for _ in range(steps):
        binned = small_join(vectors, params, "_g", "inner").withColumn("bin", F.floor(F.log2(1 + _d2()) * 16))
        # whole numbers of one partition fit in a long, those of all of them may not
        each = binned.withColumn("part", F.spark_partition_id()).groupBy("_g", "bin", "part").agg(
            F.count("*").alias("n"),
            *[F.sum(f"_q.x{i}").alias(f"s{i}") for i in range(DIM)],
            *[F.sum(F.col(f"_q.x{i}") * F.col(f"_q.x{j}")).alias(f"p{k}") for k, (i, j) in enumerate(PAIRS)],
        )
        names = [*[f"s{i}" for i in range(DIM)], *[f"p{k}" for k in range(len(PAIRS))]]
        sums = each.groupBy("_g", "bin").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in names])
        # a group has at most a few hundred bins, however many documents it has
        params = materialise(sums.groupBy("_g").applyInPandas(step, "_g string, _mcd_m array<double>, _mcd_inv array<double>"), "mcd-step")
    return groups, params


def _verdict(stats: DataFrame, groups: DataFrame, params: DataFrame, cutoff: float) -> DataFrame:
    """``stats`` with ``_failed`` and ``_kept``."""
    judged = small_join(small_join(_group_names(stats), groups, "_src"), params, "_g")
    return judged.withColumn("_failed", base_failed()).withColumn(
        "_kept", ~F.col("_failed") & (F.col("_mcd_m").isNull() | (_d2() <= cutoff))
    )


def cutoff_of(tail: float) -> float:
    return chi2_quantile(1 - tail)


def judge(docs: DataFrame, tail: float = 1e-6, **options) -> DataFrame:
    """(doc_id, the base counts, base_failed, kept) for every row of ``docs``."""
    slim = docs.select("doc_id", F.col("text").cast("string"), "lang", "source")
    stats = materialise(with_stats(slim).drop("text"), "quality")
    groups, params = fit(stats.where(~base_failed()), **options)
    out = _verdict(stats, groups, params, cutoff_of(tail))
    return out.select(F.col("doc_id"), *[F.col(f"_q.{c}").alias(c) for c in BASE], F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def filter_documents(docs: DataFrame, tail: float = 1e-6, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns.

    The statistics are computed twice, to fit and to filter, so that no text is shuffled.
    """
    slim = docs.select("doc_id", F.col("text").cast("string"), "lang", "source")
    stats = materialise(with_stats(slim).select("lang", "source", "_q"), "quality")
    groups, params = fit(stats.where(~base_failed()), **options)
    rows = packed(docs).select("row", F.col("row.text").cast("string").alias("text"), "row.lang", "row.source")
    kept = _verdict(with_stats(rows).drop("text"), groups, params, cutoff_of(tail)).where("_kept")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
