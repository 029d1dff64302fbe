"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from waylake.functions.storage import fresh_path, materialise, shared_dir
from waylake.operators.graph import connected_components

__all__ = ["WORD", "connected_components", "drop_written", "free_names", "fresh_path", "join_uneven", "materialise", "packed", "shared_dir"]

#: ASCII white space separates words; everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"


def drop_written(*tables: DataFrame) -> None:
    """Delete the files behind materialised tables from which everything needed has been written."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            # input files are named as URIs
            path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame) -> DataFrame:
    """All columns in one struct column ``row``, so that an operator's own columns clash with none of them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as it needs to differ from those taken (letter case aside)."""
    used = {t.lower() for t in taken}
    found = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        found.append(name)
    return found


def join_uneven(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join of ``rows`` with ``table``, one row per non-null key, whatever share of the rows a key holds.

    ``weight`` says how many rows have the key. Keys with over a thousandth of the summed weight, fewer than a
    thousand by that, are broadcast; the others are shuffled. Rows with a null key or a broadcast one are dealt out
    evenly. Returns the columns of ``rows`` and those of ``table`` other than key and weight.
    """
    values = [c for c in table.columns if c not in (key, weight)]
    total = table.agg(F.sum(weight).alias("_all"))
    shares = table.crossJoin(F.broadcast(total)).withColumn("_hot", F.col(weight) * 1000 > F.col("_all"))  # one row
    of = lambda k, v, where: shares.where(where).select(F.col(key).alias(k), F.struct(*values).alias(v))
    near = rows.join(F.broadcast(of("_near", "_a", "_hot")), F.col(key) == F.col("_near"), "left")
    near = near.withColumn("_key", F.when(F.col("_near").isNull(), F.col(key)))
    near = near.withColumn("_salt", F.when(F.col("_key").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(4096)) + 1).otherwise(0))
    far = of("_far", "_b", "not _hot").withColumn("_none", F.lit(0).cast("long"))
    both = near.join(far, (F.col("_key") == F.col("_far")) & (F.col("_salt") == F.col("_none")), "left")
    return both.select(*rows.columns, *[F.coalesce(F.col(f"_a.{c}"), F.col(f"_b.{c}")).alias(c) for c in values])
