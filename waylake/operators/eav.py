"""Entity-attribute-value operators: unpivot, pivot, tag maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from waylake.functions.storage import materialise


def unpivot(df: DataFrame, ids: Sequence[str], fields: Sequence[str], drop_nulls: bool = False) -> DataFrame:
    """One row per id and field: (ids, s_name, s_value as text). Layers differ in whether nulls stay."""
    text = df.select(*ids, *[F.col(f).cast("string").alias(f) for f in fields])
    tall = text.unpivot(list(ids), list(fields), "s_name", "s_value")
    return tall.where("s_value is not null") if drop_nulls else tall


def last_per_name(attributes: DataFrame, key: str, order: str) -> DataFrame:
    """One value per (key, s_name): the last by ``order``, then by value."""
    return attributes.groupBy(key, "s_name").agg(F.max_by("s_value", F.struct(order, "s_value")).alias("s_value"))


def collected_tags(where: Column | None = None) -> Column:
    """Aggregate: a map of names to values. Of several values of a name the largest stays; null names are left out."""
    pair = F.struct("s_name", "s_value")
    named = F.col("s_name").isNotNull() if where is None else F.col("s_name").isNotNull() & where
    pairs = F.array_sort(F.collect_list(F.when(named, pair)))
    beside = F.arrays_zip(pairs.alias("own"), F.slice(pairs, F.lit(2), F.size(pairs)).alias("next"))
    last = F.filter(beside, lambda x: x["own"].isNotNull() & (x["next"].isNull() | (x["next"]["s_name"] != x["own"]["s_name"])))
    return F.map_from_entries(F.transform(last, lambda x: x["own"]))


def tag_map(attributes: DataFrame, key: str, where: Column | None = None, name: str = "tags") -> DataFrame:
    """(key, map of names to values), over the attributes that meet ``where``; see collected_tags() for repeated names."""
    return attributes.groupBy(key).agg(collected_tags(where).alias(name))


def as_text(tags: Column) -> Column:
    """A tag map as sorted 'k=v' text, which is comparable and groupable."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("")))), ";")


def json_tags(df: DataFrame, ids: Sequence[str], column: str) -> DataFrame:
    """One row per key of a JSON object in ``column``."""
    return df.select(*ids, F.explode(F.from_json(column, "map<string,string>")).alias("s_name", "s_value"))


def pick(attributes: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """One row per key with a column for each named attribute: one pass in place of a join per name."""
    return attributes.where(F.col("s_name").isin(*names)).groupBy(key).agg(
        *[F.max(F.when(F.col("s_name") == n, F.col("s_value"))).alias(n) for n in names]
    )


def surrogate_ids(df: DataFrame, order: Sequence[Column | str], name: str = "id", after: int = 0) -> DataFrame:
    """Ids 1, 2, ... in a fixed order (W1, W3, W4), counted per range partition and offset, so that no
    task holds all rows."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number is never coalesced
    # written once: the bounds of ranges come from samples, and counts and numbers must see the same ranges
    dealt = materialise(df.repartitionByRange(n, *cols).withColumn("_p", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    bases = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = dealt.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(*cols)))
    return numbered.join(F.broadcast(bases), "_p").withColumn(name, F.col("_r") + F.col("_base") + after).drop("_p", "_r", "_base")
