"""Fixture tables as features, points and attributes; the SQL forms sit beside them for the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lon_e6(key: str | Column) -> Column:
    """A longitude in micro-degrees inside the state's box."""
    return F.lit(140200000) + (F.col(key) if isinstance(key, str) else key) * 7919 % 10400000


def lat_e6(key: str | Column) -> Column:
    return F.lit(-39700000) + (F.col(key) if isinstance(key, str) else key) * 6271 % 6200000


def lon(key: str | Column) -> Column:
    return lon_e6(key) / 1e6


def lat(key: str | Column) -> Column:
    return lat_e6(key) / 1e6


LON = "((140200000 + ({0}) * 7919 % 10400000) / 1e6)"
LAT = "((-39700000 + ({0}) * 6271 % 6200000) / 1e6)"


def part_features(spark, sf_dir: str) -> DataFrame:
    """Parts as road features: id, name."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.lit("ROADS").alias("layer_id"), F.when(F.col("p_partkey") % 7 == 0, "UNNAMED").otherwise(F.col("p_name")).alias("name"))


TYPES = ("road", "connector", "ford", "bridge", "tunnel", "trail")


def part_attributes(spark, sf_dir: str) -> DataFrame:
    """class_code, feature_type_code (none for every 11th part) and road_type of part features, as a tall table."""
    key = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (key % 6 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select(
        key.alias("id"),
        (F.col("p_size") % 14).cast("string").alias("class_code"),
        F.when(key % 11 != 0, kind).alias("feature_type_code"),
        F.when(key % 5 == 0, "track").otherwise("sealed").alias("road_type"),
    )
    from waylake.operators.eav import unpivot

    return unpivot(p, ["id"], ["class_code", "feature_type_code", "road_type"], drop_nulls=True)


PART_SQL = """
features AS (SELECT p_partkey AS id, 'ROADS' AS layer_id, CASE WHEN p_partkey % 7 = 0 THEN 'UNNAMED' ELSE p_name END AS name FROM part),
attrs AS (
  SELECT p_partkey AS id, 'class_code' AS s_name, CAST(p_size % 14 AS VARCHAR) AS s_value FROM part
  UNION ALL SELECT p_partkey, 'feature_type_code', ['road','connector','ford','bridge','tunnel','trail'][CAST(p_partkey % 6 + 1 AS INTEGER)]
            FROM part WHERE p_partkey % 11 != 0
  UNION ALL SELECT p_partkey, 'road_type', CASE WHEN p_partkey % 5 = 0 THEN 'track' ELSE 'sealed' END FROM part)
"""


def order_versions(spark, sf_dir: str) -> DataFrame:
    """Orders as versioned features: id, cents, status, version_start = year - 1990, version_end."""
    o = table(spark, sf_dir, "orders")
    start = (F.year("o_orderdate") - 1990).cast("int")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        F.when(F.col("o_orderkey") % 17 == 0, "REMOVED").otherwise("ADDED").alias("status"),
        F.when(F.col("o_orderkey") % 19 != 0, start).alias("version_start"),
        F.when(F.col("o_orderkey") % 17 == 0, start).when(F.col("o_orderkey") % 5 == 0, start + 2).cast("int").alias("version_end"),
    )


ORDER_VERSIONS_SQL = """
versions AS (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
  CASE WHEN o_orderkey % 17 = 0 THEN 'REMOVED' ELSE 'ADDED' END AS status,
  CAST(CASE WHEN o_orderkey % 19 != 0 THEN year(o_orderdate) - 1990 END AS INTEGER) AS version_start,
  CAST(CASE WHEN o_orderkey % 17 = 0 THEN year(o_orderdate) - 1990 WHEN o_orderkey % 5 = 0 THEN year(o_orderdate) - 1988 END AS INTEGER) AS version_end
  FROM orders)
"""
