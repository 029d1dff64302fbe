"""Stored features and attributes as the rows and elements of a road graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from waylake.operators import eav
from waylake.operators.versions import is_latest

# Highway values of trails, and those that keep a way out of the road graph.
TRAIL_HIGHWAYS = ("cycleway", "footway", "pedestrian", "track")
NOT_ROAD_HIGHWAYS = ("cycleway", "footway", "pedestrian", "track", "circular", "roundabout")

#: Id prefixes of the original graph and of the derived one, which holds split ways beside the others.
ORIGINAL = ("OSM",)
DERIVED = ("OSM", "DTP")

ROW = ("feature_id", "tags", "feature_type", "layer_id", "s_name", "s_source_id", "geometry")


def geometry_kind(element: Column) -> Column:
    """POINT for a node, LINE for a way, null for anything else."""
    return F.when(element == "node", "POINT").when(element == "way", "LINE")


def has_prefix(feature_id: Column, prefixes: Sequence[str], middle: str = "") -> Column:
    """Whether an id starts with one of the prefixes, '&&' and ``middle``, compared literally."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | feature_id.startswith(f"{p}&&{middle}")
    return hit


def way_kind(attributes: DataFrame, prefixes: Sequence[str] = ORIGINAL) -> DataFrame:
    """(feature_id, tags, is_trail, is_road) of ways with current attributes, by one aggregation."""
    highway = lambda values: F.coalesce(F.bool_or((F.col("s_name") == "highway") & F.col("s_value").isin(*values)), F.lit(False))
    ways = attributes.where(is_latest() & has_prefix(F.col("feature_id"), prefixes, "WAY"))
    return ways.groupBy("feature_id").agg(
        eav.collected_tags().alias("tags"), highway(TRAIL_HIGHWAYS).alias("is_trail"), (~highway(NOT_ROAD_HIGHWAYS)).alias("is_road")
    )


def graph_rows(features: DataFrame, attributes: DataFrame, kind: str, prefixes: Sequence[str] = ORIGINAL) -> DataFrame:
    """The current rows of a 'road', 'trail' or 'full' graph; nodes come without tags in the first two.

    features: feature_id, feature_type, layer_id, s_name, s_source_id, geometry, version_start, version_end;
    attributes: feature_id, s_name, s_value, version_start, version_end. Of several current values
    of a name one stays: the largest.
    """
    current = features.where(is_latest())
    if kind == "full":
        tags = eav.tag_map(attributes.where(is_latest()), "feature_id")
        return current.where(has_prefix(F.col("feature_id"), prefixes)).join(tags, "feature_id", "left").select(*ROW)
    if kind not in ("road", "trail"):
        raise ValueError(f"unknown kind of graph: {kind}")
    ways = way_kind(attributes, prefixes).where(f"is_{kind}").select("feature_id", "tags")
    lines = current.join(ways, "feature_id").select(*ROW)
    named = ways.select(F.explode(node_ids(F.col("tags")["nodes"])).alias("feature_id"))
    points = current.join(named, "feature_id", "left_semi").withColumn("tags", F.lit(None).cast("map<string,string>")).select(*ROW)
    return lines.unionByName(points)


def node_ids(text: Column) -> Column:
    """The ids in a list as text, with or without quotes: '["a", "b"]'."""
    bare = F.split(F.regexp_replace(text, r"\[|\]", ""), ",")
    return F.transform(bare, lambda t: F.regexp_replace(F.trim(t), '^"+|"+$', ""))


def elements(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ways, nodes) of a graph: (id, nodes, tags) and (id, x, y).

    Ways without a list of nodes that can be read are left out, and so are points without coordinates.
    """
    listed = F.from_json(F.col("tags")["nodes"], "array<string>")
    ways = rows.where("feature_type = 'LINE'").select(F.col("feature_id").alias("id"), listed.alias("nodes"), "tags").where("nodes is not null")
    place = F.from_json("geometry", "struct<coordinates:array<double>>")["coordinates"]
    points = rows.where("feature_type = 'POINT'").select(F.col("feature_id").alias("id"), F.get(place, 0).alias("x"), F.get(place, 1).alias("y"))
    return ways, points.where("x is not null and y is not null")
