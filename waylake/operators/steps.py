"""The steps of a run, each from tables to tables: import, match, look up, export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from waylake.functions import geo
from waylake.functions.storage import materialise
from waylake.operators import eav, export, loads, overlay, relationships, trellis, versions
from waylake.sources.readers import Layer, reshape


def import_layer(features: DataFrame, attributes: DataFrame, staged: DataFrame, layer: Layer) -> tuple[DataFrame, DataFrame]:
    """(feature changes, attribute changes) between a layer as it is stored and a new download of it.

    features: feature_id, layer_id, join_key and version columns; attributes: feature_id, s_name, user_edit, join_key and
    version columns. Changes are (feature_id, status) and (feature_id, s_name, s_value, status). Attributes that a user
    edited, and those of protected names, aren't touched. A feature with changed attributes is MODIFIED.
    """
    new_features, new_attributes = (materialise(df, "staged") for df in reshape(staged, layer))
    mine = features.where(versions.is_latest() & (F.col("layer_id") == layer.id)).select("feature_id", "join_key")
    changes = versions.classify(mine, new_features, ["feature_id"], "join_key").select("feature_id", "status")
    held = attributes.join(mine.select("feature_id"), "feature_id", "left_semi").where(versions.is_latest())
    open_ = loads.unprotected(held).select("feature_id", "s_name", "join_key")
    kept = held.select("feature_id", "s_name").join(open_.select("feature_id", "s_name"), ["feature_id", "s_name"], "left_anti")
    offered = new_attributes.join(kept, ["feature_id", "s_name"], "left_anti")
    moved = versions.classify(open_, offered, ["feature_id", "s_name"], "join_key").select("feature_id", "s_name", "status")
    moved = materialise(moved.join(offered.select("feature_id", "s_name", "s_value"), ["feature_id", "s_name"], "left").select("feature_id", "s_name", "s_value", "status"), "attribute-changes")
    return versions.roll_up(changes, moved, "feature_id"), moved


def import_layers(features: DataFrame, attributes: DataFrame, staged: Mapping[str, DataFrame], layers: Mapping[str, Layer], order: Sequence[str]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """import_layer() for each layer in order, as sources.config.load_order() gives it; one that has no rows is an error."""
    return {name: import_layer(features, attributes, loads.not_empty(staged[name], name), layers[name]) for name in order}


def lines_of_nodes(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, parts): lists of lists of nodes (id, parts) as lines; nodes: id, x, y."""
    each = parts.select("id", F.posexplode("parts").alias("part", "nodes")).select("id", "part", F.posexplode("nodes").alias("k", "node"))
    placed = each.join(nodes.select(F.col("id").alias("node"), "x", "y"), "node")
    line = placed.groupBy("id", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x", "y"))), lambda p: F.struct(p["x"], p["y"])).alias("line"))
    return line.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "line"))), lambda p: p["line"]).alias("parts"))


def match_layer(features: DataFrame, ways: DataFrame, nodes: DataFrame, radius_km: float = 0.02, size: float = 0.02) -> DataFrame:
    """Relationships of a layer's lines (id, parts, both_ways) with the ways of a graph (Z3): input_id, matched, geometry (the
    matched lines), error (to the line's first part, or the mean over parts), join_key. Lines that don't match have nulls."""
    found = materialise(trellis.match_parts(features, ways, nodes, radius_km, size), "layer-matches")
    drawn = materialise(lines_of_nodes(found.where("parts is not null").select("id", "parts"), nodes), "layer-lines")
    pairs = features.select(F.col("id").alias("pair"), F.flatten("parts").alias("a")).join(drawn.select(F.col("id").alias("pair"), "parts"), "pair")
    single = overlay.area_between(pairs.where(F.size("parts") == 1).select("pair", "a", F.col("parts")[0].alias("b"))).select("pair", "error")
    several = overlay.area_to_parts(pairs.where(F.size("parts") > 1)).select("pair", "error")
    rows = found.select("id", F.transform("ways", lambda w: w.cast("string")).alias("matched")).join(drawn.withColumnRenamed("parts", "geometry"), "id", "left")
    rows = rows.join(single.union(several).withColumnRenamed("pair", "id"), "id", "left")
    text = F.array_join(F.transform("geometry", lambda line: geo.wkt_line(line)), "; ")
    return rows.select(F.col("id").alias("input_id"), "matched", "geometry", "error", relationships.relationship_key(text, F.col("error"), F.col("id"), F.col("matched")).alias("join_key"))


def way_lookups(attributes: DataFrame) -> DataFrame:
    """(feature_id, nodes, tags): the list of nodes of each way as text, and its other current attributes as a map."""
    current = attributes.where(versions.is_latest())
    nodes = F.max(F.when(F.col("s_name") == "nodes", F.col("s_value"))).alias("nodes")
    return current.groupBy("feature_id").agg(nodes, eav.collected_tags(F.col("s_name") != "nodes").alias("tags"))


def place_in_line(line: Column, x: Column, y: Column) -> Column:
    """Number from 1 of the first point of a line that is exactly (x, y); 0 if none is, null without a line."""
    return F.array_position(F.transform(line, lambda p: (p["x"] == x) & (p["y"] == y)), True)


def export_step(features: DataFrame, tags: DataFrame, matches: DataFrame, source_tags: DataFrame, base: str, date: str, head: str) -> None:
    """The export view of a layer as a JSON document under its date and under latest."""
    view = export.export_view(features, tags, matches, source_tags)
    export.publish_document(view.select(F.to_json(F.struct("*")).alias("element")), base, date, head)
