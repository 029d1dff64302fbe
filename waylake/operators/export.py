"""Documents for export: OSM JSON elements, GeoJSON features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DEGREES = "decimal(9,6)"


def way_elements(ways: DataFrame) -> DataFrame:
    """(id, element) of LINE features; ways: id, parent_id, nodes, matched_id, tags. Ways without nodes are left out."""
    fields = F.struct(
        F.col("id"), F.coalesce("parent_id", "id").alias("way_id"), F.lit("way").alias("type"), F.lit(False).alias("manual_edit"),
        F.col("nodes"), F.col("matched_id").alias("source_matched_id"), F.col("tags"),
    )
    return ways.where(F.size("nodes") > 0).select("id", F.to_json(fields).alias("element"))


def node_elements(nodes: DataFrame) -> DataFrame:
    """(id, element) of POINT features; nodes: id, x, y."""
    at = lambda c: F.col(c).cast(DEGREES)
    fields = F.struct(F.col("id"), F.lit("node").alias("type"), F.lit(False).alias("manual_edit"), at("x").alias("lon"), at("y").alias("lat"))
    return nodes.select("id", F.to_json(fields).alias("element"))


def header(version: str | None, changeset: int, date: str) -> str:
    """The document's first line; the version ends with the layer's approved one, or 1.0."""
    import json

    return json.dumps({"version": version or "1.0", "changeset": changeset, "date": date})


def write_document(elements: DataFrame, path: str, head: str) -> None:
    """Elements as JSON lines in many part files, with the header beside them: no task holds the whole document."""
    elements.select(F.col("element").alias("value")).write.mode("overwrite").text(f"{path}/elements")
    elements.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def publish_document(elements: DataFrame, base: str, date: str, head: str) -> None:
    """The document under its date, and the same under ``latest``, copied from what was written."""
    write_document(elements, f"{base}/{date}", head)
    written = elements.sparkSession.read.text(f"{base}/{date}/elements").withColumnRenamed("value", "element")
    write_document(written, f"{base}/latest", head)


def point_feature(key: Column, x: Column, y: Column, properties: Column) -> Column:
    """A GeoJSON feature of a point."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x.cast(DEGREES), y.cast(DEGREES)).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), key.alias("id"), geometry.alias("geometry"), properties.alias("properties")))


def line_feature(key: Column, line: Column, properties: Column) -> Column:
    """A GeoJSON feature of a line (array of x, y)."""
    coordinates = F.transform(line, lambda p: F.array(p["x"].cast(DEGREES), p["y"].cast(DEGREES)))
    geometry = F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), key.alias("id"), geometry.alias("geometry"), properties.alias("properties")))


def export_view(features: DataFrame, tags: DataFrame, relationships: DataFrame, source_tags: DataFrame) -> DataFrame:
    """Features with their own tags, the inputs matched to them, and those inputs' tags.

    A way that k inputs match has k rows. features: id; tags: id, tags; relationships: input_id, matched;
    source_tags: input_id, source_tags.
    """
    matched = relationships.select("input_id", F.explode("matched").alias("id"))
    return features.join(tags, "id").join(matched, "id", "left").join(source_tags, "input_id", "left")
