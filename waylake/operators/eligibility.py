"""Which features take part in matching (C13, C14): one pivot per feature, then plain predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: feature types that keep a class out, or that a class needs
NO_ROAD = ("connector", "ford")


def feature_flags(features: DataFrame, attributes: DataFrame, key: str = "id") -> DataFrame:
    """Per feature its class, road type, the set of its feature types, and whether any attribute is 'track'."""
    name, value = F.col("s_name"), F.col("s_value")
    flags = attributes.groupBy(key).agg(
        F.max(F.when(name == "class_code", value)).cast("int").alias("cls"),
        F.collect_set(F.when(name == "feature_type_code", value)).alias("types"),
        F.max(F.when(name == "road_type", value)).alias("road_type"),
        F.max(value == "track").alias("any_track"),
    )
    return features.join(flags, key, "left")


def _none_of(*types: str) -> Column:
    """No feature type among these; a feature without a type passes."""
    return ~F.arrays_overlap(F.coalesce("types", F.array().cast("array<string>")), F.array(*map(F.lit, types)))


def _some_of(*types: str) -> Column:
    return F.arrays_overlap(F.coalesce("types", F.array().cast("array<string>")), F.array(*map(F.lit, types)))


def road() -> Column:
    cls, no_track = F.col("cls"), ~F.coalesce("any_track", F.lit(False))
    return F.coalesce(
        (cls.between(0, 4) & _none_of(*NO_ROAD))
        | ((cls == 5) & _none_of(*NO_ROAD) & no_track)
        | ((cls == 6) & _none_of(*NO_ROAD, "tunnel") & no_track)
        | ((cls == 7) & _none_of(*NO_ROAD, "bridge") & no_track & (F.col("name") != "UNNAMED"))
        | ((cls == 13) & _some_of("road")),
        F.lit(False),
    )


def trail() -> Column:
    cls, track = F.col("cls"), F.coalesce(F.col("road_type") == "track", F.lit(False))
    return F.coalesce(
        ((cls == 9) & _some_of("trail", "tunnel"))
        | ((cls == 8) & _some_of("bridge", "road"))
        | ((cls == 7) & _some_of("bridge"))
        | (cls.isin(6, 7) & _some_of("road") & track)
        | (cls.isin(5, 6) & _some_of("bridge") & track)
        | ((cls == 6) & _some_of("tunnel")),
        F.lit(False),
    )


def match_report(features: DataFrame, relationships: DataFrame) -> DataFrame:
    """Total, matched, failed and rate of a layer in one pass.

    ``features`` come from feature_flags(); excluded are classes 0-7 that are connectors or fords, class 8
    that is neither bridge nor road, class 9 that is neither trail nor tunnel, and class 13 that is no road.
    """
    cls = F.col("cls")
    no_types = F.size(F.coalesce("types", F.array().cast("array<string>"))) == 0
    excluded = (
        (cls.between(0, 7) & _some_of(*NO_ROAD))
        | ((cls == 8) & ~no_types & _none_of("bridge", "road"))
        | ((cls == 9) & ~no_types & _none_of("trail", "tunnel"))
        | ((cls == 13) & ~no_types & _none_of("road"))
    )
    matched = relationships.where(F.size(F.array_remove("matched", "")) > 0).select("id").distinct().withColumn("_m", F.lit(1))
    counted = features.where(~F.coalesce(excluded, F.lit(False))).join(matched, "id", "left")
    out = counted.groupBy("layer_id").agg(F.count("*").alias("total"), F.count("_m").alias("matched"))
    return out.select("layer_id", "total", "matched", (F.col("total") - F.col("matched")).alias("failed"), F.round(F.col("matched") / F.col("total"), 6).alias("rate"))
