"""Steps from tables to tables."""

import json

import pytest
from pyspark.sql import functions as F

from waylake.functions.geo import LINE
from waylake.operators import steps
from waylake.sources.readers import Layer, reshape

LAYER = Layer("ROADS", "LINE", "name", "ufi", ("name", "kind", "lanes"), drop_nulls=True)
SCHEMA = "ufi string, geometry string, name string, kind string, lanes string"


def stored(spark, rows):
    features, attributes = reshape(spark.createDataFrame(rows, SCHEMA), LAYER)
    version = {"version_start": F.lit(1), "version_end": F.lit(None).cast("int")}
    return features.withColumns({**version, "layer_id": F.lit("ROADS")}), attributes.withColumns({**version, "user_edit": F.when(F.col("s_value") == "mine", F.lit(True))})


def test_import(spark):
    features, attributes = stored(spark, [("1", "g1", "a", "x", None), ("2", "g2", "b", "x", "2"), ("3", "g3", "c", "mine", None), ("4", "g4", "d", None, None)])
    staged = spark.createDataFrame([("1", "g1", "a", "x", None), ("2", "g2", "b", "y", "2"), ("3", "g3", "c", "z", None), ("5", "g5", "e", "x", None)], SCHEMA)
    changes, moved = steps.import_layer(features, attributes, staged, LAYER)
    assert {(r["feature_id"], r["status"]) for r in changes.collect()} == {("ROADS&&2", "MODIFIED"), ("ROADS&&4", "REMOVED"), ("ROADS&&5", "ADDED")}
    got = {(r["feature_id"][-1], r["s_name"], r["s_value"], r["status"]) for r in moved.collect()}
    assert got == {("2", "kind", "y", "MODIFIED"), ("4", "name", None, "REMOVED"), ("5", "name", "e", "ADDED"), ("5", "kind", "x", "ADDED")}
    several = steps.import_layers(features, attributes, {"ROADS": staged}, {"ROADS": LAYER}, ["ROADS"])
    assert several["ROADS"][0].count() == 3
    with pytest.raises(ValueError):
        steps.import_layers(features, attributes, {"ROADS": staged.limit(0)}, {"ROADS": LAYER}, ["ROADS"])


def test_match_layer(spark):
    nodes = [(k, 144.9 + k * 0.001, -37.8) for k in range(5)]
    ways = [(1, [0, 1, 2], False, False), (2, [2, 3, 4], False, False)]
    line = [(144.9 + k * 0.001, -37.80005) for k in (0.2, 1.5, 2.5, 3.8)]
    features = spark.createDataFrame([(7, [line], False), (8, [[(0.0, 0.0), (0.1, 0.0)]], False)], f"id long, parts array<{LINE}>, both_ways boolean")
    args = spark.createDataFrame(ways, "id long, nodes array<long>, oneway boolean, reverseway boolean"), spark.createDataFrame(nodes, "id long, x double, y double")
    found = {r["input_id"]: r for r in steps.match_layer(features, *args).collect()}
    assert found[7]["matched"] == ["1", "2"] and [p["x"] for p in found[7]["geometry"][0]] == [x for _, x, _ in nodes]
    assert 3 < found[7]["error"] < 7 and found[7]["join_key"] != found[8]["join_key"]
    assert found[8]["matched"] is None and found[8]["geometry"] is None and found[8]["error"] is None


def test_lookups_and_places(spark):
    rows = [("w", "nodes", "[1, 2]", 1, None), ("w", "name", "a", 1, None), ("w", "old", "b", 1, 2), ("v", "name", "c", 1, None)]
    df = spark.createDataFrame(rows, "feature_id string, s_name string, s_value string, version_start int, version_end int")
    found = {r["feature_id"]: (r["nodes"], r["tags"]) for r in steps.way_lookups(df).collect()}
    assert found == {"w": ("[1, 2]", {"name": "a"}), "v": (None, {"name": "c"})}
    line = spark.createDataFrame([([(0.1, 0.2), (0.3, 0.4), (0.3, 0.4)],)], f"line {LINE}")
    at = lambda x, y: steps.place_in_line(F.col("line"), F.lit(x), F.lit(y))
    assert tuple(line.select(at(0.3, 0.4), at(0.1, 0.2), at(0.1, 0.4)).first()) == (2, 1, 0)


def test_export_step(spark, tmp_path):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    steps.export_step(
        make([("a",), ("b",)], "id string"), make([("a", {"k": "v"}), ("b", {})], "id string, tags map<string,string>"), make([("i", ["a"])], "input_id string, matched array<string>"),
        make([("i", {"n": "x"})], "input_id string, source_tags map<string,string>"), str(tmp_path), "2025-01-01", '{"version":1}',
    )
    for folder in ("2025-01-01", "latest"):
        rows = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/{folder}/elements").collect()]
        assert {r["id"]: r.get("source_tags") for r in rows} == {"a": {"n": "x"}, "b": None}
