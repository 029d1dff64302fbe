"""Text forms of geometries, recomputed relationships, edits and small searches."""

import json

import pytest
from pyspark.sql import functions as F

from waylake.functions import geo
from waylake.functions.geo import LINE
from waylake.operators import eav, graph, overlay, relationships, versions


def test_wkt_is_read(spark):
    texts = ["POINT (1 2)", "POINT Z (1 2 3)", "LINESTRING(1 2, 3.5 -4e1)", "SRID=4326;POLYGON ((0 0, 1 0, 1 1, 0 0), (.2 .1, .3 .1, .3 .2, .2 .1))", "MULTIPOINT ((1 2), (3 4))", "MULTIPOINT (1 2, 3 4)",
             "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "LINESTRING EMPTY", "CIRCLE (1 2)", "no text", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(geo.from_wkt(F.col("t")).alias("g")).collect()
    got = [None if r["g"] is None else (r["g"]["type"], [[(p["x"], p["y"]) for p in line] for line in r["g"]["lines"]]) for r in rows]
    assert got[0] == got[1] == ("POINT", [[(1, 2)]]) and got[2] == ("LINESTRING", [[(1, 2), (3.5, -40)]])
    assert [len(x) for x in got[3][1]] == [4, 4] and got[3][1][1][0] == (0.2, 0.1)
    assert got[4] == got[5] == ("MULTIPOINT", [[(1, 2)], [(3, 4)]])
    assert len(got[6][1]) == len(got[7][1]) == 2 and got[8] == ("LINESTRING", []) and got[9:] == [None, None, None]


def test_recomputed_relationships(spark):
    line = [(0.2, 0.1), (2.4, 0.1)]
    rows = [(1, line, [[(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)], [(1.0, 0.0), (3.0, 0.0)]]), (2, line, [[(0.0, 0.0), (1.0, 0.0)], [(1.5, 0.0), (3.0, 0.0)]]), (3, line, []), (4, None, [line]), (5, line, None)]
    df = spark.createDataFrame(rows, f"input_id long, line {LINE}, ways array<{LINE}>")
    found = {r["input_id"]: r for r in relationships.recomputed(df).collect()}
    assert found[1]["type"] == "LineString" and [(round(p["x"], 6), p["y"]) for p in found[1]["parts"][0]] == [(0.2, 0.0), (0.5, 0.0), (1.0, 0.0), (2.4, 0.0)]
    assert 10_000 < found[1]["error"] < 12_000  # a tenth of a degree apart
    assert found[2]["type"] == "MultiLineString" and len(found[2]["parts"]) == 2 and found[2]["error"] > 0
    assert all(found[k]["type"] is None and found[k]["error"] is None for k in (3, 4, 5))


def test_the_shared_vertex_goes_to_the_start_side():
    way = [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 0.0)]
    assert relationships.nearest_ends([(0.9, 0.1), (1.1, 0.1)], way) == (1, 0)
    assert relationships.nearest_ends([(1.1, 0.1), (0.9, 0.1)], way) == (1, 2)
    assert relationships.nearest_ends([(0.1, 0.1), (0.2, 0.1)], way) == (0, 1)
    assert relationships.nearest_ends([(2.9, 0.1), (2.8, 0.1)], way) == (3, 2)


def test_area_to_parts(spark):
    line = [(144.0, -37.0), (144.02, -37.0)]
    part = lambda dy, x1=144.0, x2=144.02: [(x1, -37.0 + dy), (x2, -37.0 + dy)]
    df = spark.createDataFrame([(1, line, [part(0.001)]), (2, line, [part(0.001), part(0.003)]), (3, line, [])], f"pair long, a {LINE}, parts array<{LINE}>")
    found = {r["pair"]: r["error"] for r in overlay.area_to_parts(df).collect()}
    assert found[1] == pytest.approx(111.0, rel=0.01) and found[2] == pytest.approx(222.0, rel=0.01) and found[3] is None


def test_several_edits_of_a_key(spark):
    rows = spark.createDataFrame([("a", "n", "old", 2)], "feature_id string, s_name string, s_value string, changeset_id int")
    edits = spark.createDataFrame([("a", "n", "x", "UPDATE", 1), ("a", "n", "y", "UPDATE", 2), ("b", "n", "z", "NEW", 1)], "feature_id string, s_name string, s_value string, action string, at int")
    done = versions.apply_edits(rows, edits, ["feature_id", "s_name"], ["s_value"], 2, order="at").collect()
    assert sorted((r["feature_id"], r["s_value"]) for r in done) == [("a", "y"), ("b", "z")]
    with pytest.raises(Exception, match="several edits of one key"):
        versions.apply_edits(rows, edits, ["feature_id", "s_name"], ["s_value"], 2).collect()


def test_repeated_names_in_tags(spark):
    df = spark.createDataFrame([("f", "name", "a"), ("f", "name", "b"), ("f", None, "x"), ("f", "kind", None), ("g", None, None)], "feature_id string, s_name string, s_value string")
    found = {r["feature_id"]: r["tags"] for r in eav.tag_map(df, "feature_id").collect()}
    assert found == {"f": {"name": "b", "kind": None}, "g": {}}


def test_intersection_features(spark):
    df = spark.createDataFrame([("u1", "simple", [1]), ("u2", "complex", [2, 3])], "uid string, type string, nodes array<long>")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0), (3, 3.0, 2.0)], "id long, x double, y double")
    found = {r["uid"]: json.loads(r["feature"]) for r in graph.intersection_features(df, nodes).collect()}
    assert found["u2"]["geometry"] == {"type": "MultiPoint", "coordinates": [[1.0, 1.0], [3.0, 2.0]]}
    assert found["u2"]["properties"] == {"uid": "u2", "type": "complex", "nodes": [2, 3], "centre": [2.0, 1.5]}


def test_edited_geometry(spark):
    edits = spark.createDataFrame([("i", ["w1", "w2"]), ("j", ["w3", "nowhere"]), ("k", [])], "input_id string, matched array<string>")
    ways = [("w1", [(0.0, 0.0), (1.0, 0.0)]), ("w2", [(1.0, 0.0), (3.0, 0.0)]), ("w3", [(0.0, 1.0), (3.0, 1.0)])]
    lines = [(i, [(0.2, y), (2.4, y)]) for i, y in (("i", 0.1), ("j", 1.1), ("k", 0.0))]
    schema = f"id string, line {LINE}"
    found = {r["input_id"]: r for r in relationships.edited_geometry(edits, spark.createDataFrame(lines, schema), spark.createDataFrame(ways, schema)).collect()}
    assert found["i"]["type"] == found["j"]["type"] == "LineString" and found["k"]["type"] is None and found["i"]["matched"] == ["w1", "w2"]
    assert [round(p["x"], 6) for p in found["j"]["parts"][0]] == [0.2, 2.4]
