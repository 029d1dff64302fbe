"""Searches, loads and points along lines on small cases."""

import pytest
from pyspark.sql import functions as F

from waylake.functions import geo
from waylake.operators import fetch, loads, search


def line(points):
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in points])


# fixed values: a line and its points every 100 m, and in five equal parts
PATH = [(144.9566710, -37.8183120), (144.9590574, -37.8176138), (144.9585924, -37.8166727)]
EVERY = [(144.9566710, -37.8183120), (144.9577386, -37.8179997), (144.9588061, -37.8176873), (144.9587409, -37.8169732), (144.9585924, -37.8166727)]
FIVE = [(144.9566710, -37.8183120), (144.9573881, -37.8181022), (144.9581053, -37.8178924), (144.9588224, -37.8176826), (144.9588707, -37.8172355), (144.9585924, -37.8166727)]


@pytest.mark.parametrize(
    "options, expected",
    [
        ({"interval": 0.1}, EVERY),
        ({"interval": 0.1, "end": False}, EVERY[:-1]),
        ({"parts": 5}, FIVE),
        ({"parts": 5, "end": False}, FIVE),
        ({"parts": 10, "least": 0.1}, EVERY),
    ],
)
def test_along(spark, options, expected):
    found = spark.range(1).select(search.along(line(PATH), **options).alias("p")).first()["p"]
    assert len(found) == len(expected)
    for p, (x, y) in zip(found, expected):
        gap = spark.range(1).select(geo.haversine_km(F.lit(p["x"]), F.lit(p["y"]), F.lit(x), F.lit(y)).alias("km")).first()["km"]
        assert gap < 1e-4


def test_along_short_lines(spark):
    one = spark.range(1).select(search.along(line(PATH[:1]), 0.1).alias("p")).first()["p"]
    assert len(one) == 1
    still = spark.range(1).select(search.along(line([PATH[0], PATH[0]]), 0.1).alias("p")).first()["p"]
    assert len(still) == 2
    none = spark.range(1).select(search.along(F.array().cast(geo.LINE), 0.1).alias("p")).first()["p"]
    assert none is None


def test_nearby_paths(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 3.0), (4, 1, 1.0), (3, 5, 1.0), (1, 1, 0.5)], "src long, dst long, km double")
    starts = spark.createDataFrame([(1,)], "node long")
    targets = spark.createDataFrame([(1,), (3,), (4,), (5,)], "node long")

    def found(direction, km):
        return {r["node"]: (r["km"], r["path"]) for r in search.nearby(e, starts, targets, km, direction).collect()}

    assert found("forward", 2.5) == {3: (2.0, [1, 2, 3])}
    assert found("forward", 3.0) == {3: (2.0, [1, 2, 3]), 5: (3.0, [1, 2, 3, 5])}
    assert found("backward", 2.0) == {4: (1.0, [1, 4])}
    assert found("any", 2.0) == {3: (2.0, [1, 2, 3]), 4: (1.0, [1, 4])}


def test_signals_and_roundabouts(spark):
    tags = spark.createDataFrame([(1, {"highway": "traffic_signals"}), (2, {"traffic_signals": "yes"}), (3, {"highway": "stop"}), (4, None)], "id long, tags map<string,string>")
    assert {r["id"] for r in tags.where(search.has_signal(F.col("tags"))).collect()} == {1, 2}
    ways = spark.createDataFrame(
        [(10, [1, 2, 3], {"junction": "roundabout"}), (11, [3, 4], {"junction": "roundabout"}), (12, [4, 5], {})], "id long, nodes array<long>, tags map<string,string>"
    )
    centroids = spark.createDataFrame([(1,), (3,), (4,), (5,)], "node long")
    assert {tuple(r) for r in search.roundabout_groups(ways, centroids).select("node", "cluster").collect()} == {(1, 1), (3, 1), (4, 1)}


def test_longest_first(spark):
    lines = F.array(line([(0.0, 0.0), (0.1, 0.0)]), line([(0.0, 0.0), (0.5, 0.0)]), line([(0.0, 0.0), (0.0, 0.0)]))
    found = spark.range(1).select(search.longest_first(lines).alias("l")).first()["l"]
    assert [v[1]["x"] for v in found] == [0.5, 0.1, 0.0]


def test_load_modes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "id long, v string")
    assert {tuple(r) for r in loads.load(old, new, ["id"], "nothing").collect()} == {(1, "a"), (2, "b"), (3, None), (4, "d")}
    known = spark.createDataFrame([("c",), ("c",)], "k string")
    assert {tuple(r) for r in loads.load(old, new, ["id"], "error", [("v", known, "k")]).collect()} == {(1, "a"), (2, "c")}
    with pytest.raises(ValueError):
        loads.load(old, new, ["id"], "other")
    with pytest.raises(ValueError):
        loads.not_empty(old.where("id > 9"), "old")


def test_prefixes_are_literal(spark):
    ids = spark.createDataFrame([("VICMAP_TRANSPORT&&WAY&&1",), ("VICMAPXTRANSPORT&&WAY&&2",), (None,)], "id string")
    assert ids.where(fetch.has_prefix(F.col("id"), ("VICMAP_TRANSPORT",), "WAY")).count() == 1
    with pytest.raises(ValueError):
        fetch.graph_rows(ids.selectExpr("id feature_id", "1 version_start", "null version_end"), ids, "rail")


def test_unreadable_nodes_are_left_out(spark):
    rows = spark.createDataFrame(
        [("a", "LINE", {"nodes": '["x", "y"]'}, None), ("b", "LINE", {"nodes": "oops"}, None), ("c", "LINE", {}, None), ("d", "LINE", None, None), ("e", "POINT", None, '{"coordinates":[1.5,2]}'), ("f", "POINT", None, None)],
        "feature_id string, feature_type string, tags map<string,string>, geometry string",
    )
    ways, points = fetch.elements(rows)
    assert [(r["id"], r["nodes"]) for r in ways.collect()] == [("a", ["x", "y"])]
    assert [tuple(r) for r in points.collect()] == [("e", 1.5, 2.0)]


def test_copies_have_one_value_of_a_name(spark):
    features = spark.createDataFrame([("OSM&&WAY&&1", "LINE", "OSM", 1, None, "c")], "feature_id string, feature_type string, layer_id string, version_start int, version_end int, changeset_id string")
    rows = [("OSM&&WAY&&1", "name", v, 1, None, "c") for v in ("b", "a b", None)] + [("OSM&&WAY&&1", "ref", None, 1, None, "c")]
    tags = spark.createDataFrame(rows, "feature_id string, s_name string, s_value string, version_start int, version_end int, changeset_id string")
    copied = loads.derived_copy(features, tags, spark.createDataFrame([], "feature_id string"), 7, "set-7")[1]
    assert sorted((r["s_name"], r["s_value"], r["version_start"]) for r in copied.collect()) == [("name", "b", 7), ("ref", None, 7)]


def test_priorities_broadcast_no_rows_of_paths(spark, tmp_path):
    """Paths are far more rows than their bytes make Spark expect, so they are shuffled."""
    from waylake.operators import paths

    p = spark.createDataFrame([(k, [k % 5, 10, 11, 12, 13, 20]) for k in range(40)] + [(90, [7, 7, 8]), (91, [10])], "path_id long, nodes array<long>")
    p.write.parquet(str(tmp_path / "paths"))
    p = spark.read.parquet(str(tmp_path / "paths"))  # of known size, a small one
    rows = paths.path_steps(p).withColumn("km", F.lit(0.5))
    centres = spark.createDataFrame([(13, 1), (20, 2), (8, 3)], "node long, intersection long")
    moves = spark.createDataFrame([(1, 10, 12, 5), (1, 10, 13, 6), (2, 13, 20, 4), (3, 7, 8, 2)], "intersection long, in_node long, out_node long, priority int")
    reached = paths.distances(rows, centres)
    assert {tuple(r)[1:] for r in reached.where("path_id < 90").collect()} == {(1, 4, 2.0), (2, 5, 2.5)}
    found = paths.priorities(p, reached, moves, centres)
    # 5 from node 10 to 12, as 13 is a centre; too late at 13; the stop at the start isn't one
    assert {tuple(r)[1:] for r in found.where("path_id < 90").collect()} == {(1, 5), (2, 0)} and found.where("path_id >= 90").count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 3 and "BroadcastHashJoin [path_id" not in plan
