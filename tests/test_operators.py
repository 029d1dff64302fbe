"""Golden values and edge cases of operators."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from waylake.functions import geo
from waylake.operators import congestion, graph, matching, polygons, resolve, spatial, splitting, versions
from waylake.sources import readers
from waylake.streaming import windows

LATS = [-37.81, -37.815, -37.82, -37.825, -37.83, -37.815, -37.82, -37.82]
LONS = [144.96] * 5 + [144.97, 144.97, 144.98]
WAYS = [(2001, [1001, 1002, 1003, 1004], False, False), (2002, [1001, 1006, 1007, 1004], False, False), (2003, [1004, 1005], False, False), (2004, [1008, 1007], True, False)]
LS1 = [(144.97816, -37.82023), (144.97434, -37.82009), (144.97108, -37.81958), (144.96863, -37.82012), (144.96559, -37.82189), (144.96271, -37.82399),
       (144.95992, -37.82545), (144.95906, -37.82463), (144.95928, -37.82223), (144.95954, -37.81958), (144.95958, -37.81602), (144.95945, -37.81300)]
LS2 = [(144.96962, -37.81643), (144.96958, -37.81490), (144.96516, -37.81233), (144.96052, -37.81012), (144.96035, -37.81195), (144.96044, -37.81328)]
WAY_SCHEMA = "id long, nodes array<long>, oneway boolean, reverseway boolean"


@pytest.fixture(scope="module")
def coarse(spark):
    nodes = spark.createDataFrame([(1001 + i, x, y) for i, (x, y) in enumerate(zip(LONS, LATS))], "id long, x double, y double")
    return spark.createDataFrame(WAYS, WAY_SCHEMA), nodes


def test_matching(spark, coarse):
    ways, nodes = coarse
    lines = spark.createDataFrame([("ls1", LS1), ("ls2", LS2), ("far", [(10.0, 10.0), (10.1, 10.1)]), ("dot", [(144.96, -37.81)])], f"id string, line {geo.LINE}")
    found = {r["line_id"]: r for r in matching.match_lines(lines, ways, nodes, 0.1).collect()}
    assert list(found["ls1"]["nodes"]) == [1008, 1007, 1004, 1003, 1002, 1001] and list(found["ls1"]["ways"]) == [2004, 2002, 2001]
    assert list(found["ls2"]["nodes"]) == [1007, 1006, 1001, 1002] and list(found["ls2"]["ways"]) == [2002, 2001]
    assert abs(found["ls1"]["cost"] - 211.00) < 0.01 and abs(found["ls2"]["cost"] - 120.72) < 0.01
    assert found["far"]["error"] == found["dot"]["error"] == matching.FAILED


def test_paths_between_edge_points(spark, coarse):
    segs = matching.segments(*coarse).collect()
    roads = matching.Roads([(s["way_id"], s["n1"], s["n2"], s["km"], s["forward"], s["backward"]) for s in segs])
    e1, e2, e3, e4 = (1001, 1002, 0.3), (1007, 1004, 0.6), (1002, 1001, 0.0), (1008, 1007, 0.5)
    path = lambda u, v, cap=1e9: (roads.path(u, v, cap) or (None, None))[1]
    assert path(e1, e2) == [1001, 1002, 1003, 1004, 1007]
    assert path(e1, e2, 1.0) is None
    assert path(e3, e2) == [1002, 1003, 1004, 1007]
    assert path(e1, e3) == [1001, 1002]
    assert path(e4, e2) == [1008, 1007, 1004]
    assert path(e2, e4) is None
    half = next(s["km"] for s in segs if s["n1"] == 1001 and s["n2"] == 1002) / 2
    for goal in ((1001, 1002, 0.8), (1002, 1001, 0.2)):
        km, nodes = roads.path((1001, 1002, 0.3), goal, 1e9)
        assert km == pytest.approx(half) and nodes == [1001, 1002]


def test_tidy_paths():
    assert matching.without_repeats([1, 2, 2, 3, 3, 3, 4, 2, 5, 5, 5]) == [1, 2, 3, 4, 2, 5]
    assert matching.without_repeated_pairs([1, 2, 1, 2, 3, 4, 5, 4, 5, 4, 5]) == [1, 2, 3, 4, 5]
    assert matching.without_detours([1, 2, 5, 2, 3, 4, 5, 6, 5]) == [1, 2, 3, 4, 5]
    assert matching.tidy([1, 2, 1, 2, 2, 3, 3, 2, 4, 3, 4, 3, 4, 5, 6, 7, 6, 8, 9, 8, 9]) == [1, 2, 4, 5, 6, 8, 9]


def test_congestion(spark):
    cases = [(100, 100, 50, 0.1, 0), (75, 100, 50, 2, 75.38), (50, 100, 50, 3, 467.36), (50, 60, 50, 4, 305.88), (75, 100, 10, 4, 30.15), (50, 100, 10, 5, 155.79), (50, 60, 10, 2, 30.59), (0, 100, 0, 0.3, 0)]
    df = spark.createDataFrame([tuple(map(float, c)) for c in cases], "a double, n double, v double, km double, want double")
    got = df.select(congestion.congestion_dollars(F.col("a"), F.col("n"), F.col("v"), F.col("km")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_angles(spark):
    cases = [(10, 30, 10, False), (10, 30, 20, True), (40, -130, 170, True), (40, -130, 169.5, False), (160, -130, 70, True), (160, -130, 69, False)]
    df = spark.createDataFrame([(float(a), float(r), float(b), w) for a, r, b, w in cases], "a double, r double, b double, want boolean")
    assert all(r[0] == r[1] for r in df.select(geo.within_angle(F.col("a"), F.col("r"), F.col("b")), "want").collect())
    c = [F.lit(v) for v in (145.3326838, -38.0751637, 145.3326838, -38.0754637)]
    assert abs(spark.range(1).select(geo.heading(*c)).first()[0]) == pytest.approx(180)
    c = [F.lit(v) for v in (145.3327838, -38.0752637, 145.3328838, -38.0753637)]
    assert spark.range(1).select(geo.heading(*c)).first()[0] == pytest.approx(141.79, abs=0.01)


def test_distance_of_missing_point_is_null(spark):
    assert spark.range(1).select(geo.haversine_km(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0))).first()[0] is None


def test_polygons():
    assert polygons.even_odd_area([(0, 0), (1, 0), (1, 1), (0, 1)]) == pytest.approx(1)
    assert polygons.even_odd_area([(0, 0), (1, 1), (1, 0), (0, 1)]) == pytest.approx(0.5)
    assert polygons.even_odd_area([(0, 0), (1, 0), (0, 1)]) == pytest.approx(0.5)
    assert polygons.even_odd_area([(0, 0), (1, 0), (2, 0)]) == 0
    # a small square: metres per degree at this latitude
    square = [(144.96, -37.81), (144.97, -37.81), (144.97, -37.80), (144.96, -37.80)]
    side = splitting.metres(square[0], square[1]) * splitting.metres(square[1], square[2])
    assert polygons.area_m2(square) == pytest.approx(side, rel=0.01)
    assert polygons.centroid([(0, 0), (1, 0), (1, 1), (0, 1)]) == pytest.approx((0.5, 0.5))
    a = [(144.96, -37.81), (144.97, -37.81)]
    assert polygons.polygon_error(a, a) == pytest.approx(0)
    aside = [(144.96, -37.8101), (144.97, -37.8101)]
    assert polygons.polygon_error(a, aside) == pytest.approx(11.1, rel=0.02)


def test_line_merge(spark):
    assert polygons.merged([[(0, 0), (1, 0)], [(2, 0), (1, 0)]]) in ([[(0, 0), (1, 0), (2, 0)]], [[(2, 0), (1, 0), (0, 0)]])
    fork = [[(0, 0), (1, 0)], [(1, 0), (2, 0)], [(1, 0), (1, 1)]]
    assert len(polygons.merged(fork)) == 3
    df = spark.createDataFrame([("w", 0, [(0.0, 0.0), (1.0, 0.0)]), ("w", 1, [(1.0, 0.0), (2.0, 0.0)])], f"k string, seq int, line {geo.LINE}")
    assert [len(p) for p in polygons.merge_lines(df, "k").first()["parts"]] == [3]


def test_trim_and_split():
    line = [(144.96, -37.81), (144.97, -37.81)]
    cut = splitting.trimmed(line)
    total = splitting.metres(*line)
    assert splitting.metres(cut[0], line[0]) == pytest.approx(50, rel=1e-3) and total > 500
    points = [(0.0, 0.0), (0.01, 0.0), (0.02, 0.0)]
    placed, fresh, cuts = splitting.place_cuts(points, [(0.004, 0.0001), (0.0100001, 0.0001)])
    assert fresh == [False, True, False, False] and cuts == [1, 2]
    assert splitting.pieces(4, cuts) == [(0, 1), (1, 2), (2, 3)]
    assert splitting.pieces(3, [0]) == splitting.pieces(3, [2]) == splitting.pieces(3, []) == []
    assert splitting.pieces(3, [1]) == [(0, 1), (1, 2)]


def test_split_all_ways_of_a_block_at_once(spark, monkeypatch):
    """Against the program for one way: bends, repeated and far candidates, ways without length, ids of one way kept in order."""
    rng = random.Random(3)
    node = lambda w, k: (w * 100 + k, 144.96 + rng.choice([k * 0.001, rng.uniform(0, 0.003)]), -37.81 + rng.choice([0.0, rng.uniform(0, 0.003)]))
    ways = [(w, [node(w, k) for k in range(rng.randint(1, 6))]) for w in range(400)] + [(900, [(1, 144.0, -37.0), (2, 144.0, -37.0)]), (901, [(3, 144.0, -37.0), (4, 144.01, -37.0)])]
    cuts = []
    for w, nodes in ways:
        c = [rng.choice([(144.96 + rng.uniform(-0.001, 0.006), -37.81 + rng.uniform(-0.001, 0.003)), nodes[-1][1:], (nodes[0][1] + 1e-5, nodes[0][2])]) for _ in range(rng.randint(0, 7))]
        cuts += [(w, k, *p) for k, p in enumerate(c + c[:2])]
    cuts += [(901, k, 144.0 + k / 10000, -37.0001) for k in range(1, 90)]  # more points than are taken at once
    want = []
    for w, nodes in ways:
        own = [{"x": c[2], "y": c[3]} for c in cuts if c[0] == w]
        want += splitting._split(w, [dict(zip(("id", "x", "y"), n)) for n in nodes], own) if own else []
    calls, one = [], splitting.place_cuts
    w = spark.createDataFrame(ways, "way_id long, nodes array<struct<id:long,x:double,y:double>>")
    found = splitting.split_ways(w, spark.createDataFrame(cuts, "way_id long, seq int, x double, y double"))
    got = sorted(map(tuple, found.collect()), key=lambda r: r[:3])
    want.sort(key=lambda r: r[:3])
    assert len(got) == len(want) > 800
    assert [(*a[:3], *a[5:]) for a in got] == [(*b[:3], *b[5:]) for b in want]
    assert all(a[3:5] == pytest.approx(b[3:5], abs=1e-12) for a, b in zip(got, want))
    # all ways but the long one in one go
    table = found.sparkSession.createDataFrame(ways[:50], w.schema).toArrow().combine_chunks()
    import pyarrow as pa

    lists = pa.array([[{"x": c[2], "y": c[3]} for c in cuts if c[0] == k] for k in range(50)], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    monkeypatch.setattr(splitting, "place_cuts", lambda *a: calls.append(a) or one(*a))
    columns = splitting._split_all(pa.record_batch([table["way_id"].chunk(0), table["nodes"].chunk(0), lists], names=["way_id", "nodes", "cuts"]))
    assert not calls and len(columns[0]) == sum(r[0] < 50 for r in want)
    # numbers of the same places are the same, after the given one
    ids = {(r["way_id"], r["x"], r["y"]): r["node_id"] for r in splitting.number_new_nodes(found, 10**6).where("is_new").collect()}
    assert sorted(ids.values()) == list(range(10**6 + 1, 10**6 + 1 + len(ids)))
    assert [k for k, _ in sorted(ids.items(), key=lambda e: e[1])] == sorted(ids)


FINE_LATS = [-38.0751637, -38.0752637, -38.0753637, -38.0754637, -38.0755637, -38.0752637, -38.0753637, -38.0753637, -38.0766637]
FINE_WAYS = [(2001, [1001, 1002, 1003, 1004], False, False, "a"), (2002, [1001, 1006, 1007, 1004], False, False, "b"), (2003, [1004, 1005], False, False, "c"),
             (2004, [1008, 1007], True, False, "d"), (2005, [1006, 1008], False, True, "e"), (2006, [1008, 1009], True, False, "f")]


def test_graph(spark):
    ways = spark.createDataFrame(FINE_WAYS, WAY_SCHEMA + ", name string")
    edges = graph.road_edges(ways)
    out = {r["dst"] for r in edges.where("src = 1008").collect()}
    assert out == {1006, 1007, 1009}
    hops = graph.within_hops(edges, spark.createDataFrame([(1008,)], "node long"), 1)
    assert {r["node"] for r in hops.where("hops = 1").collect()} == out
    nodes = {r["node"] for r in graph.intersection_nodes(edges).collect()}
    assert {1004, 1006, 1007, 1008} == nodes
    tags = graph.direction_tags(spark.createDataFrame([("p", [2001, 2002])], "path_id string, ways array<long>"), ways)
    assert [(r["way_id"], r["tag"]) for r in tags.orderBy("seq").collect()][0] == (2001, "A")


def test_carriageway_change(spark):
    # one two-way road meets two one-way roads of its name
    ways = spark.createDataFrame([(1, [1, 2], False, False, "m"), (2, [2, 3], True, False, "m"), (3, [4, 2], True, False, "m")], WAY_SCHEMA + ", name string")
    found = graph.carriageway_changes(graph.road_edges(ways), ways).collect()
    assert [(r["node"], r["name"]) for r in found] == [(2, "m")]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
    assert graph.connected_components(edges.limit(0)).count() == 0


LADDER = [
    ("one left", [("a", 1.0, 20.0, 20.0), ("b", 0.001, 0.0, 0.0)], {"a"}),
    ("all good stay", [("a", 1.0, 1.0, 1.0), ("b", 0.5, 2.0, 2.0)], {"a", "b"}),
    ("best of all", [("a", 1.0, 20.0, 20.0), ("b", 0.5, 30.0, 40.0)], {"a"}),
    ("none", [("a", 1.0, 60.0, 20.0), ("b", 1.0, 20.0, 60.0), ("c", 1.0, 60.0, 60.0)], set()),
]


@pytest.mark.parametrize("name, cands, want", LADDER)
def test_ladder(spark, name, cands, want):
    df = spark.createDataFrame([("w", *c) for c in cands], "way string, name string, L double, A double, E double")
    kept = {r["name"] for r in resolve.resolve(df).collect()}
    assert kept == want or name == "none"


def test_versions(spark):
    rows = spark.createDataFrame([(1, "x", "ADDED", 1, None), (2, "y", "ADDED", 1, None), (3, "z", "ADDED", None, None)], "id long, v string, status string, version_start int, version_end int")
    changes = spark.createDataFrame([(1, "x2", "MODIFIED"), (2, "y", "REMOVED"), (4, "w", "ADDED")], "id long, v string, status string")
    out = versions.publish(rows, changes, 2)
    at = lambda n: {(r["id"], r["v"]) for r in versions.as_of(out, n).collect()}
    assert at(1) == {(1, "x"), (2, "y")}
    assert at(2) == {(1, "x2"), (4, "w")}
    assert at(0) == set()
    keyed = lambda data: spark.createDataFrame(data, "id long, k string")
    status = versions.classify(keyed([(1, "a"), (2, "b"), (3, None), (4, "d")]), keyed([(1, "a"), (2, "c"), (3, "e"), (5, "f")]), ["id"], "k", True)
    assert {r["id"]: r["status"] for r in status.collect()} == {1: "SAME", 2: "MODIFIED", 3: "ADDED", 4: "REMOVED", 5: "ADDED"}


def test_sources(spark, tmp_path):
    osm = {"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0}, {"type": "node", "id": 2, "lat": 3.0, "lon": 4.0, "tags": {"a": "b"}}, {"type": "way", "id": 9, "nodes": [2, 1]}]}
    (tmp_path / "osm.json").write_text(json.dumps(osm))
    found = {r["id"]: r for r in readers.read_osm_json(spark, str(tmp_path / "osm.json")).collect()}
    assert set(found) == {"OSM&&NODE&&1", "OSM&&NODE&&2", "OSM&&WAY&&9"}
    assert [(p["x"], p["y"]) for p in found["OSM&&WAY&&9"]["line"]] == [(4.0, 3.0), (2.0, 1.0)]
    geo_json = {"type": "FeatureCollection", "features": [{"id": "f1", "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, "properties": {"a": "1"}}, {"id": "f2", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"b": "2"}}]}
    (tmp_path / "x.geojson").write_text(json.dumps(geo_json))
    rows = {r["id"]: r for r in readers.read_geojson(spark, str(tmp_path / "x.geojson")).withColumn("line", readers.geojson_line()).collect()}
    assert rows["f1"]["properties"] == {"a": "1"} and len(rows["f1"]["line"]) == 2 and rows["f2"]["line"] is None
    (tmp_path / "d").mkdir()
    for n in ("a_2024.csv", "a_2025.csv", "b_2026.csv"):
        (tmp_path / "d" / n).write_text("x,y\n1,2\n")
    newest = readers.newest_file(spark, str(tmp_path / "d"), "a_")
    assert newest.endswith("a_2025.csv")
    assert readers.read_csv(spark, newest).dtypes == [("x", "string"), ("y", "string")]


def test_paged_source(spark):
    rows = [(i, f"r{i}") for i in range(25)]
    source = readers.paged_source("pages_test", "id int, name string", lambda at, n: rows[at : at + n], lambda: len(rows), size=10)
    spark.dataSource.register(source)
    df = spark.read.format("pages_test").load()
    assert sorted(r["id"] for r in df.collect()) == list(range(25)) and df.rdd.getNumPartitions() == 3


def test_layers(spark):
    staged = spark.createDataFrame([("g1", "A1", "7", "open"), ("g1", None, "8", None), ("g2", "B", "9", "shut")], "geometry string, name string, number string, status string")
    features, attributes = readers.reshape(staged, readers.LAYERS["DECLARED"])
    assert {r["feature_id"] for r in features.collect()} == {"DECLARED&&8", "DECLARED&&9"}  # nulls come first
    assert attributes.where("s_value is null").count() == 0
    cells = readers.grid_cells(spark, 144.0, -38.0, 145.0, -37.0, 8)
    assert cells.count() == cells.select("cell_id").distinct().count() > 0


def test_trailing_stream(spark, tmp_path):
    data = [("a", f"2024-01-01 00:00:{s:02d}", float(s)) for s in range(0, 50, 10)] + [("b", "2024-01-01 00:00:05", 1.0)]
    df = spark.createDataFrame(data, "key string, t string, value double").select("key", F.to_timestamp("t").alias("ts"), "value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.file_stream(spark, str(tmp_path / "in"), df.schema)
    got = {(r["key"], r["ts"].second): (r["n"], r["total"]) for r in windows.run_available(windows.trailing_stream(stream, 20)).collect()}
    assert got == {("a", 0): (1, 0.0), ("a", 10): (2, 10.0), ("a", 20): (3, 30.0), ("a", 30): (3, 60.0), ("a", 40): (3, 90.0), ("b", 5): (1, 1.0)}
    batch = windows.trailing(df, 20, ["key"]).collect()
    assert {(r["key"], r["ts"].second): (r["n"], r["total"]) for r in batch} == got


def test_trailing_stream_with_late_events(spark, tmp_path):
    """An event behind the newest one, but not behind the watermark, looks back from its own time."""
    schema = "key string, ts timestamp, value double"
    for k, seconds in enumerate(([0, 10, 20, 30, 40, 50], [25])):
        rows = spark.createDataFrame([("a", f"2024-01-01 00:00:{s:02d}", float(s)) for s in seconds], "key string, t string, value double")
        rows.select("key", F.to_timestamp("t").alias("ts"), "value").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = windows.file_stream(spark, str(tmp_path / "in" / "part=*"), schema)
    got = {r["ts"].second: (r["n"], r["total"]) for r in windows.run_available(windows.trailing_stream(stream, 20)).collect()}
    assert got[25] == (3, 55.0) and got[50] == (3, 120.0)


def test_within_km_anywhere(spark):
    """Against all pairs, near the poles and across 180 degrees."""
    rnd = random.Random(4)
    points = [(i, rnd.uniform(-180, 180) if i % 2 else rnd.choice([-179.99, 179.99]), rnd.choice([-84.0, -70.0, 0.0, 70.0, 85.0])) for i in range(60)]
    segments = [(i, 0, x, y + rnd.uniform(-0.4, 0.4), x + rnd.uniform(-0.2, 0.2), y) for i, (_, x, y) in enumerate(points)]
    p = spark.createDataFrame(points, "point_id long, x double, y double")
    s = spark.createDataFrame(segments, "way_id long, seg int, x1 double, y1 double, x2 double, y2 double")
    turns = s.withColumn("t", F.explode(F.array(*map(F.lit, (-360.0, 0.0, 360.0))))).withColumns({"x1": F.col("x1") + F.col("t"), "x2": F.col("x2") + F.col("t")})
    c = F.col
    pos = geo.project(c("x1"), c("y1"), c("x2"), c("y2"), c("x"), c("y"))
    km = geo.haversine_km(geo.lerp(c("x1"), c("x2"), c("pos")), geo.lerp(c("y1"), c("y2"), c("pos")), c("x"), c("y"))
    want = {(r[0], r[1]) for r in p.crossJoin(turns).where("abs(x1 - x) <= 180").withColumn("pos", pos).where(km <= 60).select("point_id", "way_id").collect()}
    got = {(r[0], r[1]) for r in spatial.within_km(p, s, 60.0, 1.0).select("point_id", "way_id").collect()}
    assert got == want and len(want) > 60


def test_min_cost(spark):
    rows = [(1, 1, 10, 5), (1, 1, 20, 1), (1, 2, 11, 0), (1, 3, 40, 2), (1, 3, 12, 9), (2, 1, 7, 3)]
    got = dict(matching.min_cost(spark.createDataFrame(rows, "id long, step long, way long, q long")).collect())
    assert got == {1: 5 + 1 + 0 + 1 + 9, 2: 3}


def test_simplify(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (0.1, 0.0), (1.0, 0.0), (1.05, 0.0)],)], f"line {geo.LINE}")
    assert [p["x"] for p in df.select(polygons.simplify(F.col("line"), 0.5).alias("l")).first()["l"]] == [0.0, 1.0, 1.05]
    assert math.isclose(df.select(geo.planar_length(F.col("line"))).first()[0], 1.05)
