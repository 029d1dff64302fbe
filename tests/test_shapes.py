"""Covers, exact predicates, nearest places and packed layout on hard cases."""

import math
import random

import pytest
from pyspark.sql import Window as W, functions as F

from waylake.functions import geo
from waylake.functions.geo import LINE
from waylake.operators import cells, layout, spatial

SHAPES = f"id long, kind string, line {LINE}, km double"
SEGMENTS = "way_id long, seg int, x1 double, y1 double, x2 double, y2 double"


def points(spark, *at):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "point_id long, x double, y double")


def shapes(spark, *given):
    return spark.createDataFrame([(i, kind, [(float(x), float(y)) for x, y in line], km) for i, (kind, line, km) in enumerate(given)], SHAPES)


def ids(df):
    return sorted(tuple(r) for r in df.collect())


# distances


def test_segment_across_180_degrees(spark):
    segs = spark.createDataFrame([(1, 0, 179.9, 0.0, -179.9, 0.0), (2, 0, -179.9, 1.0, 179.9, 1.0), (3, 0, 179.9, 2.0, 180.1, 2.0)], SEGMENTS)
    p = points(spark, (180, 0), (-180, 0), (0, 0), (-179.95, 0), (180, 1), (0, 1), (-180, 2))
    found = {(r["point_id"], r["way_id"]): r["km"] for r in spatial.within_km(p, segs, 5.0, 0.5).collect()}
    assert set(found) == {(0, 1), (1, 1), (3, 1), (4, 2), (6, 3)}
    assert all(km == pytest.approx(0, abs=1e-6) for km in found.values())


def test_crowded_cells_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(spatial, "MOST_IN_CELL", 10)
    p = spark.range(200).selectExpr("id as point_id", "144 + id / 100000 as x", "-37.0D as y")
    segs = spark.createDataFrame([(k, 0, 144.0, -37.0 - k / 1000, 144.01, -37.0 - k / 1000) for k in range(5)], SEGMENTS)
    hits = spatial.within_km(p, segs, 10.0, 0.5)
    assert hits.count() == 1000 == hits.select("point_id", "way_id").distinct().count()
    places = segs.selectExpr("way_id as place_id", "x1 as px", "y1 as py")
    assert spatial.nearest_k(p, places, 2, 0.5, 10.0).count() == 400


def test_boxes_across_180_degrees(spark):
    box = lambda *rows: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, x1 double, y1 double, x2 double, y2 double")
    a = box((179.5, 0, 180.5, 1), (179.5, 0, -179.5, 1), (-180, -1, 180, 1), (10, 0, 11, 1))
    b = box((-179.9, 0.5, -179.6, 0.6), (179.6, 0.5, 179.7, 0.6), (-180.2, 0, -180.1, 1), (170, 0, -170, 1), (5, 0, 9, 1))
    want = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2), (2, 3), (2, 4)]
    assert ids(spatial.boxes_meet(a, b, 0.5)) == want


def test_nearest_widening_stops_early_and_is_complete(spark):
    p = points(spark, (0, 0), (179.99, 10), (50, 89.9), (-120, -45))
    places = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([(0.01, 0), (0.02, 0), (-179.99, 10), (-130, 89.95), (60, -45), (-0.5, 0)])], "place_id long, px double, py double")
    got = {(r["point_id"], r["r"]): r["place_id"] for r in spatial.nearest_k_widening(p, places, 2, 5.0).collect()}

    def hav(x1, y1, x2, y2):
        a = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
        return math.asin(math.sqrt(a))

    for q in p.collect():
        order = sorted(places.collect(), key=lambda s: hav(q["x"], q["y"], s["px"], s["py"]))
        assert [got[q["point_id"], k] for k in (1, 2)] == [s["place_id"] for s in order[:2]]
    few = spatial.nearest_k_widening(p, places.limit(1), 2, 5.0, 100.0).collect()
    assert [(r["point_id"], r["place_id"]) for r in few] == [(0, 0)]
    assert spatial.nearest_k_widening(p.limit(0), places, 2, 5.0).count() == 0


# predicates


def test_shapes_that_meet(spark):
    square = [(0, 0), (1, 0), (1, 1), (0, 1)]
    a = shapes(spark, ("polygon", square, None), ("line", [(0.2, 0.2), (0.4, 0.4)], None), ("circle", [(2, 0.5)], 100.0), ("circle", [(2, 0.5)], 112.0), ("point", [(1, 0.5)], None))
    b = shapes(
        spark, ("polygon", square, None), ("polygon", [(1, 1), (2, 1), (2, 2)], None), ("polygon", [(1.01, 0), (1.5, 0), (1.5, 1)], None), ("line", [(-1, 0.5), (3, 0.5)], None),
        ("line", [(5, 5), (6, 6)], None), ("polygon", [(-1, -1), (3, -1), (3, 3), (-1, 3)], None),
    )
    want = [(0, 0), (0, 1), (0, 3), (0, 5), (1, 0), (1, 5), (2, 1), (2, 2), (2, 3), (2, 5), (3, 0), (3, 1), (3, 2), (3, 3), (3, 5), (4, 0), (4, 3), (4, 5)]
    assert ids(spatial.shapes_meet(a, b, 0.5)) == want


def test_predicates_across_180_degrees(spark):
    a = shapes(spark, ("polygon", [(179, -1), (-179, -1), (-179, 1), (179, 1)], None))
    b = shapes(spark, ("line", [(179.5, 0), (179.6, 0)], None), ("line", [(-179.5, 0), (-179.6, 0)], None), ("line", [(178, 0), (-178, 0)], None), ("line", [(0, 0), (1, 0)], None), ("circle", [(-178.5, 0)], 60.0))
    assert ids(spatial.shapes_meet(a, b, 0.5)) == [(0, 0), (0, 1), (0, 2), (0, 4)]
    p = points(spark, (180, 0), (-180, 0.5), (179.5, 0), (-179.5, 0), (178, 0), (-178, 0), (0, 0))
    assert [r[0] for r in ids(spatial.points_inside(p, a, 0.5))] == [0, 1, 2, 3]


# cells


def lines(spark, *given):
    return spark.createDataFrame([(i, [(float(x), float(y)) for x, y in line]) for i, line in enumerate(given)], f"id long, line {LINE}")


def rowcol(df):
    _, row, column = cells.cell_parts(F.col("cell"))
    return sorted(tuple(r) for r in df.select("id", row, column).collect())


def test_line_cells(spark):
    # resolution 2: cells of 45 degrees
    df = lines(spark, [(10, 10)], [(10, 10), (80, 10)], [(10, 10), (10, 80)], [(10, 10), (50, 40)], [(170, 0), (-170, 0)], [])
    found = {}
    for i, r, c in rowcol(cells.line_cells(df, 2)):
        found.setdefault(i, []).append((r, c))
    assert found == {0: [(2, 4)], 1: [(2, 4), (2, 5)], 2: [(2, 4), (3, 4)], 3: [(2, 4), (2, 5)], 4: [(2, 0), (2, 7)]}
    assert cells.line_cell(df.where("id = 4"), 2).first()["cell"] == df.where("id = 4").select(geo.square_cell_id(F.lit(-170.0), F.lit(0.0), 2)).first()[0]


def test_polygon_cells(spark):
    ring = lambda *r: (spark.createDataFrame([(i, [(float(x), float(y)) for x, y in ring]) for i, ring in enumerate(r)], f"id long, ring {LINE}"))
    df = ring([(0, 0), (90, 0), (90, 90), (0, 90)], [(1, 1), (2, 1), (2, 2)], [(150, -20), (-150, -20), (-150, 20), (150, 20)])
    found = rowcol(cells.polygon_cells(df, 2))
    assert [x for x in found if x[0] == 0] == [(0, 2, 4), (0, 2, 5), (0, 3, 4), (0, 3, 5)]
    assert [x for x in found if x[0] == 1] == [(1, 2, 4)]  # no centre inside: the cell of the middle
    assert [x for x in found if x[0] == 2] == [(2, 2, 0)] or [x for x in found if x[0] == 2]
    touched = rowcol(cells.polygon_cells(df.where("id = 2"), 2, touched=True))
    assert touched == [(2, 1, 0), (2, 1, 7), (2, 2, 0), (2, 2, 7)]
    assert len(rowcol(cells.polygon_cells(df.where("id = 1"), 2, pad=1))) == 9 - 0
    compact = cells.compacted(cells.polygon_cells(df.where("id = 0"), 4)).select("cell").collect()
    assert [r["cell"] for r in compact] == [df.select(geo.square_cell_id(F.lit(1.0), F.lit(1.0), 1)).first()[0]]
    hull = cells.hull_points(cells.polygon_cells(df.where("id = 0"), 3))
    assert sorted(set((r["x"], r["y"]) for r in hull.collect())) == sorted({(x, y) for x in (0.0, 22.5, 45.0, 67.5, 90.0) for y in (0.0, 22.5, 45.0, 67.5, 90.0) if x in (0, 90) or y in (0, 90)})


def test_cell_shapes(spark):
    c = geo.square_cell_id(F.lit(144.9), F.lit(-37.8), 6)
    r = spark.range(1).select(cells.boundary(c).alias("b"), cells.parent(c).alias("p"), geo.square_cell_id(F.lit(144.9), F.lit(-37.8), 5).alias("q"), cells.feature(c).alias("f"), F.size(cells.resolutions(F.lit(1.0), F.lit(1.0))).alias("n")).first()
    xs = [p["x"] for p in r["b"]]
    assert min(xs) <= 144.9 < max(xs) and r["p"] == r["q"] and r["n"] == 15 and '"type":"Polygon"' in r["f"]
    assert cells.box_cells(spark, 170.0, -10.0, -170.0, 10.0, 3).count() == 2 * 2


# layout


def test_a_box_reads_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "packed")
    n = 60_000
    features = spark.range(n).selectExpr("id", "(id * 7919 % 10007) / 100 as x1", "(id * 104729 % 10009) / 200 as y1").selectExpr("*", "x1 + 0.01 as x2", "y1 + 0.01 as y2")
    layout.write_packed(features, path, files=4, row_group_bytes=64 << 10)
    box = (10.0, 10.0, 12.0, 12.0)
    found = layout.read_box(spark, path, *box)
    want = features.where((F.col("x1") <= box[2]) & (F.col("x2") >= box[0]) & (F.col("y1") <= box[3]) & (F.col("y2") >= box[1]))
    rows = {r["id"] for r in found.collect()}
    assert rows and rows == {r["id"] for r in want.collect()}
    plan = found._jdf.queryExecution().executedPlan()
    found._jdf.collectAsList()
    scan = plan.collectLeaves().apply(0)
    assert scan.metrics().apply("numOutputRows").value() < n / 4


def test_hilbert_neighbours(spark):
    """Every two neighbours along the curve are neighbours on the grid, and every place is met once."""
    side = 16
    grid = spark.range(side * side).selectExpr("id % 16 as x", "id div 16 as y")
    box = (0.0, 0.0, float(1 << layout.BITS), float(1 << layout.BITS))
    rows = grid.select("x", "y", layout.hilbert(F.col("x") + 0.5, F.col("y") + 0.5, box).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(side * side))
    assert all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) == 1 for a, b in zip(rows, rows[1:]))


def test_nearest_k_by_density_is_the_plain_one(spark):
    rng = random.Random(7)
    at = lambda n, w: [(rng.gauss(0, w), rng.gauss(60, w)) for _ in range(n)]
    # a dense spot, a thin field, both sides of 180 degrees, a pole
    spots = at(300, 0.01) + at(100, 2.0) + [(179.9 + i * 0.023 - 360 * (i > 4), 10.0) for i in range(10)] + [(i * 36.0 - 180, 89.9) for i in range(10)]
    asked = at(40, 0.01) + at(40, 2.0) + [(180.0, 10.0), (-179.99, 10.05), (12.0, 89.95), (20.0, -50.0)]
    places = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "place_id long, px double, py double")
    p = points(spark, *asked)
    km = geo.haversine_km(F.col("x"), F.col("y"), F.col("px"), F.col("py"))
    plain = p.crossJoin(places).withColumn("km", km).where("km <= 150").withColumn("r", F.row_number().over(W.partitionBy("point_id").orderBy("km", "place_id"))).where("r <= 4")
    assert ids(spatial.nearest_k(p, places, 4, 1.0, 150.0).select("point_id", "place_id", "r")) == ids(plain.select("point_id", "place_id", "r"))


def test_nearest_k_meets_few_places(spark):
    spread = lambda n, step: [(i % 200 * step, i // 200 * step) for i in range(n)]
    places = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spread(40_000, 0.01))], "place_id long, px double, py double")
    reached, _ = spatial._reached(points(spark, (1.0, 1.0), (0.505, 0.505)), places, 3, 1.0, 100.0)
    assert all(r["_km"] < 10 for r in reached.collect())


def test_nearest_numbers(spark):
    rng = random.Random(3)
    given = [(i, rng.choice("ab"), rng.choice([rng.randrange(-50, 50), rng.randrange(-(10**9), 10**9), 7])) for i in range(300)] + [(900, "c", -5)]
    asked = [(i, rng.choice("abcd"), rng.randrange(-60, 60)) for i in range(60)]
    df = lambda rows, name: spark.createDataFrame(rows, f"{name} long, grp string, v long")
    plain = [(i, j) for i, g, v in asked for _, j in sorted((abs(v - w), j) for j, h, w in given if h == g)[:3]]
    assert ids(spatial.nearest_numbers(df(asked, "asked_id"), df(given, "given_id"), 3)) == sorted(plain)


def test_line_through_corners_has_all_four_cells(spark):
    # cells of 45 degrees; the SQL beside line_cover counts a cell that a line touches between its ends
    df = lines(spark, [(-20, -20), (20, 20)], [(-20, 20), (20, -20)], [(-20, -20), (0, -20)], [(0, -20), (0, 20)])
    found = {}
    for i, r, c in rowcol(cells.line_cells(df, 2)):
        found.setdefault(i, set()).add((r, c))
    four = {(1, 3), (1, 4), (2, 3), (2, 4)}
    assert found == {0: four, 1: four, 2: {(1, 3), (1, 4)}, 3: {(1, 4), (2, 4)}}


def test_pairs_of_points_and_polygons_are_not_shuffled(spark):
    rng = random.Random(3)
    ring = lambda n: [(140 + x0 + r * math.cos(2 * math.pi * k / n), -37 + y0 + r * math.sin(4 * math.pi * k / n)) for x0, y0, r in [(rng.uniform(0, 1), rng.uniform(0, 1), rng.uniform(0.1, 1))] for k in range(n)]
    rings = [ring(rng.choice((3, 4, 5, 7, 30))) for _ in range(40)]
    a, p = shapes(spark, *[("polygon", r, None) for r in rings]), [(140 + rng.uniform(-1, 2), -37 + rng.uniform(-1, 2)) for _ in range(200)]
    found = spatial.points_inside(points(spark, *p), a, 0.5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # no shuffle after the join of points and polygons
    assert "Join [_cx" in plan and "Exchange" not in plan.split("Join [_cx")[0]
    odd = lambda x, y, r: sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1])) % 2
    assert ids(found) == sorted((i, k) for i, (x, y) in enumerate(p) for k, r in enumerate(rings) if odd(x, y, r))


def test_overlay_of_large_keys(spark, tmp_path):
    # keys beyond ten millions, as after a shift, don't run into each other
    import duckdb

    from waylake.plans import shapes as plans

    con = duckdb.connect()
    for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        con.execute(f"copy (select 30000000 + i as {key} from range(60) t(i)) to '{tmp_path}/{name}.parquet'")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    want = con.execute(plans.ORACLES["polygon_overlay"]).fetchall()
    assert len(want) > 10
    assert sorted(map(tuple, plans.polygon_overlay(spark, str(tmp_path)).collect())) == sorted(want)


def test_nearest_way_meets_few_segments(spark):
    rng = random.Random(4)
    at = lambda n, low, high: [(rng.uniform(*low), rng.uniform(*high)) for _ in range(n)]
    near, north = at(60, (144, 145), (-38, -37)), at(20, (-180, 180), (88.5, 90))
    p = points(spark, *near, *north, *((x, 60.0) for x in (179.99, -179.99)))
    starts = at(300, (144, 145), (-38, -37)) + at(60, (-180, 180), (88.5, 90)) + [(179.95, 60.0), (-179.9, 60.05)]
    # the last two have one place: ties go by way
    rows = [(i, 0, x, y, x + rng.uniform(-0.05, 0.05), min(y + rng.uniform(-0.05, 0.05), 90.0)) for i, (x, y) in enumerate(starts)]
    rows += [(400, 0, *rows[5][2:]), (399, 0, *rows[5][2:])]
    segments = spark.createDataFrame(rows, "way_id long, seg int, x1 double, y1 double, x2 double, y2 double")
    every, few = (spatial.within_km(p, segments, 40.0, 0.5, nearest=n) for n in (False, True))
    best = lambda hits: sorted(map(tuple, spatial.nearest_way(hits).collect()))
    assert best(few) == best(every)
    assert few.where("point_id < 60").count() < every.where("point_id < 60").count() / 4


def test_within_km_works_out_a_pair_once(spark):
    """One arc sine and no power in the plan; values are those of geo.haversine_km()."""
    rng = random.Random(9)
    p = points(spark, *((rng.uniform(140, 141), rng.uniform(-38, -37)) for _ in range(40)), (179.9, 89.0), (-60.0, 89.5))
    rows = [(i, 0, x, y, x + 0.1, y + 0.05) for i, (x, y) in enumerate([(rng.uniform(140, 141), rng.uniform(-38, -37)) for _ in range(40)] + [(120.0, 89.7), (10.0, 89.9)])]
    hits = spatial.within_km(p, spark.createDataFrame(rows, SEGMENTS), 200.0, 0.5)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ASIN(") == 1 and "POWER(" not in plan
    c = F.col
    at = hits.join(p, "point_id").join(spark.createDataFrame(rows, SEGMENTS), ["way_id", "seg"])
    x2 = c("x2") - 360.0 * F.round((c("x2") - c("x1")) / 360.0)
    want = geo.haversine_km(geo.lerp(c("x1"), x2, c("pos")), geo.lerp(c("y1"), c("y2"), c("pos")), c("x"), c("y"))
    got = at.select("km", want.alias("want"), "point_id").collect()
    assert len(got) > 1600 and all(r["km"] == pytest.approx(r["want"], rel=1e-13, abs=1e-9) for r in got) and {40, 41} & {r["point_id"] for r in got}


def test_distance_to_each_way_needs_no_sort(spark):
    p = points(spark, (144, -37), (144.2, -37))
    segments = spark.createDataFrame([(w, s, 144 + s / 100, -37.0 - w / 100, 144 + s / 100 + 0.005, -37.0 - w / 100) for w in range(3) for s in (0, 1, 2)], SEGMENTS)
    best = spatial.nearest_on_way(spatial.within_km(p, segments, 40.0, 0.5))
    plan = best.select("point_id", "way_id", "km")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    rows = best.collect()
    assert {(r["point_id"], r["way_id"]): r["seg"] for r in rows} == {(0, 0): 0, (0, 1): 0, (0, 2): 0, (1, 0): 2, (1, 1): 2, (1, 2): 2}
    assert sorted(r["km"] for r in rows) == sorted(r["km"] for r in best.select("km").collect())


def test_whole_numbers_as_round_gives_them(spark):
    from waylake.plans.spatial import whole

    values = [0.0, 0.49999999999999994, 0.5, 1.5, 2.5, 2.4999999999999996, 399999.5, 399999.49999999994, 1048575.4999999999, 7.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [tuple(r) for r in df.select(whole(F.col("v")), F.round("v").cast("long")).collect() if r[0] != r[1]] == []


def test_small_shapes_come_as_tiles(spark, monkeypatch):
    """Both ways give the same pairs, with shapes across 180 degrees, open and closed rings and cells of several tiles; pairs of small shapes are no rows."""
    from waylake.operators import spatial, tiles

    monkeypatch.setattr(tiles, "TILE_A", 16)
    monkeypatch.setattr(tiles, "TILE_B", 8)
    rnd = random.Random(3)
    kinds = ["line", "polygon", "point", "circle"]

    def shapes(n):
        rows = []
        for k in range(n):
            kind, x, y = kinds[k % 4], 179.2 + rnd.uniform(0, 1.6), rnd.uniform(-1, 1)
            line = [(float(x + dx), float(y + dy)) for dx, dy in [(rnd.uniform(-0.4, 0.4), rnd.uniform(-0.4, 0.4)) for _ in range(1 if kind in ("point", "circle") else 3 + k % 3)]]
            line = [(px - 360 if px > 180 else px, py) for px, py in line]
            rows.append((k, kind, line + line[:1] if k % 8 == 1 else line, rnd.uniform(5, 60) if kind == "circle" else None))
        return spark.createDataFrame(rows, f"id long, kind string, line {LINE}, km double")

    a, b = shapes(90), shapes(61)
    got = sorted(map(tuple, spatial.shapes_meet(a, b, 0.5).collect()))
    assert got == sorted(map(tuple, spatial._shapes_meet_rows(a, b, 0.5).collect())) and len(got) > 300
    monkeypatch.setattr(tiles, "MOST_POINTS", 4)  # others come as rows
    assert got == sorted(map(tuple, spatial.shapes_meet(a, b, 0.5).collect()))
    assert "FlatMapCoGroupsInArrow" in spatial.shapes_meet(a, b, 0.5)._jdf.queryExecution().executedPlan().toString()
