"""Polygon overlay against known results, a raster and inclusion-exclusion."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waylake.functions.geo import LINE
from waylake.operators import overlay, polygons

SCHEMA = f"pair long, side string, ring {LINE}"
P1 = [(0, 0), (1, 0), (1, 1), (0, 0)]
P2 = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
P3 = [(2, 0), (3, 0), (3, 1), (2, 1), (2, 0)]
P4 = [(0, 0), (1, 1), (0, 1), (0, 0)]
P5 = [(0, 0), (1, 1), (0, 0)]
P6 = [(0, 0), (1, 0), (0.5, 0.5), (0, 1), (1, 1), (0, 0)]
P7 = [(0, 0), (0.5, 0), (1, 0), (1, 1), (0.5, 1), (0, 1), (0, 0)]


def shapes(spark, *pairs):
    rows = []
    for k, (a, b) in enumerate(pairs):
        for side, ring in (("a", a), ("b", b)):
            if ring is not None:
                rows.append((k, side, [(float(x), float(y)) for x, y in ring]))
    return spark.createDataFrame(rows, SCHEMA)


def corners(ring):
    return {(round(p["x"], 9), round(p["y"], 9)) for p in ring}


def test_known_areas(spark):
    found = {r["pair"]: r for r in overlay.areas(shapes(spark, (P1, P2), (P1, P4), (P1, P3), (P5, P2), (P6, None), (P7, P2), ([], P2))).collect()}
    both = [found[k]["both"] for k in range(7)]
    assert both == pytest.approx([0.5, 0, 0, 0, 0, 1, 0])
    assert [found[k]["a"] for k in range(7)] == pytest.approx([0.5, 0.5, 0.5, 0, 0.5, 1, 0])
    assert found[1]["either"] == pytest.approx(1) and found[2]["either"] == pytest.approx(1.5)


def test_known_rings(spark):
    s = shapes(spark, (P1, P2), (P1, P4), (P1, P3))
    both = {r["pair"]: r["rings"] for r in overlay.rings(s, "both").collect()}
    assert set(both) == {0} and len(both[0]) == 1 and corners(both[0][0]) == {(0, 0), (1, 0), (1, 1)}
    either = {r["pair"]: r["rings"] for r in overlay.rings(s, "either").collect()}
    assert len(either[1]) == 1 and corners(either[1][0]) == {(1, 0), (0, 0), (0, 1), (1, 1)}
    assert len(either[2]) == 2
    split = overlay.repaired(shapes(spark, (P6, None), (P7, None), (P5, None)).drop("side")).collect()
    split = {r["pair"]: r["rings"] for r in split}
    assert sorted(map(sorted, map(corners, split[0]))) == [[(0, 0), (0.5, 0.5), (1, 0)], [(0, 1), (0.5, 0.5), (1, 1)]]
    assert len(split[1][0]) == 4 and 2 not in split


def star(rng, n):
    turn = np.sort(rng.uniform(0, 2 * np.pi, n))
    far = rng.uniform(0.2, 1, n)
    x, y = rng.uniform(-0.5, 0.5, 2)
    return [(x + f * math.cos(t), y + f * math.sin(t)) for f, t in zip(far, turn)]


def inside(ring, xs, ys):
    hit = np.zeros(xs.shape, bool)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            spans = (np.minimum(y1, y2) <= ys) & (ys < np.maximum(y1, y2))
            hit ^= spans & (xs < x1 + (ys - y1) * (x2 - x1) / (y2 - y1))
    return hit


def test_random_pairs_against_a_raster_and_their_own_rings(spark):
    rng = np.random.default_rng(3)
    pairs = [(star(rng, 9), star(rng, 14)) for _ in range(8)]
    pairs += [([tuple(p) for p in rng.uniform(-1, 1, (8, 2))], star(rng, 7)) for _ in range(4)]  # crossing themselves
    s = shapes(spark, *pairs).cache()
    areas = {r["pair"]: r for r in overlay.areas(s).collect()}
    side = np.linspace(-1.6, 1.6, 1601)
    xs, ys = np.meshgrid((side[1:] + side[:-1]) / 2, (side[1:] + side[:-1]) / 2)
    for k, (a, b) in enumerate(pairs):
        in_a, in_b = inside(a, xs, ys), inside(b, xs, ys)
        for op, f in overlay.OPS.items():
            assert areas[k][op] == pytest.approx(f(in_a, in_b).mean() * 3.2**2, abs=0.01)
        r = areas[k]
        assert r["either"] == pytest.approx(r["only_a"] + r["only_b"] + r["both"]) and r["a"] == pytest.approx(r["only_a"] + r["both"])
    for op in overlay.OPS:
        for r in overlay.rings(s, op).collect():
            signed = 0.0
            for ring in r["rings"]:
                p = np.array([(q["x"], q["y"]) for q in ring])
                q = np.roll(p, -1, axis=0)
                signed += (p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2
            assert signed == pytest.approx(areas[r["pair"]][op], abs=1e-7)


def test_holes(spark):
    outer = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    inner = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    found = overlay.rings(shapes(spark, (outer, inner)), "only_a").collect()
    assert sorted(len(r) for r in found[0]["rings"]) == [4, 4]


def test_area_between_lines_is_the_plain_polygon_error(spark):
    rng = np.random.default_rng(7)
    lines = []
    for k in range(6):
        a = np.cumsum(rng.uniform(0.0005, 0.002, (5, 2)), axis=0) + [144.9, -37.8]
        lines.append((k, [tuple(map(float, p)) for p in a], [tuple(map(float, p)) for p in a + rng.normal(0, 0.0003, a.shape)]))
    df = spark.createDataFrame(lines, f"pair long, a {LINE}, b {LINE}")
    for r in overlay.area_between(df).collect():
        assert r["error"] == pytest.approx(polygons.polygon_error(*lines[r["pair"]][1:]), rel=1e-6)


def test_ring_of_many_points(spark):
    turn = [2 * math.pi * k / 5000 for k in range(5000)]
    circle = [(144 + 0.01 * math.cos(t), -37 + 0.01 * math.sin(t)) for t in turn]
    r = overlay.areas(shapes(spark, (circle, None))).first()
    assert r["a"] == pytest.approx(math.pi * 1e-4, rel=1e-5)
    assert overlay.areas(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stars_whose_crossings_differ_in_the_last_digit(spark):
    points = lambda k: [(140.2 + k * 11 * 7919 % 10400000 / 1e6 + (0.25 + k % 5 * 0.05) * math.cos(4 * math.pi * i / 5 + k), -39.7 + k * 11 * 6271 % 6200000 / 1e6 + (0.25 + k % 5 * 0.05) * math.sin(4 * math.pi * i / 5 + k) * 0.8) for i in range(5)]
    stars = spark.createDataFrame([(k, points(k)) for k in (148, 479, 1770, 1786, 2378, 2829, 4839)], f"pair long, ring {LINE}")
    assert all(sorted(map(len, r["rings"])) == [3] * 5 for r in overlay.repaired(stars).collect())


def test_areas_in_place_as_by_rows(spark, monkeypatch):
    rng = np.random.default_rng(11)
    lines = []
    for k in range(60):
        a, b = (np.cumsum(rng.normal(0, 0.01, (rng.integers(1, 9), 2)), axis=0) + [144.9, -37.8] for _ in "ab")
        lines.append((k, *([tuple(map(float, p)) for p in line] for line in (a, b))))
    lines += [(60, lines[0][1], lines[0][1]), (61, lines[1][1], None)]
    df = spark.createDataFrame(lines, f"pair long, a {LINE}, b {LINE}")
    here = overlay.area_between(df)
    assert "MapInArrow" in here._jdf.queryExecution().executedPlan().toString()
    found = {r["pair"]: (r["m2"], r["error"]) for r in here.collect()}
    monkeypatch.setattr(overlay, "MOST_IN_PLACE", 0)
    rows = {r["pair"]: (r["m2"], r["error"]) for r in overlay.area_between(df).collect()}
    assert set(found) == set(range(62)) and found[61][0] == 0
    for k in range(61):
        assert found[k] == (pytest.approx(rows[k][0], rel=1e-9, abs=1e-6), pytest.approx(rows[k][1], rel=1e-9, abs=1e-9) if rows[k][1] is not None else None)


def test_small_rings_come_as_tiles(spark):
    """Areas of pairs are those of edges in rows, also of rings that cross themselves; pairs of small rings are no rows."""
    rng = np.random.default_rng(11)
    rings = lambda n: spark.createDataFrame([(k, [(float(x), float(y)) for x, y in rng.uniform(-1, 1, (3 + k % 4, 2))]) for k in range(n)], f"id long, ring {LINE}")
    a, b = rings(9), rings(7)
    found = overlay.areas_of_pairs(a, b, 0.5)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["a_id"], r["b_id"]): tuple(r)[2:] for r in found.collect()}
    as_line = lambda df: df.withColumnRenamed("ring", "line")
    want = {(r["a_id"], r["b_id"]): tuple(r)[2:] for r in overlay._areas_by_rows(as_line(a), as_line(b), 0.5).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
