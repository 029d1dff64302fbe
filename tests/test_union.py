"""Line union on known lines and against dense samples."""

import numpy as np
import pytest

from waylake.functions.geo import LINE
from waylake.operators import union

BASE = [(1, 1), (2, 2), (3, 3), (4, 4)]
END, FRONT = [(3, 3), (4, 4), (5, 5)], [(-1, -1), (0, 0), (1, 1)]
BRANCH, UNCLEAR = [(3, 3), (3, 2.5), (3, 2)], [(3, 3), (4, 3), (5, 3)]


def unite(*lines, **options):
    return [tuple(p) for p in union.united([np.array(x, float) for x in lines], **options).tolist()]


@pytest.mark.parametrize("lines, want", [
    ([BASE, END], [(i, i) for i in range(1, 6)]), ([END, BASE], [(i, i) for i in range(1, 6)]), ([BASE, END, BASE], [(i, i) for i in range(1, 6)]),
    ([BASE, END, FRONT], [(i, i) for i in range(-1, 6)]), ([BASE, END[::-1], FRONT[::-1]], [(i, i) for i in range(-1, 6)]),
    ([BASE, BRANCH], BASE), ([BASE, UNCLEAR], BASE), ([BASE, [(10, 10), (11, 10)]], BASE), ([BASE, [(4, 4)]], BASE), ([BASE], BASE), ([], []),
])
def test_known_lines(lines, want):
    assert unite(*lines) == want


def test_options():
    assert unite(BASE, END, least_share=100.0) == BASE
    with pytest.raises(union.Branch):
        unite(BASE, BRANCH, ignore_branches=False)
    aside = [(x, y + 0.1) for x, y in END]
    assert unite(BASE, aside) == BASE  # nowhere near
    assert unite(BASE, aside, buffer=0.2)[-1] == (5, 5.1)


def test_outside_against_samples():
    rng = np.random.default_rng(2)
    for _ in range(40):
        base, line, radius = rng.uniform(0, 1, (6, 2)), rng.uniform(0, 1, (5, 2)), rng.uniform(0.02, 0.2)
        t = np.linspace(0, 1, 2001)[1:-1, None]
        far = [~union._near(p + t * (q - p), base, radius) for p, q in zip(line, line[1:])]
        want = sum(f.mean() * np.hypot(*(q - p)) for f, p, q in zip(far, line, line[1:]))
        found = union.outside(line, base, radius)
        assert sum(map(union._length, found)) == pytest.approx(want, abs=0.02)
        for s in found:
            assert not union._near((s[:-1] + s[1:]) / 2, base, radius * 0.999).any()


def test_by_key(spark):
    rows = [("a", 0, BASE), ("a", 1, END), ("b", 0, FRONT), ("b", 1, None), ("c", 0, [])]
    rows = [(k, i, None if line is None else [(float(x), float(y)) for x, y in line]) for k, i, line in rows]
    df = spark.createDataFrame(rows, f"road string, seq int, line {LINE}")
    found = {r["road"]: [(p["x"], p["y"]) for p in r["line"]] for r in union.unite_lines(df, "road").collect()}
    assert found == {"a": [(i, i) for i in range(1, 6)], "b": FRONT, "c": []}


def test_roads_at_once_as_each_alone(spark):
    rng = np.random.default_rng(5)
    roads = []
    for k in range(1500):
        base = np.cumsum(rng.uniform(0, 1, (rng.integers(2, 9), 2)), axis=0)
        lines = [base, np.concatenate([base[-2:], base[-1:] + rng.uniform(0, 2, (2, 2))]), np.concatenate([base[1::-1], base[:1] - rng.uniform(0, 2, (1, 2))])]
        lines += [base[::-1] + rng.uniform(-0.02, 0.02, base.shape), rng.uniform(0, 4, (rng.integers(0, 5), 2)), base[rng.integers(0, len(base), 3)]]
        roads.append([lines[i] for i in rng.permutation(6)[: rng.integers(0, 7)]])
    each = [line for road in roads for line in road]
    sizes, road = np.array([len(line) for line in each]), np.repeat(np.arange(len(roads)), [len(r) for r in roads])
    for options in ({}, {"buffer": 0.05}, {"buffer": 0.3, "least_share": 0.2, "width": 1.0}):
        points, n = union.united_all(np.concatenate(each), sizes, road, len(roads), **options)
        assert len(n) == len(roads) and n.sum() == len(points)
        for lines, found in zip(roads, np.split(points, np.cumsum(n)[:-1])):
            want = union.united(lines, **options)
            assert len(found) == len(want) and np.allclose(found, want, rtol=0, atol=1e-9)


def test_roads_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(union, "MOST_PAIRS", 30)
    rows = [(k, i, [(float(x + k), float(y)) for x, y in line]) for k in range(5) for i, line in enumerate([BASE, END, FRONT][: k % 4])]
    per_road, sizes = np.array([k % 4 for k in range(5)]), np.array([len(r[2]) for r in rows])
    points = np.array([p for r in rows for p in r[2]])
    found = [union._block(points, sizes, per_road, part, {}) for part in union._blocks(per_road, sizes)]
    lines = np.split(np.concatenate([p for p, _ in found]), np.cumsum(np.concatenate([n for _, n in found]))[:-1])
    for k, line in enumerate(lines):
        assert line.tolist() == union.united([np.array(r[2]) for r in rows if r[0] == k]).tolist()
