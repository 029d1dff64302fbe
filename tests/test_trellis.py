"""Matching as joins against the program for one line, on the known graph and on random streets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waylake.functions.geo import LINE
from waylake.operators import matching, trellis

NODES = "id long, x double, y double"
WAYS = "id long, nodes array<long>, oneway boolean, reverseway boolean"


def town(seed, n=5):
    """A grid of streets with small bends; some are one way, a few against their nodes."""
    rng = random.Random(seed)
    nodes = [(i * n + j, 144.9 + j * 0.002 + rng.uniform(-2e-4, 2e-4), -37.8 + i * 0.002 + rng.uniform(-2e-4, 2e-4)) for i in range(n) for j in range(n)]
    ways = []
    for k in range(n):
        for along in ([k * n + j for j in range(n)], [j * n + k for j in range(n)]):
            oneway = rng.random() < 0.3
            ways.append((100 + len(ways), along, oneway, oneway and rng.random() < 0.3))
    return nodes, ways


def walk(rng, nodes, n, steps):
    at = {i: (x, y) for i, x, y in nodes}
    here, line = rng.randrange(n * n), []
    for _ in range(steps):
        i, j = divmod(here, n)
        there = rng.choice([k for k in (here - 1 if j else -1, here + 1 if j < n - 1 else -1, here - n, here + n) if 0 <= k < n * n])
        for t in sorted(rng.uniform(0, 1) for _ in range(rng.randint(1, 3))):
            (x1, y1), (x2, y2) = at[here], at[there]
            line.append((x1 + (x2 - x1) * t + rng.gauss(0, 5e-5), y1 + (y2 - y1) * t + rng.gauss(0, 5e-5)))
        here = there
    return line


def cost_of(row, states, nodes, ways):
    return row["cost"]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_line_by_line(spark, seed):
    rng = random.Random(seed)
    nodes, ways = town(seed)
    lines = [(k, walk(rng, nodes, 5, rng.randint(1, 6))) for k in range(25)]
    lines += [(90, [(144.9, -37.8)]), (91, []), (92, [(10.0, 10.0), (10.001, 10.0)]), (93, lines[0][1] + lines[0][1][::-1])]
    args = spark.createDataFrame(lines, f"id long, line {LINE}"), spark.createDataFrame(ways, WAYS), spark.createDataFrame(nodes, NODES)
    one = {int(r["line_id"]): r for r in matching.match_lines(*args, 0.03).collect()}
    all_ = {r["line_id"]: r for r in trellis.match_lines(*args, 0.03).collect()}
    assert set(one) == set(all_) and 91 not in all_
    same = 0
    for k, r in one.items():
        got = all_[k]
        assert got["error"] == r["error"], k
        if r["error"] is None:
            assert got["cost"] == pytest.approx(r["cost"], abs=0.005)
            assert got["offset_start"] == pytest.approx(r["offset_start"], abs=1e-6) or got["nodes"] != r["nodes"]
            same += (got["nodes"], got["ways"]) == (r["nodes"], r["ways"])
    matched = sum(r["error"] is None for r in one.values())
    assert matched > 15 and same >= matched - 1  # ways of equal cost may differ


def test_distances_within_reach(spark):
    links = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 2.5), (3, 4, 1.0), (4, 1, 1.0)], "src long, dst long, km double")
    starts = spark.createDataFrame([(1, 3.0), (2, 1.5), (9, 1.0)], "start long, reach double")
    found = {(r["start"], r["node"]): (r["km"], r["before"]) for r in trellis.bounded_distances(links, starts).collect()}
    assert found == {(1, 1): (0, None), (1, 2): (1, 1), (1, 3): (2, 2), (1, 4): (3, 3), (2, 2): (0, None), (2, 3): (1, 2), (9, 9): (0, None)}


def test_the_other_carriageway_and_parts(spark):
    """Two one-way streets side by side: a line that runs both ways finds both of them."""
    d = 0.0001
    nodes = [(k, 144.9 + k * 0.001, -37.8) for k in range(5)] + [(10 + k, 144.9 + k * 0.001, -37.8 - d) for k in range(5)]
    ways = [(1, [0, 1, 2, 3, 4], True, False), (2, [14, 13, 12, 11, 10], True, False)]
    mid = -37.8 - d / 2
    run = lambda a, b: [(144.9 + t * 0.001, mid) for t in (a, (a + b) / 2, b)]
    features = [(1, [run(0.2, 1.8), run(1.8, 3.7)], True), (2, [run(0.2, 3.7)], False), (3, [run(3.7, 0.2)], True), (4, [[(0.0, 0.0), (0.1, 0.0)]], True)]
    df = spark.createDataFrame(features, f"id long, parts array<{LINE}>, both_ways boolean")
    found = {r["id"]: r for r in trellis.match_parts(df, spark.createDataFrame(ways, WAYS), spark.createDataFrame(nodes, NODES)).collect()}
    assert sorted(found[1]["ways"]) == [1, 2] and found[1]["error"] is None
    assert len(found[1]["parts"]) >= 2 and [0, 1, 2] == found[1]["parts"][0][:3]
    assert found[2]["ways"] == [1] and found[2]["parts"] == [[0, 1, 2, 3, 4]]
    assert sorted(found[3]["ways"]) == [1, 2]
    assert found[4]["error"] == matching.FAILED
