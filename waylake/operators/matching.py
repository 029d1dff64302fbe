"""Hidden-Markov map matching.

States, the positions on ways near each point of a line, come from a grid join; the edges around each
line come from another one. A line's states and edges then meet in one group, where a small program
runs over the trellis. Groups are lines, so their size is that of a line and its surroundings.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from waylake.functions import geo
from waylake.operators import spatial

SIGMA_M, BETA_M = 10.0, 1.0


def emission(metres: Column, sigma: float = SIGMA_M) -> Column:
    """exp(-(d / sigma)^2 / 2), not normalised."""
    return F.exp(-0.5 * F.pow(metres / sigma, 2))


def transition(metres: Column, beta: float = BETA_M) -> Column:
    """exp(-|d| / beta) of the difference between straight and road distance."""
    return F.exp(-F.abs(metres) / beta)


def cost(probability: Column) -> Column:
    """-ln p to three decimals; null for p = 0, which can't be reached."""
    return F.when(probability > 0, F.round(-F.log(F.least(probability, F.lit(1.0))), 3))


def vertices(lines: DataFrame) -> DataFrame:
    """(point_id, line_id, step, x, y) without repeated neighbours; lines: id, line."""
    w = W.partitionBy("line_id").orderBy("i")
    p = lines.select(F.col("id").alias("line_id"), F.posexplode("line").alias("i", "p")).select("line_id", "i", "p.x", "p.y")
    same = (F.lag("x").over(w) == F.col("x")) & (F.lag("y").over(w) == F.col("y"))
    kept = p.withColumn("_same", F.coalesce(same, F.lit(False))).where(~F.col("_same"))
    return kept.select(F.struct("line_id", F.col("i").alias("step")).alias("point_id"), "line_id", F.row_number().over(w).alias("step"), "x", "y")


def segments(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, seg, n1, n2, x1, y1, x2, y2, km, forward, backward); ways: id, nodes, oneway, reverseway; nodes: id, x, y."""
    pair = F.zip_with(
        F.slice("nodes", F.lit(1), F.size("nodes") - 1), F.slice("nodes", F.lit(2), F.size("nodes") - 1), lambda a, b: F.struct(a.alias("n1"), b.alias("n2"))
    )
    s = ways.where(F.size("nodes") > 1).select(
        F.col("id").alias("way_id"), (~F.col("reverseway")).alias("forward"), (F.col("reverseway") | ~F.col("oneway")).alias("backward"), F.posexplode(pair).alias("seg", "e")
    )
    a = nodes.select(F.col("id").alias("n1"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col("id").alias("n2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    placed = s.select("way_id", "seg", "forward", "backward", "e.n1", "e.n2").join(a, "n1").join(b, "n2")
    return placed.withColumn("km", geo.haversine_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))


def states(points: DataFrame, segs: DataFrame, radius_km: float, size: float) -> DataFrame:
    """One state per point and way within the radius."""
    hits = spatial.nearest_on_way(spatial.within_km(points, segs, radius_km, size))
    return hits.join(segs.select("way_id", "seg", "n1", "n2"), ["way_id", "seg"]).join(points, "point_id").select(
        "line_id", "step", "x", "y", "way_id", "n1", "n2", "pos", "km"
    )


def surroundings(points: DataFrame, segs: DataFrame, size: float) -> DataFrame:
    """The segments that a line's matching may travel: those that meet its box, widened by twice its longest
    step and a tenth of a kilometre (paths are searched up to twice the straight distance)."""
    w = W.partitionBy("line_id").orderBy("step")
    hop = geo.haversine_km(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y"))
    box = points.withColumn("hop", hop).groupBy("line_id").agg(
        F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.coalesce(F.max("hop"), F.lit(0.0)).alias("hop")
    )
    pad = F.degrees((2 * F.col("hop") + 0.1) / geo.RADIUS_KM) * 2
    box = box.select(F.col("line_id").alias("id"), (F.col("x1") - pad).alias("x1"), (F.col("y1") - pad).alias("y1"), (F.col("x2") + pad).alias("x2"), (F.col("y2") + pad).alias("y2"))
    low, high = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    seg_box = segs.select(
        F.struct("way_id", "seg").alias("id"), low("x1", "x2").alias("x1"), low("y1", "y2").alias("y1"), high("x1", "x2").alias("x2"), high("y1", "y2").alias("y2")
    )
    met = spatial.boxes_meet(box, seg_box, size)
    return met.select(F.col("a_id").alias("line_id"), "b_id.way_id", "b_id.seg").join(segs, ["way_id", "seg"]).select("line_id", "way_id", "n1", "n2", "km", "forward", "backward")


# the program for one line


class Roads:
    """Directed edges around a line."""

    def __init__(self, edges: list[tuple[int, int, int, float, bool, bool]]):
        self.km: dict[tuple[int, int], float] = {}
        self.out: dict[int, list[tuple[int, float]]] = {}
        for _, a, b, km, forward, backward in edges:
            for u, v, allowed in ((a, b, forward), (b, a, backward)):
                if allowed:
                    self.km[u, v] = km
                    self.out.setdefault(u, []).append((v, km))

    def path(self, u: tuple[int, int, float], v: tuple[int, int, float], cap: float) -> tuple[float, list[int]] | None:
        """(km, nodes) of the shortest way between two points (n1, n2, pos on the edge), within a cap.

        On one edge the way is straight along it, or none if the edge doesn't allow it.
        """
        (a, b, p), (c, d, q) = u, v
        if (a, b) in ((c, d), (d, c)):
            q = q if (a, b) == (c, d) else 1 - q
            edge = (a, b) if p <= q else (b, a)
            return (abs(p - q) * self.km[edge], list(edge)) if edge in self.km else None
        best: dict[int, float] = {}
        before: dict[int, int] = {}
        queue: list[tuple[float, int]] = []
        for edge, share in (((a, b), 1 - p), ((b, a), p)):
            # a point on a node may leave it by any of its edges
            km = share * self.km[edge] if edge in self.km else 0.0 if share == 0 else None
            if km is not None and km < best.get(edge[1], math.inf):
                best[edge[1]], before[edge[1]] = km, edge[0]
                heapq.heappush(queue, (km, edge[1]))
        goals = {}
        for edge, share in (((c, d), q), ((d, c), 1 - q)):
            if edge in self.km or share == 0:
                goals[edge[0]] = (share * self.km.get(edge, 0.0), edge[1])
        found: tuple[float, int] | None = None
        done: set[int] = set()
        while queue:
            km, n = heapq.heappop(queue)
            if n in done or km > cap or found and km >= found[0]:
                continue
            done.add(n)
            if n in goals and km + goals[n][0] <= cap and (not found or km + goals[n][0] < found[0]):
                found = (km + goals[n][0], n)
            for m, w in self.out.get(n, ()):
                if km + w < best.get(m, math.inf) and km + w <= cap:
                    best[m], before[m] = km + w, n
                    heapq.heappush(queue, (km + w, m))
        if found is None:
            return None
        nodes = [found[1]]
        while nodes[-1] in before and len(nodes) <= len(before) + 1:
            nodes.append(before[nodes[-1]])
            if nodes[-1] in (a, b) and nodes[-1] not in done:
                break
            if {nodes[-1], nodes[-2]} == {a, b}:
                break
        nodes.reverse()
        # the start and goal edges count only as far as they are travelled
        if p in (0.0, 1.0) and len(nodes) > 1 and {nodes[0], nodes[1]} == {a, b} and nodes[1] == (a if p == 0.0 else b):
            nodes = nodes[1:]
        tail = goals[found[1]][1]
        return found[0], nodes if goals[found[1]][0] == 0 and len(nodes) > 1 else [*nodes, tail]


# Rules over one character per element: what the pattern finds shrinks to its first group.
_REPEAT, _REPEATED_PAIR, _DETOUR = (re.compile(x, re.S) for x in (r"(.)\1+", r"(..)\1+", r"(.)(?:.\1)+"))


def _shrunk(path: list, rules: list[re.Pattern], long_rules: list[re.Pattern] | None = None, forever: bool = False) -> list:
    elements = list(dict.fromkeys(path))
    code = {x: chr(0x10000 + i) for i, x in enumerate(elements)}
    before, now = None, "".join(map(code.get, path))
    while now != before:
        before = now
        for rule in [*(long_rules or []), *rules] if len(now) > 3 else rules:
            now = rule.sub(r"\1", now)
        if not forever:
            break
    return [elements[ord(c) - 0x10000] for c in now]


def without_repeats(path: list) -> list:
    return _shrunk(path, [_REPEAT])


def without_repeated_pairs(path: list) -> list:
    """A pair that repeats the two elements before it goes."""
    return _shrunk(path, [_REPEATED_PAIR])


def without_detours(path: list) -> list:
    """A step aside and back again goes: A B A is A."""
    return _shrunk(path, [_DETOUR])


def tidy(path: list) -> list:
    """All three rules until nothing changes; of up to three elements only repeats go."""
    return _shrunk(path, [_REPEAT], [_REPEATED_PAIR, _DETOUR], forever=True)


def min_cost(states: DataFrame) -> DataFrame:
    """(id, cost): the smallest cost of a path through all steps of each line; states: id, step (1, 2, ...), way, q.

    A state costs q, a move the difference of the ways. The states of one line are folded step by step."""
    steps = states.groupBy("id", "step").agg(F.collect_list(F.struct("way", "q")).alias("states"))
    lines = steps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("step", "states"))).alias("steps"))
    first = F.transform(F.element_at("steps", 1)["states"], lambda s: F.struct(s["way"].alias("way"), s["q"].alias("cost")))

    def fold(best: Column, step: Column) -> Column:
        reach = lambda s: F.array_min(F.transform(best, lambda b: b["cost"] + F.abs(b["way"] - s["way"])))
        return F.transform(step["states"], lambda s: F.struct(s["way"].alias("way"), (reach(s) + s["q"]).alias("cost")))

    rest = F.slice("steps", F.lit(2), F.size("steps"))
    return lines.select("id", F.array_min(F.transform(F.aggregate(rest, first, fold), lambda b: b["cost"])).alias("cost"))


def _chord(a: dict, b: dict) -> float:
    def place(s: dict) -> tuple[float, float, float]:
        x, y = math.radians(s["x"]), math.radians(s["y"])
        return math.cos(y) * math.cos(x), math.cos(y) * math.sin(x), math.sin(y)

    return geo.RADIUS_KM * math.dist(place(a), place(b))


def _cost(log_p: float) -> float:
    return round(max(0.0, -log_p), 3)


def best_path(steps: list[list[dict]], roads: Roads) -> tuple[float, list[dict], list[int]] | None:
    """(cost, states, nodes) of the cheapest way through the trellis: a minimum over steps, since every edge
    of the trellis leads to the next step (X20-X23)."""
    total = [(_cost(-0.5 * (s["km"] * 1000 / SIGMA_M) ** 2), [i]) for i, s in enumerate(steps[0])]
    cache: dict[tuple, tuple[float, list[int]] | None] = {}

    def road(u: dict, v: dict, cap: float) -> tuple[float, list[int]] | None:
        a, b = (u["n1"], u["n2"], u["pos"]), (v["n1"], v["n2"], v["pos"])
        if a == b:
            return 0.0, []
        key = (a, b, cap)
        if key not in cache:
            cache[key] = roads.path(a, b, cap)
        return cache[key]

    cap_of = lambda u, v: 2 * _chord(u, v) if _chord(u, v) > 1e-9 else 0.1
    for k in range(1, len(steps)):
        following = []
        for j, v in enumerate(steps[k]):
            own = _cost(-0.5 * (v["km"] * 1000 / SIGMA_M) ** 2)
            best = (math.inf, [])
            for i, u in enumerate(steps[k - 1]):
                if total[i][0] == math.inf:
                    continue
                way = road(u, v, cap_of(u, v))
                off = None if way is None else abs(_chord(u, v) - way[0]) * 1000 / BETA_M
                if off is None or math.exp(-off) == 0.0:
                    continue  # unreachable
                c = total[i][0] + _cost(-off) + own
                if c < best[0]:
                    best = (c, [*total[i][1], j])
            following.append(best)
        total = following
    end = min(range(len(total)), key=lambda i: total[i][0], default=None)
    if end is None or total[end][0] == math.inf:
        return None
    chosen = [steps[k][i] for k, i in enumerate(total[end][1])]
    nodes: list[int] = []
    for u, v in zip(chosen, chosen[1:]):
        nodes += road(u, v, cap_of(u, v))[1]  # type: ignore[index]
    return total[end][0], chosen, tidy(nodes)


SCHEMA = "line_id string, nodes array<long>, ways array<long>, cost double, offset_start double, offset_end double, error string"
FAILED = "Failed to find path"


def _match(line_id: str, n: int, states: list, edges: list) -> tuple:
    failed = (line_id, None, None, None, None, None, FAILED)
    steps: list[list[dict]] = [[] for _ in range(n)]
    for s in states:
        steps[s["step"] - 1].append(s)
    if n < 2 or not all(steps):
        return failed
    found = best_path(steps, Roads([(e["way_id"], e["n1"], e["n2"], e["km"], e["forward"], e["backward"]) for e in edges]))
    if found is None or len(found[2]) < 2:
        return failed
    total, chosen, nodes = found
    way = {(a, b): e["way_id"] for e in reversed(edges) for a, b in ((e["n1"], e["n2"]), (e["n2"], e["n1"]))}
    ways = without_repeats([way[e] for e in zip(nodes, nodes[1:]) if e in way])
    start, end = chosen[0], chosen[-1]
    offset_start = 1 - start["pos"] if start["n2"] == nodes[0] else start["pos"]
    offset_end = 1 - end["pos"] if end["n2"] == nodes[-1] else end["pos"]
    return line_id, nodes, ways, round(total, 3), offset_start, offset_end, None


def match_lines(lines: DataFrame, ways: DataFrame, nodes: DataFrame, radius_km: float = 0.02, size: float = 0.02) -> DataFrame:
    """Match lines (id, line) to a road graph; one row per line with points, failed ones with an error text."""
    points = vertices(lines)
    segs = segments(ways, nodes)
    count = points.groupBy("line_id").agg(F.count("*").alias("n_steps"))
    per_line = lambda df, cols, name: df.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    s = per_line(states(points, segs, radius_km, size), ["step", "way_id", "x", "y", "n1", "n2", "pos", "km"], "states")
    e = per_line(surroundings(points, segs, size), ["way_id", "n1", "n2", "km", "forward", "backward"], "edges")
    whole = count.join(s, "line_id", "left").join(e, "line_id", "left").withColumn("line_id", F.col("line_id").cast("string"))
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                _match(line, int(n), found if found is not None else [], roads if roads is not None else [])
                for line, n, found, roads in batch[["line_id", "n_steps", "states", "edges"]].itertuples(index=False, name=None)
            ]
            yield pd.DataFrame(rows, columns=names)

    return whole.mapInPandas(run, SCHEMA)
