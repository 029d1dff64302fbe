"""Overlay of polygons: areas and rings of intersection, union and difference, and repair of rings that cross themselves.

The shapes of a pair are cut into horizontal strips at every vertex and every crossing of their edges, so that within
a strip no two edges cross. Ordered from left to right, each edge of a strip turns the inside of its shape on or off
(even-odd rule), which says for every trapezoid between two neighbouring edges whether it lies in a, in b, or in both.
Everything is edges as rows: crossings come from an equi-join on bands of a pair, strips from windows, areas from sums.
Only linking the remaining boundary pieces to rings is a small program per pair. Areas of small single rings, of which there
may be one per match, are computed in place: their rows need no shuffle.

Shapes: ``pair``, ``side`` ('a' or 'b') and ``ring``, an array<struct<x,y>>, closed or open. A side may have several rings;
by the even-odd rule a ring inside another is a hole. Rings without area, null rings and repeated points are fine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from waylake.functions import geo
from waylake.functions.rows import with_program
from waylake.functions.storage import materialise
from waylake.operators import polygons, spatial, tiles

#: Whether a place in a (first) and in b (second) belongs to the result.
OPS = {
    "both": lambda a, b: a & b,
    "either": lambda a, b: a | b,
    "only_a": lambda a, b: a & ~b,
    "only_b": lambda a, b: b & ~a,
    "one": lambda a, b: a != b,
    "a": lambda a, b: a,
}
PAIR_OPS = ("both", "only_a", "only_b")
#: Places closer than this share of a pair's size are one place when rings are linked.
SNAP = 1e-10
#: Rings of at most so many points are computed where they are; larger ones as edges in rows.
MOST_IN_PLACE = 64
#: Numbers in one array while rings are computed in place.
_MOST_NUMBERS = 2_000_000


def ring_edges(shapes: DataFrame) -> DataFrame:
    """(pair, side, e, x1, y1, x2, y2) of every edge that isn't horizontal, upwards; e numbers a pair's edges."""
    closed = F.concat("ring", F.slice("ring", 1, 1))
    s = shapes.select("pair", "side", F.explode(geo.steps(closed)).alias("s")).where("s.a.y != s.b.y")
    up = F.col("s.a.y") < F.col("s.b.y")
    end = lambda at, c: F.when(up, F.col(f"s.{at}.{c}")).otherwise(F.col(f"s.{'b' if at == 'a' else 'a'}.{c}"))
    rows = s.select("pair", "side", end("a", "x").alias("x1"), end("a", "y").alias("y1"), end("b", "x").alias("x2"), end("b", "y").alias("y2"))
    order = W.partitionBy("pair").orderBy("y1", "x1", "y2", "x2", "side")
    return rows.withColumn("e", F.row_number().over(order))


def _crossings(edges: DataFrame) -> DataFrame:
    """(pair, side, e, at, x, y): places inside an edge, the share ``at`` along it, where another one of its pair crosses or ends.
    Both edges get the same numbers. Edges meet in bands of about two edges' height."""
    size = W.partitionBy("pair")
    low, high, n = F.min("y1").over(size), F.max("y2").over(size), F.count("*").over(size)
    banded = edges.withColumns({"_low": low, "_step": (high - low) / F.greatest(F.ceil(n / 2), F.lit(1))})
    band = lambda y: F.floor((F.col(y) - F.col("_low")) / F.col("_step")).cast("int")
    banded = banded.withColumn("band", F.explode(F.sequence(band("y1"), band("y2"))))
    names = ["side", "e", "x1", "y1", "x2", "y2"]
    p = banded.select("pair", "band", *[F.col(c).alias(f"p_{c}") for c in names])
    q = banded.select("pair", "band", *[F.col(c).alias(f"q_{c}") for c in names])
    c = F.col
    dx, dy, ex, ey = c("p_x2") - c("p_x1"), c("p_y2") - c("p_y1"), c("q_x2") - c("q_x1"), c("q_y2") - c("q_y1")
    gx, gy, den = c("q_x1") - c("p_x1"), c("q_y1") - c("p_y1"), dx * ey - dy * ex
    overlap = (c("p_e") < c("q_e")) & (F.least("p_x1", "p_x2") <= F.greatest("q_x1", "q_x2")) & (F.least("q_x1", "q_x2") <= F.greatest("p_x1", "p_x2"))
    met = p.join(q, ["pair", "band"]).where(overlap & (den != 0))
    met = met.select("pair", *[c(f"{r}_{k}") for r in "pq" for k in names], ((gx * ey - gy * ex) / den).alias("p_at"), ((gx * dy - gy * dx) / den).alias("q_at"))
    met = met.where("p_at >= 0 and p_at <= 1 and q_at >= 0 and q_at <= 1 and (p_at > 0 and p_at < 1 or q_at > 0 and q_at < 1)")
    ends = [(c(f"{r}_at") == n, c(f"{r}_x{n + 1}"), c(f"{r}_y{n + 1}")) for r in "pq" for n in (0, 1)]

    def place(k: int, inside: Column) -> Column:
        for at_end, *xy in reversed(ends):
            inside = F.when(at_end, xy[k]).otherwise(inside)
        return inside

    x, y = place(0, c("p_x1") + c("p_at") * (c("p_x2") - c("p_x1"))), place(1, c("p_y1") + c("p_at") * (c("p_y2") - c("p_y1")))
    both = F.array(*[F.struct(*[c(f"{r}_{k}").alias(k) for k in ("side", "e", "at")]) for r in "pq"])
    # an edge on a border of bands meets another one twice
    return met.select("pair", x.alias("x"), y.alias("y"), F.explode(both).alias("s")).where("s.at > 0 and s.at < 1").select("pair", "s.*", "x", "y").distinct()


def _parted(edges: DataFrame) -> DataFrame:
    """(pair, side, x1, y1, x2, y2): the edges in parts that meet others at their ends only, upwards. The place of a crossing is
    kept rather than computed from a part's slope at each cut, which loses it on an edge that is nearly horizontal."""
    end = lambda at: edges.select("pair", "side", "e", F.lit(float(at)).alias("at"), F.col(f"x{at + 1}").alias("x"), F.col(f"y{at + 1}").alias("y"))
    places = end(0).unionByName(end(1)).unionByName(_crossings(edges))
    along = W.partitionBy("pair", "side", "e").orderBy("at")
    part = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))  # the lower end first
    parts = places.select("pair", "side", F.struct("y", "x").alias("a"), F.lead(F.struct("y", "x")).over(along).alias("b")).where("a.y != b.y")
    return parts.select("pair", "side", part.alias("s")).select("pair", "side", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def slabs(shapes: DataFrame) -> DataFrame:
    """(pair, lo, hi, x_lo, x_hi, n_lo, n_hi, in_a, in_b, was_a, was_b): per strip and edge, the edge, the next one to its
    right (null after the last), and whether the places right and left of the edge lie in a and b."""
    edges = materialise(_parted(materialise(ring_edges(shapes), "overlay-edges")), "overlay-parts")
    ys = edges.select("pair", F.explode(F.array("y1", "y2")).alias("y")).distinct()
    along = W.partitionBy("pair").orderBy("y")
    strips = materialise(ys.withColumns({"k": F.row_number().over(along), "hi": F.lead("y").over(along)}), "overlay-strips")
    at = lambda y, k: strips.select("pair", F.col("y").alias(y), F.col("k").alias(k))
    placed = edges.join(at("y1", "k1"), ["pair", "y1"]).join(at("y2", "k2"), ["pair", "y2"])
    placed = placed.withColumn("k", F.explode(F.sequence(F.col("k1"), F.col("k2") - 1)))
    cut = placed.join(strips.select("pair", "k", F.col("y").alias("lo"), "hi"), ["pair", "k"])
    slope = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    x_lo = F.when(F.col("lo") == F.col("y1"), F.col("x1")).otherwise(F.col("x1") + (F.col("lo") - F.col("y1")) * slope)
    x_hi = F.when(F.col("hi") == F.col("y2"), F.col("x2")).otherwise(F.col("x1") + (F.col("hi") - F.col("y1")) * slope)
    cut = cut.select("pair", "k", "side", "lo", "hi", x_lo.alias("x_lo"), x_hi.alias("x_hi"))
    order = W.partitionBy("pair", "k").orderBy(F.col("x_lo") + F.col("x_hi"), "side", "x_lo")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    n = lambda side: F.sum((F.col("side") == side).cast("int")).over(so_far)
    told = cut.withColumns({"n_a": n("a"), "n_b": n("b"), "n_lo": F.lead("x_lo").over(order), "n_hi": F.lead("x_hi").over(order)})
    odd = lambda c: F.col(c) % 2 == 1
    was = lambda side: (F.col(f"n_{side}") - (F.col("side") == side).cast("int")) % 2 == 1
    return told.select("pair", "lo", "hi", "x_lo", "x_hi", "n_lo", "n_hi", odd("n_a").alias("in_a"), odd("n_b").alias("in_b"), was("a").alias("was_a"), was("b").alias("was_b"))


def areas(shapes: DataFrame) -> DataFrame:
    """(pair, and the area of every one of OPS), in the square of the unit of the coordinates; 0 where nothing has area."""
    area = (F.col("n_lo") + F.col("n_hi") - F.col("x_lo") - F.col("x_hi")) / 2 * (F.col("hi") - F.col("lo"))
    sums = [F.coalesce(F.sum(F.when(f(F.col("in_a"), F.col("in_b")), area)), F.lit(0.0)).alias(op) for op, f in OPS.items()]
    found = slabs(shapes).groupBy("pair").agg(*sums)
    return shapes.select("pair").distinct().join(found, "pair", "left").select("pair", *[F.coalesce(op, F.lit(0.0)).alias(op) for op in OPS])


def _snapped(pieces: DataFrame) -> DataFrame:
    """Pieces (pair, lo, hi, x_lo, x_hi, turn) whose ends are one place where they lie closer than SNAP: in the order of y, and
    of x at one y, a place no farther than that from the one before takes its value. Rounding would part some of them."""
    every = W.partitionBy("pair")
    grain = (F.max("hi").over(every) - F.min("lo").over(every)) * SNAP
    numbered = pieces.withColumns({"i": F.row_number().over(every.orderBy("lo", "hi", "x_lo", "x_hi", "turn")), "grain": grain})
    end = lambda c: F.struct(F.col(f"x_{c}").alias("x"), F.col(c).alias("y"), F.lit(c == "hi").alias("top"))
    places = numbered.select("pair", "i", "turn", "grain", F.explode(F.array(end("lo"), end("hi"))).alias("p")).select("pair", "i", "turn", "grain", "p.*")
    for c, by in (("y", ["pair"]), ("x", ["pair", "y"])):
        order = W.partitionBy(*by).orderBy(c)
        apart = F.coalesce(F.col(c) - F.lag(c).over(order) > F.col("grain"), F.lit(True))
        places = places.withColumn("_first", F.when(apart, F.col(c)))
        places = places.withColumn(c, F.last("_first", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_first")
    at = lambda c, top: F.max(F.when(F.col("top") == top, F.col(c)))
    ends = [at("y", False).alias("lo"), at("y", True).alias("hi"), at("x", False).alias("x_lo"), at("x", True).alias("x_hi")]
    return places.groupBy("pair", "i", "turn").agg(*ends).drop("i")


def boundary(shapes: DataFrame, op: str) -> DataFrame:
    """(pair, ax, ay, bx, by): directed pieces of the boundary of the result, which lies on their left."""
    inside, outside = OPS[op](F.col("in_a"), F.col("in_b")), OPS[op](F.col("was_a"), F.col("was_b"))
    # left ends of the inside count 1, right ends -1; pieces that lie on each other cancel
    turn = inside.cast("int") - outside.cast("int")
    s = slabs(shapes).select("pair", "lo", "hi", "x_lo", "x_hi", turn.alias("turn")).where("turn != 0")
    ends = _snapped(s).where("lo != hi")
    sides = ends.groupBy("pair", "lo", "hi", "x_lo", "x_hi").agg(F.sum("turn").alias("turn")).where("turn != 0")
    down = sides.where("turn > 0").selectExpr("pair", "x_hi as ax", "hi as ay", "x_lo as bx", "lo as by")
    up = sides.where("turn < 0").selectExpr("pair", "x_lo as ax", "lo as ay", "x_hi as bx", "hi as by")
    # along a cut, the strip above opens what is inside it, the strip below closes it
    flat = ends.selectExpr("pair", "lo as y", "x_lo as x", "turn").union(ends.selectExpr("pair", "hi as y", "x_hi as x", "-turn as turn"))
    flat = flat.groupBy("pair", "y", "x").agg(F.sum("turn").alias("turn"))
    across = W.partitionBy("pair", "y").orderBy("x")
    flat = flat.withColumns({"net": F.sum("turn").over(across.rowsBetween(W.unboundedPreceding, 0)), "x2": F.lead("x").over(across)}).where("net != 0 and x2 is not null")
    level = flat.select("pair", F.expr("if(net > 0, x, x2) as ax"), F.col("y").alias("ay"), F.expr("if(net > 0, x2, x) as bx"), F.col("y").alias("by"))
    return down.union(up).union(level)


def linked(pieces: list[tuple[float, float, float, float]]) -> list[list[tuple[float, float]]]:
    """Rings from directed pieces; where several start from one place, the sharpest turn to the left goes on."""
    out: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for ax, ay, bx, by in sorted(pieces):
        out.setdefault((ax, ay), []).append((bx, by))
    rings = []
    for start in sorted(out):
        while out[start]:
            ring, here = [start], out[start].pop(0)
            while here != start and out.get(here):
                px, py = ring[-1]
                dx, dy = here[0] - px, here[1] - py
                turn = lambda q: math.atan2(dx * (q[1] - here[1]) - dy * (q[0] - here[0]), dx * (q[0] - here[0]) + dy * (q[1] - here[1]))  # noqa: B023, E731
                ring.append(here)
                following = max(out[here], key=turn)
                out[here].remove(following)
                here = following
            rings.append(_without_straight_points(ring))
    return [r for r in rings if len(r) > 2]


def _without_straight_points(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    scale = max(max(abs(x - ring[0][0]), abs(y - ring[0][1])) for x, y in ring) or 1.0
    kept = list(ring)
    k = 0
    while len(kept) > 2 and k < len(kept):
        (ax, ay), (bx, by), (cx, cy) = kept[k - 1], kept[k], kept[(k + 1) % len(kept)]
        if abs((bx - ax) * (cy - by) - (by - ay) * (cx - bx)) <= 4 * SNAP * scale * math.hypot(cx - ax, cy - ay):
            del kept[k]
            k = max(k - 1, 0)
        else:
            k += 1
    return kept


def rings(shapes: DataFrame, op: str) -> DataFrame:
    """(pair, rings): outer rings counter-clockwise, holes clockwise, each without its first point repeated; pairs whose
    result has no area don't come out. A pair's boundary is linked in one task."""

    def link(pieces: list) -> list:
        return [[{"x": x, "y": y} for x, y in ring] for ring in linked([(p["ax"], p["ay"], p["bx"], p["by"]) for p in pieces])]

    pieces = boundary(shapes, op).groupBy("pair").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("pieces"))  # one pair's boundary
    return with_program(pieces, "rings", f"array<{geo.LINE}>", link, "pieces").select("pair", "rings").where(F.size("rings") > 0)


def repaired(polygons: DataFrame) -> DataFrame:
    """(pair, rings) of single polygons (pair, ring) as their inside by the even-odd rule, without crossings."""
    return rings(polygons.withColumn("side", F.lit("a")).select("pair", "side", "ring"), "a")


def even_odd_areas(rings: np.ndarray) -> np.ndarray:
    """Areas of rings of n points each, (rings, n, 2), by the strips of the module's head: those of one ring side by side."""
    n = rings.shape[1]
    x1, y1 = rings[..., 0], rings[..., 1]
    x2, y2 = np.roll(x1, -1, axis=1), np.roll(y1, -1, axis=1)
    p, q = np.triu_indices(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        dx, dy, ex, ey = (x2 - x1)[:, p], (y2 - y1)[:, p], (x2 - x1)[:, q], (y2 - y1)[:, q]
        gx, gy, den = x1[:, q] - x1[:, p], y1[:, q] - y1[:, p], dx * ey - dy * ex
        s, t = (gx * ey - gy * ex) / den, (gx * dy - gy * dx) / den
        crossed = np.where((den != 0) & (s > 0) & (s < 1) & (t > 0) & (t < 1), y1[:, p] + s * dy, np.nan)
        cuts = np.sort(np.concatenate([y1, crossed], axis=1), axis=1)  # not a number comes last
        most = int((~np.isnan(cuts)).sum(axis=1).max(initial=0))
        lo, hi = cuts[:, : max(most - 1, 0), None], cuts[:, 1:most, None]
        a, b = y1[:, None, :], y2[:, None, :]
        across = (np.minimum(a, b) <= lo) & (np.maximum(a, b) >= hi) & (hi > lo)
        middle = np.where(across, x1[:, None, :] + ((lo + hi) / 2 - a) * (x2 - x1)[:, None, :] / (b - a), np.nan)
        middle = np.sort(middle, axis=2)
    # a strip has an even number of edges
    widths = np.nan_to_num(middle[..., 1::2] - middle[..., : n - n % 2 : 2]).sum(axis=2)
    return np.nansum(widths * (hi - lo)[..., 0], axis=1)


def pair_areas(a: tiles.Shapes, b: tiles.Shapes, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Areas of both, only_a and only_b of pairs of rings, by the strips of the module's head: those of one pair side by side.
    Coordinates count from a point of the pair on."""
    x1, y1, x2, y2 = [], [], [], []
    for x, y in ((a.x[:, i], a.y[:, i]), (b.x[:, j], b.y[:, j])):
        x, y = (x - a.x[0, i]).T, (y - a.y[0, i]).T
        for own, v in ((x1, x), (y1, y), (x2, np.roll(x, -1, axis=1)), (y2, np.roll(y, -1, axis=1))):
            own.append(v)
    x1, y1, x2, y2 = (np.concatenate(v, axis=1) for v in (x1, y1, x2, y2))
    n, of_a = x1.shape[1], np.arange(x1.shape[1]) < len(a.x)
    p, q = np.triu_indices(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        dx, dy, ex, ey = (x2 - x1)[:, p], (y2 - y1)[:, p], (x2 - x1)[:, q], (y2 - y1)[:, q]
        gx, gy, den = x1[:, q] - x1[:, p], y1[:, q] - y1[:, p], dx * ey - dy * ex
        s, t = (gx * ey - gy * ex) / den, (gx * dy - gy * dx) / den
        crossed = np.where((den != 0) & (s > 0) & (s < 1) & (t > 0) & (t < 1), y1[:, p] + s * dy, np.nan)
        cuts = np.sort(np.concatenate([y1, crossed], axis=1), axis=1)  # not a number comes last
        most = int((~np.isnan(cuts)).sum(axis=1).max(initial=0))
        lo, hi = cuts[:, : max(most - 1, 0), None], cuts[:, 1:most, None]
        u, v = y1[:, None, :], y2[:, None, :]
        across = (np.minimum(u, v) <= lo) & (np.maximum(u, v) >= hi) & (hi > lo)
        middle = np.where(across, x1[:, None, :] + ((lo + hi) / 2 - u) * (x2 - x1)[:, None, :] / (v - u), np.nan)
    order = np.argsort(middle, axis=2, kind="stable")
    middle, left = np.take_along_axis(middle, order, axis=2), of_a[order]
    in_a, in_b = np.cumsum(left, axis=2)[..., :-1] % 2 == 1, np.cumsum(~left, axis=2)[..., :-1] % 2 == 1
    widths = np.nan_to_num(middle[..., 1:] - middle[..., :-1])
    heights = np.nan_to_num((hi - lo)[..., 0])
    return np.arange(len(i)), {op: (np.where(OPS[op](in_a, in_b), widths, 0.0).sum(axis=2) * heights).sum(axis=1) for op in PAIR_OPS}


def areas_of_pairs(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a_id, b_id, both, either, only_a, only_b): areas of all pairs of rings (id, ring) whose boxes meet. Small rings come as tiles,
    pairs with another one as edges in rows; rings across 180 degrees are unrolled."""
    shape = lambda df: df.select("id", F.lit("polygon").alias("kind"), F.col("ring").alias("line"), F.lit(None).cast("double").alias("km"))
    (small_a, more_a), (small_b, more_b) = tiles.split(shape(a), size), tiles.split(shape(b), size)
    found = tiles.pairs(small_a, small_b, size, pair_areas, ", ".join(f"{op} double" for op in PAIR_OPS))
    found = found.select("a_id", "b_id", "both", (F.col("both") + F.col("only_a") + F.col("only_b")).alias("either"), "only_a", "only_b")
    for p, q in ((more_a, shape(b)), (small_a, more_b)):
        if not (more_a if p is more_a else more_b).isEmpty():
            found = found.union(_areas_by_rows(p, q, size))
    return found


def _areas_by_rows(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """areas_of_pairs() with edges as rows."""
    a, b = (df.where(F.size("line") > 0).select("id", "line") for df in (a, b))
    bound = lambda f, k: f(F.transform("line", lambda p: p[k]))
    box = lambda df: df.select("id", *[bound(F.array_min, k).alias(f"{k}1") for k in "xy"], *[bound(F.array_max, k).alias(f"{k}2") for k in "xy"])
    near = spatial.boxes_meet(box(a), box(b), size).withColumn("pair", F.struct("a_id", "b_id"))
    side = lambda df, s: near.join(df.select(F.col("id").alias(f"{s}_id"), F.col("line").alias("ring")), f"{s}_id").select("pair", F.lit(s).alias("side"), "ring")
    return areas(side(a, "a").union(side(b, "b"))).select("pair.a_id", "pair.b_id", "both", "either", "only_a", "only_b")


def _areas_in_place(df: DataFrame, ring: str, zone: str, name: str) -> DataFrame:
    """``df`` without ``ring`` and ``zone`` and with the area of each row's ring of degrees in metres of that UTM zone, 0 for
    null and under three points. Metres count from the first point on, so that products of large northings don't lose digits."""
    rest = [f for f in df.schema.fields if f.name not in (ring, zone)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(ring)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
            degrees = np.stack([c.to_numpy(zero_copy_only=False) for c in column.flatten().flatten()], axis=1)
            zones = batch.column(zone).fill_null(0).to_numpy(zero_copy_only=False)
            flat = polygons.utm(degrees, np.repeat(zones, sizes)) if len(degrees) else degrees
            starts, found = np.cumsum(sizes) - sizes, np.zeros(len(sizes))
            for n in np.unique(sizes[sizes > 2]):
                rows = np.flatnonzero(sizes == n)
                for part in np.array_split(rows, math.ceil(len(rows) * int(n) ** 3 / _MOST_NUMBERS)):
                    own = flat[starts[part][:, None] + np.arange(n)]
                    found[part] = even_odd_areas(own - own[:, :1])
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in rest], pa.array(found)], names=[*[f.name for f in rest], name])

    return df.mapInArrow(run, StructType([*rest, StructField(name, DoubleType())]))


def area_between(pairs: DataFrame, zone: Column | None = None) -> DataFrame:
    """``pairs`` (pair, a, b: two lines in degrees) with ``m2``, the area of the ring along a and back along b, in metres
    of the UTM zone of a's first point, and ``error``, that area over the mean of the lines' lengths (X15).

    Other columns of ``pairs`` go through. Rings of at most MOST_IN_PLACE points are computed in their rows."""
    z = geo.utm_zone(F.col("a")[0]["x"]) if zone is None else zone
    mean = (geo.length_km(F.col("a")) + geo.length_km(F.col("b"))) * 500
    size = F.coalesce(F.size("a") + F.size("b"), F.lit(0))
    few, many = (df.withColumns({"_zone": z, "_mean": mean}) for df in (pairs.where(size <= MOST_IN_PLACE), pairs.where(size > MOST_IN_PLACE)))
    here = _areas_in_place(few.withColumn("_ring", F.concat("a", F.reverse("b"))), "_ring", "_zone", "m2")
    flat = lambda line: F.transform(line, lambda p: geo.utm(p["x"], p["y"], F.col("_zone")))
    # coordinates from the first point on, as in place
    first = F.col("ring")[0]
    large = many.select("pair", F.lit("a").alias("side"), F.concat(flat("a"), F.reverse(flat("b"))).alias("ring"))
    large = large.withColumn("ring", F.transform("ring", lambda p: F.struct((p["x"] - first["x"]).alias("x"), (p["y"] - first["y"]).alias("y"))))
    there = many.drop("_zone").join(areas(large).select("pair", F.col("a").alias("m2")), "pair")
    return here.unionByName(there).withColumn("error", F.when(F.col("_mean") > 0, F.col("m2") / F.col("_mean"))).drop("_mean")


def area_to_parts(pairs: DataFrame) -> DataFrame:
    """(pair, m2, error) between a line ``a`` and the several ``parts`` of its match: the mean of the areas between the line and
    each part, over the length of the line (X15). Null without parts."""
    each = pairs.select("pair", "a", F.posexplode("parts").alias("k", "b")).where(F.size("b") > 0)
    found = area_between(each.select(F.struct("pair", "k").alias("pair"), "a", "b"))
    mean = found.groupBy(F.col("pair.pair").alias("pair")).agg(F.avg("m2").alias("m2"))
    rows = pairs.select("pair", (geo.length_km(F.col("a")) * 1000).alias("m")).join(mean, "pair", "left")
    return rows.select("pair", "m2", F.when(F.col("m") > 0, F.col("m2") / F.col("m")).alias("error"))
