"""Spatial joins on a grid: range, nearest on a way, k nearest, bounding boxes.

Both sides get grid cells and meet by an equi-join on the cell; the exact predicate comes after. A
crowded cell is salted, so it is dealt over several tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from waylake.functions import geo
from waylake.functions.storage import materialise
from waylake.operators import cells, tiles


#: A cell with more points than this is dealt over several tasks.
MOST_IN_CELL = 100_000


def _cells(df: DataFrame, x1: Column, y1: Column, x2: Column, y2: Column, size: float) -> DataFrame:
    """One row per grid cell that the box touches."""
    (cx1, cy1), (cx2, cy2) = geo.cell(x1, y1, size), geo.cell(x2, y2, size)
    return df.withColumn("_cx", F.explode(F.sequence(cx1, cx2))).withColumn("_cy", F.explode(F.sequence(cy1, cy2)))


def _around_the_world(df: DataFrame, x1: Column, x2: Column, world: float = 360.0) -> DataFrame:
    """One row per turn (``_turn``: -1, 0 or 1 times around) by which a range of longitudes meets the map."""
    half = world / 2
    turns = F.filter(F.array(*[F.lit(t * world) for t in (-1, 0, 1)]), lambda t: (t == 0) | ((x2 + t >= -half) & (x1 + t <= half)))
    return df.withColumn("_turn", F.explode(turns))


def _own_half(x: Column, middle: Column) -> Column:
    """Of several turns that are in reach near a pole, the nearest one only."""
    return (x >= middle - 180) & (x < middle + 180)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: filters on it aren't pushed below, where they would repeat it."""
    return df.withColumn(name, F.explode(F.array(value)))


def _dealt(points: DataFrame, others: DataFrame, key: str, cell: tuple[str, ...] = ("_cx", "_cy")) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_s``: points of a crowded cell get one of several numbers, the others all of them.

    Crowded cells are counted first. They are no more than a MOST_IN_CELLth of all points, so they are broadcast."""
    cell = [*cell]
    crowded = points.groupBy(*cell).agg(F.ceil(F.count("*") / MOST_IN_CELL).cast("int").alias("_n")).where("_n > 1")
    n = F.coalesce("_n", F.lit(1))
    p = points.join(F.broadcast(crowded), cell, "left").withColumn("_s", F.pmod(F.xxhash64(key), n).cast("int")).drop("_n")
    q = others.join(F.broadcast(crowded), cell, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), n - 1))).drop("_n")
    # few bytes, much to compute: as many tasks as the session asks for, not merged by size
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows made of cells are many more than the bytes they are made of make Spark expect, so neither side is broadcast
    return p.repartition(tasks, *cell, "_s"), q.hint("merge")


def within_km(points: DataFrame, segments: DataFrame, km: float, size: float, nearest: bool = False) -> DataFrame:
    """Points with every segment whose nearest position is within ``km`` (J22, J23). With ``nearest`` segments may be left
    out that are farther than the start of another one, so that what nearest_way() takes is few rows a point.

    points: point_id, x, y; segments: way_id, seg, x1, y1, x2, y2, at any latitude. A segment whose ends are more than 180
    degrees apart crosses 180 degrees. ``size`` is the cell size in degrees. Returns point_id, way_id, seg, pos, km.
    """
    c = F.col
    cx, cy = geo.cell(c("x"), c("y"), size)
    p = points.select("point_id", "x", "y")
    if nearest:
        starts = segments.select(c("x1").alias("px"), c("y1").alias("py"))
        p = _reached(points, starts, 1, size, km)[0].select("point_id", "x", "y", c("_km").alias("_p_km"))
        p = _once(p, "_p_up", F.degrees(c("_p_km") / geo.RADIUS_KM) + 1e-9)
        farthest = F.abs(c("y")) + c("_p_up")
        p = _once(p, "_p_across", F.when(farthest < 89.9, F.least(c("_p_up") / F.cos(F.radians(farthest)), F.lit(180.0))).otherwise(180.0))
    p = p.withColumns({"_cx": cx, "_cy": cy, "_cos": F.cos(F.radians(c("y"))), "_sin": F.sin(F.radians(c("y")))})
    s = segments.withColumn("x2", c("x2") - 360.0 * F.round((c("x2") - c("x1")) / 360.0))
    across, up = geo.reach_of_km(km, F.greatest(F.abs(c("y1")), F.abs(c("y2"))))
    s = _once(_once(s, "_across", across), "_up", up)
    s = _around_the_world(s, F.least("x1", "x2") - c("_across"), F.greatest("x1", "x2") + c("_across"))
    s = s.withColumns({x: c(x) + c("_turn") for x in ("x1", "x2")}).drop("_turn")
    box = F.least("x1", "x2") - c("_across"), F.least("y1", "y2") - c("_up"), F.greatest("x1", "x2") + c("_across"), F.greatest("y1", "y2") + c("_up")
    # what only one side tells is computed before the sides meet
    edges = {f"_{k}": v for k, v in zip(("west", "south", "east", "north"), box)}
    s = _once(s.withColumn("_middle", (c("x1") + c("x2")) / 2), "_b", F.struct(*[v.alias(k) for k, v in edges.items()])).select("way_id", "seg", "x1", "y1", "x2", "y2", "_middle", "_b.*")
    p, s = _dealt(p, _cells(s, *map(c, edges), size), "point_id")
    near = p.join(s, ["_cx", "_cy", "_s"]).where(c("x").between(c("_west"), c("_east")) & c("y").between(c("_south"), c("_north")) & _own_half(c("x"), c("_middle")))
    if nearest:
        near = near.where(c("x").between(F.least("x1", "x2") - c("_p_across"), F.greatest("x1", "x2") + c("_p_across")) & c("y").between(F.least("y1", "y2") - c("_p_up"), F.greatest("y1", "y2") + c("_p_up")))
    # geo.haversine_km() step by step, so that each value is computed once a pair, half angles first
    near = near.withColumn("pos", geo.project(c("x1"), c("y1"), c("x2"), c("y2"), c("x"), c("y")))
    near = near.withColumns({"_u": F.radians(c("y") - geo.lerp(c("y1"), c("y2"), c("pos"))) / 2, "_v": F.radians(c("x") - geo.lerp(c("x1"), c("x2"), c("pos"))) / 2})
    near = near.withColumns({"_u": geo.sin(c("_u")), "_v": geo.sin(c("_v"))})
    cos = c("_cos") + 2 * c("_u") * (c("_sin") * F.sqrt(1 - c("_u") * c("_u")) - c("_u") * c("_cos"))  # at the other latitude
    near = near.withColumn("_a", c("_u") * c("_u") + cos * c("_cos") * (c("_v") * c("_v")))
    near = near.withColumn("_a", F.sqrt(F.when(c("_a") > 1, 1.0).otherwise(c("_a"))))
    d = 2 * geo.RADIUS_KM * geo.asin(c("_a"))
    return _once(near, "km", d).where(c("km") <= km).select("point_id", "way_id", "seg", "pos", "km")


def nearest_on_way(hits: DataFrame) -> DataFrame:
    """The nearest position on each way of each point, from within_km()."""
    # the distance is an aggregate of its own: where it is all that is read, the hits of a task are folded as they come, unsorted
    best = F.min_by(F.struct("seg", "pos"), F.struct("km", "seg"))
    return hits.groupBy("point_id", "way_id").agg(best.alias("b"), F.min("km").alias("km")).select("point_id", "way_id", "b.seg", "b.pos", "km")


def nearest_way(hits: DataFrame) -> DataFrame:
    """The nearest position of all of each point, ties by way and segment, from within_km()."""
    best = F.min_by(F.struct("way_id", "seg", "pos", "km"), F.struct("km", "way_id", "seg"))
    return hits.groupBy("point_id").agg(best.alias("b")).select("point_id", "b.*")


#: Cells that tell how far a point must look are halved at most so often.
MOST_LEVELS = 16


def _leveled(df: DataFrame, x: str, y: str, size: float, levels: int) -> DataFrame:
    """A row's cell at each level; a level halves the cells of the one before, the coarsest are of ``size``."""
    df = df.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    return df.withColumns({name: F.floor(F.col(c) / _size(size)).cast("long") for name, c in (("_cx", x), ("_cy", y))})


def _size(size: float) -> Column:
    return F.lit(size) / F.pow(F.lit(2.0), F.col("_level"))


def _reached(points: DataFrame, places: DataFrame, k: int, size: float, km: float) -> tuple[DataFrame, int]:
    """Points with ``_level`` and ``_km``, and the number of levels: within ``_km`` of a point lie its k nearest places, or all
    that are within ``km``. A point looks as far as the smallest cell reaches that holds it and k places."""
    n, cells_taken = places.agg(F.count("*"), F.count_distinct(*geo.cell(F.col("px"), F.col("py"), size))).first()  # two numbers
    levels = 0 if n == 0 else min(MOST_LEVELS, max(0, math.ceil(math.log(max(n / cells_taken / k, 1), 4)) + 1))
    cell = ["_level", "_cx", "_cy"]
    full = _leveled(places.select("px", "py"), "px", "py", size, levels).groupBy(*cell).agg(F.count("*").alias("_n")).where(F.col("_n") >= k).select(*cell)
    held = _leveled(points.select("point_id", "x", "y"), "x", "y", size, levels).join(full, cell).groupBy("point_id").agg(F.max("_level").alias("_level"))
    p = points.select("point_id", "x", "y").join(held, "point_id", "left").withColumn("_held", F.col("_level").isNotNull()).withColumn("_level", F.coalesce("_level", F.lit(0)))
    # the diagonal of the cell where it is widest
    rad = F.radians(_size(size))
    south = F.floor(F.col("y") / _size(size)) * _size(size)
    low = F.when((south < 0) & (south + _size(size) > 0), 0.0).otherwise(F.least(F.abs(south), F.abs(south + _size(size))))
    half = F.sqrt(F.pow(rad, 2) + F.pow(rad * F.cos(F.radians(low)), 2)) / 2
    across = 2 * geo.RADIUS_KM * F.asin(F.least(half, F.lit(1.0))) * (1 + 1e-9)
    return p.withColumn("_km", F.when(F.col("_held"), F.least(across, F.lit(float(km)))).otherwise(float(km))).drop("_held"), levels


def nearest_k(points: DataFrame, places: DataFrame, k: int, size: float, km: float) -> DataFrame:
    """The k nearest places (place_id, px, py) within ``km`` of every point.

    Cells are of ``size`` where places are few and smaller where they are many, so that a point meets some times k places
    however many lie within ``km``."""
    c = F.col
    p, levels = _reached(points, places, k, size, km)
    up = F.degrees(c("_km") / geo.RADIUS_KM)
    farthest = F.least(F.abs(c("y")) + up, F.lit(90.0))
    across = F.when(farthest < 89.9, F.least(up / F.cos(F.radians(farthest)), F.lit(180.0))).otherwise(180.0)
    p = _once(_once(p, "_up", up), "_across", across)
    p = _around_the_world(p, c("x") - c("_across"), c("x") + c("_across")).withColumn("x", c("x") + c("_turn")).drop("_turn")
    at = lambda v: F.floor(v / _size(size)).cast("long")
    p = p.withColumn("_cx", F.explode(F.sequence(at(c("x") - c("_across")), at(c("x") + c("_across")))))
    p = p.withColumn("_cy", F.explode(F.sequence(at(c("y") - c("_up")), at(c("y") + c("_up")))))
    q = _leveled(places.select("place_id", "px", "py"), "px", "py", size, levels)
    cell = ("_level", "_cx", "_cy")
    p, q = _dealt(p, q, "point_id", cell)
    near = p.join(q, [*cell, "_s"])
    near = near.where(c("px").between(c("x") - c("_across"), c("x") + c("_across")) & _own_half(c("px"), c("x")) & c("py").between(c("y") - c("_up"), c("y") + c("_up")))
    near = _once(near, "km", geo.haversine_km(c("x"), c("y"), c("px"), c("py"))).where(c("km") <= c("_km")).select("point_id", "place_id", "km")
    rank = W.partitionBy("point_id").orderBy("km", "place_id")
    return near.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k).select("point_id", "place_id", "km", "r")


def nearest_k_widening(points: DataFrame, places: DataFrame, k: int, first_km: float, km: float = 20_038.0) -> DataFrame:
    """nearest_k() with an early stop: the reach starts at ``first_km`` and doubles, up to ``km``, for those points only that
    have fewer than k places within it yet. A point with k of them is done: nothing nearer lies beyond (J24, J26)."""
    found, reach, left = None, first_km, points.select("point_id", "x", "y")
    while True:
        reach = min(reach, km)
        size = max(reach / 111.0, 1e-6)  # about one cell in reach on each side
        near = materialise(nearest_k(left, places, k, size, reach), "near")
        full = near.groupBy("point_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= k) if reach < km else None
        done = near if full is None else near.join(full.select("point_id"), "point_id", "left_semi")
        found = done if found is None else found.union(done)
        if full is None:
            return found
        left = materialise(left.join(full.select("point_id"), "point_id", "left_anti"), "near-left")
        if left.isEmpty():
            return found
        reach *= 2


def boxes_meet(a: DataFrame, b: DataFrame, size: float, world: float = 360.0) -> DataFrame:
    """(a_id, b_id) of boxes that share a point; boxes: id, x1, y1, x2, y2 (J26). A box with x1 beyond x2 runs across 180
    degrees, as one that reaches beyond 180 does; ``world`` is a full turn in the unit of x.

    A pair is reported once: from the cell of the lower corner of the common box, at the first turn at which they meet.
    """
    c = F.col

    def placed(df: DataFrame, p: str) -> DataFrame:
        west = F.pmod(c("x1") + world / 2, F.lit(world)) - world / 2
        wide = F.when(c("x2") >= c("x1"), c("x2") - c("x1")).otherwise(c("x2") - c("x1") + world)
        return df.select(c("id").alias(f"{p}_id"), west.alias(f"{p}_x1"), c("y1").alias(f"{p}_y1"), (west + F.least(wide, F.lit(world))).alias(f"{p}_x2"), c("y2").alias(f"{p}_y2"))

    pa, pb = placed(a, "a"), placed(b, "b")
    # a starts on the map and may reach one turn beyond it, so b meets it as it is or one turn to the east or west
    turns = F.array(*[F.lit(t * world) for t in (-1, 0, 1)])
    pb = pb.withColumn("_turn", F.explode(turns)).withColumns({x: c(x) + c("_turn") for x in ("b_x1", "b_x2")}).where((c("b_x2") >= -world / 2) & (c("b_x1") <= world * 1.5))
    ca = _cells(pa, c("a_x1"), c("a_y1"), c("a_x2"), c("a_y2"), size)
    cb = _cells(pb, c("b_x1"), c("b_y1"), c("b_x2"), c("b_y2"), size)
    at = lambda turn: (c("a_x1") <= c("b_x2") + turn) & (c("b_x1") + turn <= c("a_x2"))
    earlier = (at(-world) & (c("_turn") > -world)) | (at(-2 * world) & (c("_turn") > 0))
    meet = at(0.0) & (c("a_y1") <= c("b_y2")) & (c("b_y1") <= c("a_y2")) & ~earlier
    (cx, cy) = geo.cell(F.greatest("a_x1", "b_x1"), F.greatest("a_y1", "b_y1"), size)
    return ca.join(cb, ["_cx", "_cy"]).where(meet & (cx == c("_cx")) & (cy == c("_cy"))).select("a_id", "b_id")


def selected(features: DataFrame, match: str | None = None, where_in: dict[str, list] | None = None, key: str = "id", limit: int | None = None) -> DataFrame:
    """Features whose key meets a pattern (* any characters, ? any one) and whose fields have one of the given values (A26); a
    ``limit`` takes the first by key (L10)."""
    found = features
    if match is not None:
        for sign in "\\%_":
            match = match.replace(sign, "\\" + sign)
        found = found.where(F.col(key).cast("string").like(match.replace("*", "%").replace("?", "_")))
    for field, values in (where_in or {}).items():
        found = found.where(F.col(field).isin(*values))
    return found if limit is None else found.orderBy(key).limit(limit)


# exact predicates: shapes are id, kind ('point', 'line', 'polygon' or 'circle'), line (array<struct<x,y>>: one point of a
# point or circle, the ring of a polygon) and km (the radius of a circle, else null)


def _pieces(shapes: DataFrame, p: str, size: float) -> DataFrame:
    """The shape's segments, at every turn and cell that they or their radius touch."""
    c = F.col
    line = F.when(c("kind") == "polygon", F.concat("line", F.slice("line", 1, 1))).otherwise(c("line"))
    s = shapes.where(F.size("line") > 0).select("id", cells.unrolled(line).alias("_l"), F.coalesce(c("km").cast("double"), F.lit(0.0)).alias("km"))
    one = F.array(F.struct(c("_l")[0].alias("a"), c("_l")[0].alias("b")))
    s = s.select("id", "km", F.explode(F.when(F.size("_l") > 1, geo.steps(c("_l"))).otherwise(one)).alias("s"))
    s = s.select("id", "km", *[c(f"s.{e}.{k}").alias(f"{k}{n}") for n, e in ((1, "a"), (2, "b")) for k in "xy"])
    within = c("km") > 0  # the reach of the whole radius, by latitude
    up_km = F.when(within, c("km") / geo.RADIUS_KM * 180 / math.pi).otherwise(0.0)
    far = F.least(F.greatest(F.abs("y1"), F.abs("y2")) + up_km, F.lit(90.0))
    across_km = F.when(~within, 0.0).when(far < 89.9, F.least(up_km / F.cos(F.radians(far)), F.lit(180.0))).otherwise(180.0)
    s = _once(_once(s, "_up", up_km), "_across", across_km)
    s = _around_the_world(s, F.least("x1", "x2") - c("_across"), F.greatest("x1", "x2") + c("_across"))
    s = s.withColumns({x: c(x) + c("_turn") for x in ("x1", "x2")})
    s = _cells(s, F.least("x1", "x2") - c("_across"), F.least("y1", "y2") - c("_up"), F.greatest("x1", "x2") + c("_across"), F.greatest("y1", "y2") + c("_up"), size)
    return s.select("_cx", "_cy", *[c(k).alias(f"{p}_{k.lstrip('_')}") for k in ("id", "km", "_up", "_across", "x1", "y1", "x2", "y2")])


def _segments_cross(p: str, q: str) -> Column:
    """Whether two segments of the plane share a point, their ends included."""
    c = lambda s, k: F.col(f"{s}_{k}")

    def side(s: str, x: Column, y: Column) -> Column:
        return F.signum((c(s, "x2") - c(s, "x1")) * (y - c(s, "y1")) - (c(s, "y2") - c(s, "y1")) * (x - c(s, "x1")))

    span = lambda k: (F.least(c(p, f"{k}1"), c(p, f"{k}2")) <= F.greatest(c(q, f"{k}1"), c(q, f"{k}2"))) & (F.least(c(q, f"{k}1"), c(q, f"{k}2")) <= F.greatest(c(p, f"{k}1"), c(p, f"{k}2")))
    return span("x") & span("y") & (side(p, c(q, "x1"), c(q, "y1")) * side(p, c(q, "x2"), c(q, "y2")) <= 0) & (side(q, c(p, "x1"), c(p, "y1")) * side(q, c(p, "x2"), c(p, "y2")) <= 0)


def _km_between(point: str, seg: str) -> Column:
    """Distance of a point to the nearest position of a segment."""
    c = F.col
    pos = geo.project(c(f"{seg}_x1"), c(f"{seg}_y1"), c(f"{seg}_x2"), c(f"{seg}_y2"), c(f"{point}_x1"), c(f"{point}_y1"))
    x, y = geo.lerp(c(f"{seg}_x1"), c(f"{seg}_x2"), pos), geo.lerp(c(f"{seg}_y1"), c(f"{seg}_y2"), pos)
    return geo.haversine_km(x, y, c(f"{point}_x1"), c(f"{point}_y1"))


def points_inside(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """(point_id, id): points (point_id, x, y) and the polygons (id, line) that hold them, by the even-odd rule.

    A point meets the edges of the polygons in its band of latitude that lie to the east of it or near it; the parity of
    those that a ray to the east crosses tells. Edges are dealt by band and by the polygon's columns of cells. A point is in
    one cell, so its edges are counted in the task that joined them, without a shuffle of the pairs."""
    c = F.col
    rings = polygons.where(F.size("line") > 2).select("id", cells.unrolled(F.concat("line", F.slice("line", 1, 1))).alias("_l"))
    wide = rings.select("id", "_l", F.array_min(F.transform("_l", lambda p: p["x"])).alias("w"), F.array_max(F.transform("_l", lambda p: p["x"])).alias("e"))
    wide = _around_the_world(wide, c("w"), c("e"))
    e = wide.select("id", "_turn", c("w").alias("_w"), F.explode(geo.steps(c("_l"))).alias("s")).where("s.a.y != s.b.y")
    e = e.select("id", "_turn", (c("_w") + c("_turn")).alias("_w"), *[(c(f"s.{k}.x") + c("_turn")).alias(f"x{n}") for n, k in ((1, "a"), (2, "b"))], c("s.a.y").alias("y1"), c("s.b.y").alias("y2"))
    # an edge counts for points to its west, from the polygon's western end on
    e = _cells(e, c("_w"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2"), size)
    cx, cy = geo.cell(c("x"), c("y"), size)
    p, e = _dealt(points.select("point_id", "x", "y", cx.alias("_cx"), cy.alias("_cy")), e, "point_id")
    met = p.join(e, ["_cx", "_cy", "_s"]).where((F.least("y1", "y2") <= c("y")) & (c("y") < F.greatest("y1", "y2")))
    met = _once(met, "_x", c("x1") + (c("y") - c("y1")) * (c("x2") - c("x1")) / (c("y2") - c("y1"))).where(c("x") < c("_x"))
    by = ["_cx", "_cy", "_s", "point_id", "id"]
    odd = met.groupBy(*by, "_turn").agg(F.count("*").alias("n")).where("n % 2 = 1")
    return odd.select(*by).distinct().select("point_id", "id")  # of several turns one row


def shapes_meet(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a_id, b_id) of shapes that share a point: edges that touch, a centre within its radius of the other shape, or one
    inside the other (J26). Across 180 degrees and at any latitude; edges are straight in degrees. Small shapes come as tiles,
    pairs with another one as rows."""
    (small_a, more_a), (small_b, more_b) = tiles.split(a, size), tiles.split(b, size)
    found = tiles.pairs(small_a, small_b, size, tiles.meet)
    if not more_a.isEmpty():
        found = found.union(_shapes_meet_rows(more_a, b, size))
    return found if more_b.isEmpty() else found.union(_shapes_meet_rows(small_a.select(*a.columns), more_b, size))


def _shapes_meet_rows(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """shapes_meet() with edges as rows."""
    c = F.col
    # pieces of a are dealt over as many tasks as the session asks for, a crowded cell over several; most pairs of one cell
    # aren't near each other, which their boxes tell before anything is computed
    pa, pb = _dealt(_pieces(a, "a", size), _pieces(b, "b", size), "a_id")
    gap = lambda k, reach: (F.least(f"a_{k}1", f"a_{k}2") - reach <= F.greatest(f"b_{k}1", f"b_{k}2")) & (F.least(f"b_{k}1", f"b_{k}2") <= F.greatest(f"a_{k}1", f"a_{k}2") + reach)
    met = pa.join(pb, ["_cx", "_cy", "_s"]).where(gap("x", c("a_across") + c("b_across") + 1e-9) & gap("y", c("a_up") + c("b_up") + 1e-9))
    reach = c("a_km") + c("b_km")
    near = F.when(c("a_km") > 0, _km_between("a", "b")).otherwise(_km_between("b", "a")) <= reach
    touch = met.where(F.when(reach > 0, near).otherwise(_segments_cross("a", "b"))).select("a_id", "b_id")
    first = lambda df: df.where(F.size("line") > 0).select(F.col("id").alias("point_id"), F.col("line")[0]["x"].alias("x"), F.col("line")[0]["y"].alias("y"))
    inside = points_inside(first(a), b.where("kind = 'polygon'"), size).toDF("a_id", "b_id")
    around = points_inside(first(b), a.where("kind = 'polygon'"), size).toDF("b_id", "a_id").select("a_id", "b_id")
    return touch.union(inside).union(around).distinct()


def extents(nodes: DataFrame, key: str) -> DataFrame:
    """Bounding box of the points of each key."""
    return nodes.groupBy(key).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))


#: Widths of ranges of numbers are powers of 4 up to 4^20.
_WIDTHS = 20


def nearest_numbers(asked: DataFrame, given: DataFrame, k: int) -> DataFrame:
    """(asked_id, given_id): of each asked row the k given rows of its group with the nearest whole number, ties by id.

    asked: asked_id, grp, v; given: given_id, grp, v. A row looks in the narrowest range that holds it and k given rows, and in
    the ranges on both sides; of equal numbers the k smallest ids are enough."""
    c = F.col
    same = W.partitionBy("grp", "v").orderBy("given_id")
    few = materialise(given.where("grp is not null").withColumn("_i", F.row_number().over(same)).where(c("_i") <= k).select("given_id", "grp", "v"), "numbers")
    cell = lambda v: F.floor(v / F.pow(F.lit(4.0), c("_level"))).cast("long").alias("_c")
    levels = F.explode(F.sequence(F.lit(0), F.lit(_WIDTHS))).alias("_level")
    # a row a level: many more than the bytes they are made of make Spark expect, so neither these nor what they meet are broadcast
    ranged = few.select("given_id", "grp", "v", levels).select("*", cell(c("v"))).hint("merge")
    full = ranged.groupBy("grp", "_level", "_c").agg(F.count("*").alias("_n")).where(c("_n") >= k)
    held = asked.select("asked_id", "grp", "v", levels).select("*", cell(c("v"))).join(full.hint("merge"), ["grp", "_level", "_c"]).groupBy("asked_id").agg(F.min("_level").alias("_level"))
    looking = asked.join(held.hint("merge"), "asked_id", "left").withColumn("_level", F.coalesce("_level", F.lit(_WIDTHS)))
    looking = looking.select("asked_id", "grp", c("v").alias("_v"), "_level", cell(c("v"))).withColumn("_c", F.explode(F.sequence(c("_c") - 1, c("_c") + 1)))
    near = looking.join(ranged, ["grp", "_level", "_c"]).select("asked_id", "given_id", F.abs(c("_v") - c("v")).alias("d"))
    rank = W.partitionBy("asked_id").orderBy("d", "given_id")
    return near.withColumn("r", F.row_number().over(rank)).where(c("r") <= k).select("asked_id", "given_id")


def place_pairs(point_places: DataFrame) -> DataFrame:
    """(a, b), a before b: places that are near the same point."""
    a, b = (point_places.select("point_id", F.col("place_id").alias(end)) for end in "ab")
    return a.join(b, "point_id").where("a < b").select("a", "b").distinct()


def nearest_ways(point_places: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """The n ways with the smallest mean distance over edges whose two ends are both near a point.

    point_places: point_id, place_id, km; edges: way_id, a, b.
    """
    a = point_places.select("point_id", F.col("place_id").alias("a"), F.col("km").alias("km_a"))
    b = point_places.select("point_id", F.col("place_id").alias("b"), F.col("km").alias("km_b"))
    # a point has few places, a place may have many edges and points: pairs of a point's places come first
    ends = edges.select("way_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    both = a.join(b, "point_id").where("a <= b").join(ends, ["a", "b"])
    mean = both.groupBy("point_id", "way_id").agg(F.avg((F.col("km_a") + F.col("km_b")) / 2).alias("km"))
    rank = W.partitionBy("point_id").orderBy("km", "way_id")
    return mean.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= n)
