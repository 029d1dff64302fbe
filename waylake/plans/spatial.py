"""Geometry, spatial joins and congestion cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waylake.functions import geo
from waylake.functions.storage import materialise
from waylake.operators import congestion, spatial
from waylake.plans.tables import LAT, LON, lat, lat_e6, lon, lon_e6, table

QUERIES = {}
ORACLES = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _hav(x1: str, y1: str, x2: str, y2: str) -> str:
    return (
        f"2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))"
    )


def _head(x1: str, y1: str, x2: str, y2: str) -> str:
    dx = f"radians({x2} - {x1})"
    return f"degrees(atan2(sin({dx}) * cos(radians({y2})), cos(radians({y1})) * sin(radians({y2})) - sin(radians({y1})) * cos(radians({y2})) * cos({dx})))"


def pairs(spark, d: str) -> DataFrame:
    """Each order joins its customer's point (x1, y1) to its own (x2, y2)."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), lon("o_custkey").alias("x1"), lat("o_custkey").alias("y1"), lon("o_orderkey").alias("x2"), lat("o_orderkey").alias("y2")
    )


PAIRS = f"""pairs AS (SELECT o_orderkey AS id, {LON.format('o_custkey')} AS x1, {LAT.format('o_custkey')} AS y1,
 {LON.format('o_orderkey')} AS x2, {LAT.format('o_orderkey')} AS y2 FROM orders)"""


def _ends() -> list:
    return [F.col(c) for c in ("x1", "y1", "x2", "y2")]


def e4(column: Column) -> Column:
    """A value in whole ten-thousandths, which both engines give alike."""
    return F.round(column * 10000).cast("long")


def whole(column: Column) -> Column:
    """The nearest whole number of one that isn't negative, halves up, as F.round() gives it by way of decimal text."""
    below = F.floor(column)
    return F.when(column - below >= 0.5, below + 1).otherwise(below)


@query(f"WITH {PAIRS} SELECT id, CAST(round({_hav('x1', 'y1', 'x2', 'y2')} * 10000) AS BIGINT) AS km_e4 FROM pairs")
def haversine_km(spark, d: str) -> DataFrame:
    return pairs(spark, d).select("id", e4(geo.haversine_km(*_ends())).alias("km_e4"))


def order_lines(spark, d: str) -> DataFrame:
    """Each order's line runs through the points of its line items, by line number."""
    point = F.struct("l_linenumber", "l_partkey", lon("l_partkey").alias("x"), lat("l_partkey").alias("y"))
    # few bytes, much to compute: as many tasks as the session asks for, not merged by size
    dealt = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    g = dealt.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(point)).alias("ps"))
    return g.select("id", F.transform("ps", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))


ORDER_STEPS = f"""pts AS (SELECT l_orderkey AS id, {LON.format('l_partkey')} AS x, {LAT.format('l_partkey')} AS y,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem),
steps AS (SELECT id, i, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pts WINDOW w AS (PARTITION BY id ORDER BY i))"""


@query(f"WITH {ORDER_STEPS} SELECT id, CAST(round(coalesce(sum({_hav('x', 'y', 'x2', 'y2')}) FILTER (x2 IS NOT NULL), 0) * 100) AS BIGINT) AS km_e2, count(*) AS points FROM steps GROUP BY id")
def linestring_length(spark, d: str) -> DataFrame:
    return order_lines(spark, d).select("id", F.round(geo.length_km(F.col("line")) * 100).cast("long").alias("km_e2"), F.size("line").cast("long").alias("points"))


@query(f"WITH {ORDER_STEPS} SELECT count(DISTINCT id) AS lines, CAST(round(sum({_hav('x', 'y', 'x2', 'y2')}) FILTER (x2 IS NOT NULL)) AS BIGINT) AS km FROM steps")
def total_length(spark, d: str) -> DataFrame:
    """Length of all lines together."""
    return order_lines(spark, d).agg(F.count("*").alias("lines"), F.round(F.sum(geo.length_km(F.col("line")))).cast("long").alias("km"))


_HEADING = _head("x1", "y1", "x2", "y2")


@query(f"""WITH {PAIRS}, h AS (SELECT id, {_HEADING} AS a FROM pairs WHERE x1 != x2 OR y1 != y2)
SELECT id, CAST(round(a * 10000) AS BIGINT) AS heading_e4, CASE WHEN a < -135 OR a > 135 THEN 'SOUTHBOUND' WHEN a < -45 THEN 'WESTBOUND' WHEN a > 45 THEN 'EASTBOUND' ELSE 'NORTHBOUND' END AS sector FROM h""")
def heading_compass(spark, d: str) -> DataFrame:
    h = pairs(spark, d).where("x1 != x2 or y1 != y2").select("id", geo.heading(*_ends()).alias("a"))
    return h.select("id", e4(F.col("a")).alias("heading_e4"), geo.compass(F.col("a")).alias("sector"))


@query("""SELECT o_orderkey AS id FROM orders WHERE least(mod(o_orderkey * 7 % 360 - o_custkey * 13 % 360 + 720, 360), 360 - mod(o_orderkey * 7 % 360 - o_custkey * 13 % 360 + 720, 360)) <= 30
 OR (o_orderkey % 2 = 0 AND least(mod(o_orderkey * 7 % 360 + 180 - o_custkey * 13 % 360 + 720, 360), 360 - mod(o_orderkey * 7 % 360 + 180 - o_custkey * 13 % 360 + 720, 360)) <= 30)""")
def angle_window(spark, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    hit = geo.within_angle((k * 7 % 360).cast("double"), (c * 13 % 360).cast("double"), F.lit(30.0), k % 2 == 0)
    return table(spark, d, "orders").where(hit).select(k.alias("id"))


_T = "greatest(0.0, least(1.0, CASE WHEN {dx} * {dx} + {dy} * {dy} > 0 THEN (({x} - {x1}) * {dx} + ({y} - {y1}) * {dy}) / ({dx} * {dx} + {dy} * {dy}) ELSE 0.0 END))"


def _project(x1: str, y1: str, x2: str, y2: str, x: str, y: str) -> str:
    return _T.format(x1=x1, y1=y1, x=x, y=y, dx=f"({x2} - {x1})", dy=f"({y2} - {y1})")


_PX, _PY = LON.format("id * 31"), LAT.format("id * 31")


@query(f"WITH {PAIRS} SELECT id, CAST(round({_project('x1', 'y1', 'x2', 'y2', _PX, _PY)} * 10000) AS BIGINT) AS pos_e4 FROM pairs")
def project_clamp(spark, d: str) -> DataFrame:
    p = pairs(spark, d)
    return p.select("id", e4(geo.project(*_ends(), lon(F.col("id") * 31), lat(F.col("id") * 31))).alias("pos_e4"))


@query(f"WITH {PAIRS} SELECT id, CAST(round((x1 + (x2 - x1) * (id % 11 / 10.0)) * 10000) AS BIGINT) AS x_e4, CAST(round((y1 + (y2 - y1) * (id % 11 / 10.0)) * 10000) AS BIGINT) AS y_e4 FROM pairs")
def lerp_point(spark, d: str) -> DataFrame:
    t = F.col("id") % 11 / 10.0
    return pairs(spark, d).select("id", e4(geo.lerp(F.col("x1"), F.col("x2"), t)).alias("x_e4"), e4(geo.lerp(F.col("y1"), F.col("y2"), t)).alias("y_e4"))


_B, _D = "radians(id * 17 % 360)", "((id % 50 + 1) / 6378.137)"
_LAT2 = f"asin(sin(radians(y1)) * cos({_D}) + cos(radians(y1)) * sin({_D}) * cos({_B}))"


@query(f"""WITH {PAIRS} SELECT id, CAST(round(degrees(radians(x1) + atan2(sin({_B}) * sin({_D}) * cos(radians(y1)), cos({_D}) - sin(radians(y1)) * sin({_LAT2}))) * 10000) AS BIGINT) AS x_e4,
 CAST(round(degrees({_LAT2}) * 10000) AS BIGINT) AS y_e4 FROM pairs""")
def inverse_haversine(spark, d: str) -> DataFrame:
    k = F.col("id")
    x, y = geo.destination(F.col("x1"), F.col("y1"), F.radians((k * 17 % 360).cast("double")), (k % 50 + 1).cast("double"))
    return pairs(spark, d).select("id", e4(x).alias("x_e4"), e4(y).alias("y_e4"))


@query("""WITH p AS (SELECT l_orderkey AS id, printf('%.6f %.6f', (140200000 + l_partkey * 7919 % 10400000) / 1e6, (-39700000 + l_partkey * 6271 % 6200000) / 1e6) AS t,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem)
SELECT id, concat('LINESTRING (', string_agg(t, ', ' ORDER BY i), ')') AS wkt FROM p GROUP BY id""")
def wkt_linestring(spark, d: str) -> DataFrame:
    return order_lines(spark, d).select("id", geo.wkt_line(F.col("line")).alias("wkt"))


@query(f"""WITH {PAIRS} SELECT id, CAST(round(least(mod(a, 180), 180 - mod(a, 180))) AS BIGINT) AS folded FROM (SELECT id, mod(id * 7 % 360 - id * 3 % 360 + 720, 360) AS a FROM pairs)""")
def fold_angle(spark, d: str) -> DataFrame:
    k = F.col("id")
    return pairs(spark, d).select("id", F.round(geo.fold_angle((k * 7 % 360 - k * 3 % 360).cast("double"))).cast("long").alias("folded"))


# spatial joins


def customer_points(spark, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), lon("c_custkey").alias("x"), lat("c_custkey").alias("y"))


def supplier_segments(spark, d: str) -> DataFrame:
    """Each supplier's way is one segment of about a tenth of a degree."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("way_id"), F.lit(0).alias("seg"), lon(k * 11).alias("x1"), lat(k * 11).alias("y1"), (lon(k * 11) + 0.1).alias("x2"), (lat(k * 11) + k % 10 / 100).alias("y2")
    )


_POINTS = f"pts AS (SELECT c_custkey AS point_id, {LON.format('c_custkey')} AS x, {LAT.format('c_custkey')} AS y FROM customer)"
_SEGS = f"""segs AS (SELECT s_suppkey AS way_id, {LON.format('s_suppkey * 11')} AS x1, {LAT.format('s_suppkey * 11')} AS y1,
 {LON.format('s_suppkey * 11')} + 0.1 AS x2, {LAT.format('s_suppkey * 11')} + s_suppkey % 10 / 100 AS y2 FROM supplier)"""
_BRUTE = f"""near AS (SELECT point_id, way_id, pos, {_hav('(x1 + (x2 - x1) * pos)', '(y1 + (y2 - y1) * pos)', 'x', 'y')} AS km
 FROM (SELECT *, {_project('x1', 'y1', 'x2', 'y2', 'x', 'y')} AS pos FROM pts, segs))"""
NEAR_KM = 40.0


@query(f"WITH {_POINTS}, {_SEGS}, {_BRUTE} SELECT point_id, way_id, CAST(round(km * 10000) AS BIGINT) AS km_e4 FROM near WHERE km <= {NEAR_KM}")
def grid_spatial_join(spark, d: str) -> DataFrame:
    hits = spatial.within_km(customer_points(spark, d), supplier_segments(spark, d), NEAR_KM, 0.5)
    return hits.select("point_id", "way_id", whole(F.col("km") * 10000).alias("km_e4"))


@query(f"""WITH {_POINTS}, {_SEGS}, {_BRUTE} SELECT point_id, way_id, CAST(round(pos * 10000) AS BIGINT) AS pos_e4 FROM (
 SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km, way_id) AS r FROM near WHERE km <= {NEAR_KM}) WHERE r = 1""")
def nearest_on_segment(spark, d: str) -> DataFrame:
    hits = spatial.nearest_way(spatial.within_km(customer_points(spark, d), supplier_segments(spark, d), NEAR_KM, 0.5, nearest=True))
    return hits.select("point_id", "way_id", e4(F.col("pos")).alias("pos_e4"))


@query(f"""WITH {_POINTS}, {_SEGS}, {_BRUTE} SELECT point_id, way_id % 7 AS way_id, CAST(round(min(km) * 10000) AS BIGINT) AS km_e4 FROM near WHERE km <= {NEAR_KM} GROUP BY 1, 2""")
def nearest_on_ways(spark, d: str) -> DataFrame:
    segments = supplier_segments(spark, d).select((F.col("way_id") % 7).alias("way_id"), F.col("way_id").alias("seg"), "x1", "y1", "x2", "y2")
    hits = spatial.nearest_on_way(spatial.within_km(customer_points(spark, d), segments, NEAR_KM, 0.5))
    return hits.select("point_id", "way_id", whole(F.col("km") * 10000).alias("km_e4"))


_PLACES = f"places AS (SELECT s_suppkey AS place_id, {LON.format('s_suppkey * 11')} AS px, {LAT.format('s_suppkey * 11')} AS py FROM supplier)"


def supplier_places(spark, d: str) -> DataFrame:
    k = F.col("s_suppkey") * 11
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("place_id"), lon(k).alias("px"), lat(k).alias("py"))


_RANKED = f"""ranked AS (SELECT point_id, place_id, km, row_number() OVER (PARTITION BY point_id ORDER BY km, place_id) AS r FROM (
 SELECT point_id, place_id, {_hav('x', 'y', 'px', 'py')} AS km FROM pts, places) WHERE km <= 100)"""


@query(f"WITH {_POINTS}, {_PLACES}, {_RANKED} SELECT point_id, place_id, CAST(r AS INTEGER) AS r FROM ranked WHERE r <= 5")
def radius_topk(spark, d: str) -> DataFrame:
    return spatial.nearest_k(customer_points(spark, d), supplier_places(spark, d), 5, 1.0, 100.0).select("point_id", "place_id", "r")


# the same places 110 degrees farther north and 36 farther east, where they lie on both sides of 180 degrees; the SQL
# counts longitudes on beyond 180, so that it needs no turn

_NORTH_POINTS = "npts AS (SELECT point_id, x + 36 AS x, y + 110 AS y FROM pts)"
_NORTH_BRUTE = f"""nnear AS (SELECT point_id, way_id, {_hav('(x1 + (x2 - x1) * pos)', '(y1 + (y2 - y1) * pos)', 'x', 'y')} AS km
 FROM (SELECT *, {_project('x1', 'y1', 'x2', 'y2', 'x', 'y')} AS pos FROM npts, nsegs))"""


def _turned(x: str) -> Column:
    return F.pmod(F.col(x) + 216, F.lit(360.0)) - 180


def north_points(spark, d: str) -> DataFrame:
    return customer_points(spark, d).withColumns({"x": _turned("x"), "y": F.col("y") + 110})


@query(f"""WITH {_POINTS}, {_SEGS}, {_NORTH_POINTS}, nsegs AS (SELECT way_id, x1 + 36 AS x1, y1 + 110 AS y1, x2 + 36 AS x2, y2 + 110 AS y2 FROM segs), {_NORTH_BRUTE}
SELECT point_id, way_id, CAST(round(km * 100) AS BIGINT) AS km_e2 FROM nnear WHERE km <= {NEAR_KM}""")
def grid_spatial_join_north(spark, d: str) -> DataFrame:
    s = supplier_segments(spark, d).withColumns({"x1": _turned("x1"), "y1": F.col("y1") + 110, "y2": F.col("y2") + 110})
    hits = spatial.within_km(north_points(spark, d), s.withColumn("x2", F.col("x1") + 0.1), NEAR_KM, 0.5)
    return hits.select("point_id", "way_id", whole(F.col("km") * 100).alias("km_e2"))


@query(f"""WITH {_POINTS}, {_PLACES}, {_NORTH_POINTS}, nranked AS (SELECT point_id, place_id, row_number() OVER (PARTITION BY point_id ORDER BY km, place_id) AS r FROM (
 SELECT point_id, place_id, {_hav('x', 'y', '(px + 36)', '(py + 110)')} AS km FROM npts, places) WHERE km <= 100)
SELECT point_id, place_id, CAST(r AS INTEGER) AS r FROM nranked WHERE r <= 5""")
def radius_topk_north(spark, d: str) -> DataFrame:
    places = supplier_places(spark, d).withColumns({"px": _turned("px"), "py": F.col("py") + 110})
    return spatial.nearest_k(north_points(spark, d), places, 5, 1.0, 100.0).select("point_id", "place_id", "r")


@query(f"""WITH {_POINTS}, {_PLACES}, {_RANKED}, top AS (SELECT * FROM ranked WHERE r <= 10), edges AS (
 SELECT a.s_nationkey AS way_id, a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey),
m AS (SELECT p.point_id, e.way_id, avg((p.km + q.km) / 2) AS km FROM edges e JOIN top p ON p.place_id = e.a JOIN top q ON q.place_id = e.b AND q.point_id = p.point_id GROUP BY 1, 2)
SELECT point_id, way_id FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km, way_id) AS r FROM m) WHERE r <= 2""")
def knn_ways(spark, d: str) -> DataFrame:
    near = materialise(spatial.nearest_k(customer_points(spark, d), supplier_places(spark, d), 10, 1.0, 100.0), "near")
    s = table(spark, d, "supplier")
    a, b = s.select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("way_id")), s.select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("way_id"))
    # of all pairs of suppliers of a nation, those that a point may have
    edges = spatial.place_pairs(near).join(a, "a").join(b, ["b", "way_id"])
    return spatial.nearest_ways(near, edges, 2).select("point_id", "way_id")


@query("""WITH a AS (SELECT o_orderkey AS id, 140200000 + o_orderkey * 7919 % 10400000 AS x1, -39700000 + o_orderkey * 6271 % 6200000 AS y1 FROM orders),
b AS (SELECT s_suppkey AS id, 140200000 + s_suppkey * 11 * 7919 % 10400000 AS x1, -39700000 + s_suppkey * 11 * 6271 % 6200000 AS y1 FROM supplier)
SELECT a.id AS a_id, b.id AS b_id FROM a, b WHERE a.x1 <= b.x1 + 200000 AND b.x1 <= a.x1 + 100000 AND a.y1 <= b.y1 + 200000 AND b.y1 <= a.y1 + 100000""")
def bbox_intersects(spark, d: str) -> DataFrame:
    # whole micro-degrees: touching boxes meet in both engines
    box = lambda t, key, by, size: table(spark, d, t).select(
        F.col(key).alias("id"), lon_e6(F.col(key) * by).alias("x1"), lat_e6(F.col(key) * by).alias("y1"),
        (lon_e6(F.col(key) * by) + size).alias("x2"), (lat_e6(F.col(key) * by) + size).alias("y2"),
    )
    return spatial.boxes_meet(box("orders", "o_orderkey", 1, 100000), box("supplier", "s_suppkey", 11, 200000), 500000.0, 360e6)


@query(f"WITH {_POINTS} SELECT floor((x + 180) / 6) + CASE WHEN (x + 180) / 6 = floor((x + 180) / 6) THEN 0 ELSE 1 END AS zone, count(*) AS n, CAST(round(min(x) * 1e6) AS BIGINT) AS x1, CAST(round(max(y) * 1e6) AS BIGINT) AS y2 FROM pts GROUP BY 1")
def extents_by_zone(spark, d: str) -> DataFrame:
    p = customer_points(spark, d).withColumn("zone", geo.utm_zone(F.col("x")).cast("double"))
    n = p.groupBy("zone").agg(F.count("*").alias("n"))
    e6 = lambda c: F.round(F.col(c) * 1e6).cast("long").alias(c)
    return spatial.extents(p, "zone").join(n, "zone").select("zone", "n", e6("x1"), e6("y2"))


# cost of congestion


def _voc(v: str) -> str:
    a, b, c0, c1, c2 = congestion.COEFFICIENTS
    return f"CASE WHEN {v} = 0 THEN 0.0 WHEN {v} < 60 THEN CAST({a!r} AS DOUBLE) + CAST({b!r} AS DOUBLE) / {v} ELSE CAST({c0!r} AS DOUBLE) + CAST({c1!r} AS DOUBLE) * {v} + CAST({c2!r} AS DOUBLE) * {v} * {v} END"


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 2 AS va, 20.0::DOUBLE + l_suppkey % 9 * 10 AS vn, (l_partkey % 60)::DOUBLE AS n, (l_linenumber / 4.0)::DOUBLE AS km FROM lineitem),
c AS (SELECT *, CASE WHEN va = 0 THEN 0.0::DOUBLE ELSE 60 * km / va * n END AS k, ({_voc('va')}) AS ca, ({_voc('vn')}) AS cn FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(CASE WHEN va > vn THEN 0 ELSE greatest(0.0, 1.253::DOUBLE * greatest(0, 1 - va / vn) * 300 * k * CAST({congestion.PER_HOUR!r} AS DOUBLE) / 3600 + (ca - cn) * va * k * 300 / 100 / 3600) END * 100) AS BIGINT) AS cents FROM c""")
def congestion_cost(spark, d: str) -> DataFrame:
    nominal = F.lit(20.0) + F.col("l_suppkey") % 9 * 10
    cost = congestion.congestion_dollars(F.col("l_quantity") * 2, nominal, (F.col("l_partkey") % 60).cast("double"), F.col("l_linenumber") / 4.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(cost * 100).cast("long").alias("cents"))
