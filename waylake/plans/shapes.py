"""Polygons, covers by cells, exact predicates and packed layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waylake.functions import geo
from waylake.functions.storage import fresh_path
from waylake.operators import cells, layout, overlay, relationships, spatial, union
from waylake.plans.spatial import _hav, _project, customer_points, order_lines, supplier_places
from waylake.plans.tables import LAT, LON, lat, lat_e6, lon, lon_e6, table

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# every customer has a triangle, every supplier a pentagon and a five-pointed star that crosses itself


def _ring(key: Column, x: Column, y: Column, radius: Column, n: int, leap: int) -> Column:
    """n points around a place, every leap-th one next, counter-clockwise, a bit flatter than a circle."""
    turn = lambda i: F.lit(2.0 * leap) * F.pi() * i / n + key
    point = lambda i: F.struct((x + radius * F.cos(turn(i))).alias("x"), (y + radius * F.sin(turn(i)) * 0.8).alias("y"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def _rings_sql(name: str, source: str, key: str, by: int, radius: str, n: int) -> str:
    return f"""{name} AS (SELECT {key} AS id, i, {LON.format(f'{key} * {by}')} + {radius} * cos(2.0 * pi() * i / {n} + {key}) AS x,
 {LAT.format(f'{key} * {by}')} + {radius} * sin(2.0 * pi() * i / {n} + {key}) * 0.8 AS y FROM {source}, range({n}) t(i))"""


def triangles(spark, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), _ring(k, lon(k), lat(k), 0.2 + k % 7 * 0.05, 3, 1).alias("ring"))


def pentagons(spark, d: str, leap: int = 1) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), _ring(k, lon(k * 11), lat(k * 11), 0.25 + k % 5 * 0.05, 5, leap).alias("ring"))


_TRIANGLES = _rings_sql("tri", "customer", "c_custkey", 1, "(0.2 + c_custkey % 7 * 0.05)", 3)
_PENTAGONS = _rings_sql("pent", "supplier", "s_suppkey", 11, "(0.25 + s_suppkey % 5 * 0.05)", 5)


def _edges_sql(name: str, rings: str, n: int) -> str:
    return f"{name} AS (SELECT p.id, p.i, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM {rings} p JOIN {rings} q ON p.id = q.id AND q.i = (p.i + 1) % {n})"


_TRI_EDGES, _PENT_EDGES = _edges_sql("tri_e", "tri", 3), _edges_sql("pent_e", "pent", 5)
_BOXES = """tri_b AS (SELECT id, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM tri GROUP BY id),
pent_b AS (SELECT id, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM pent GROUP BY id),
near AS (SELECT t.id AS a_id, p.id AS b_id FROM tri_b t, pent_b p WHERE t.x1 <= p.x2 AND p.x1 <= t.x2 AND t.y1 <= p.y2 AND p.y1 <= t.y2)"""


def box_of(df: DataFrame, ring: str = "ring") -> DataFrame:
    bound = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    return df.select("id", *[bound(F.array_min, c).alias(f"{c}1") for c in "xy"], *[bound(F.array_max, c).alias(f"{c}2") for c in "xy"])


# Green's theorem: the boundary of the common part is what of each ring lies inside the other one
def _inside_part(own: str, own_id: str, other: str, other_id: str) -> str:
    return f"""SELECT n.a_id, n.b_id, e.x1 + (e.x2 - e.x1) * t1 AS px, e.y1 + (e.y2 - e.y1) * t1 AS py, e.x1 + (e.x2 - e.x1) * t2 AS qx, e.y1 + (e.y2 - e.y1) * t2 AS qy
 FROM (SELECT a_id, b_id, id, i, t AS t1, lead(t) OVER (PARTITION BY a_id, b_id, i ORDER BY t) AS t2 FROM (
   SELECT a_id, b_id, e.id, e.i, unnest([0.0::double, 1.0::double]) AS t FROM near n JOIN {own} e ON e.id = n.{own_id}
   UNION ALL SELECT a_id, b_id, e.id, e.i, ((f.x1 - e.x1) * (f.y2 - f.y1) - (f.y1 - e.y1) * (f.x2 - f.x1)) / ((e.x2 - e.x1) * (f.y2 - f.y1) - (e.y2 - e.y1) * (f.x2 - f.x1)) AS t
   FROM near n JOIN {own} e ON e.id = n.{own_id} JOIN {other} f ON f.id = n.{other_id}
   WHERE ((f.x1 - e.x1) * (e.y2 - e.y1) - (f.y1 - e.y1) * (e.x2 - e.x1)) / ((e.x2 - e.x1) * (f.y2 - f.y1) - (e.y2 - e.y1) * (f.x2 - f.x1)) BETWEEN 0 AND 1) WHERE t BETWEEN 0 AND 1) n
 JOIN {own} e ON e.id = n.id AND e.i = n.i JOIN {other} f ON f.id = n.{other_id} WHERE t2 IS NOT NULL
 GROUP BY n.a_id, n.b_id, n.i, t1, t2, e.x1, e.x2, e.y1, e.y2
 HAVING count(*) FILTER ((f.y1 > e.y1 + (e.y2 - e.y1) * (t1 + t2) / 2) != (f.y2 > e.y1 + (e.y2 - e.y1) * (t1 + t2) / 2) AND e.x1 + (e.x2 - e.x1) * (t1 + t2) / 2
   < f.x1 + (e.y1 + (e.y2 - e.y1) * (t1 + t2) / 2 - f.y1) * (f.x2 - f.x1) / (f.y2 - f.y1)) % 2 = 1"""


_AREA = "(0.5 * {n} * sin(2 * pi() / {n}) * {r} * {r} * 0.8)"


@query(f"""WITH {_TRIANGLES}, {_PENTAGONS}, {_TRI_EDGES}, {_PENT_EDGES}, {_BOXES}, parts AS ({_inside_part('tri_e', 'a_id', 'pent_e', 'b_id')} UNION ALL {_inside_part('pent_e', 'b_id', 'tri_e', 'a_id')}),
common AS (SELECT a_id, b_id, sum(px * qy - qx * py) / 2 AS s FROM parts GROUP BY 1, 2),
r AS (SELECT a_id, b_id, coalesce(s, 0) AS s, {_AREA.format(n=3, r='(0.2 + a_id % 7 * 0.05)')} AS a, {_AREA.format(n=5, r='(0.25 + b_id % 5 * 0.05)')} AS b FROM near LEFT JOIN common USING (a_id, b_id))
SELECT a_id, b_id, CAST(round(s * 1e6) AS BIGINT) AS both_e6, CAST(round((a + b - s) * 1e6) AS BIGINT) AS either_e6, CAST(round((a - s) * 1e6) AS BIGINT) AS only_a_e6, CAST(round((b - s) * 1e6) AS BIGINT) AS only_b_e6 FROM r""")
def polygon_overlay(spark, d: str) -> DataFrame:
    found = overlay.areas_of_pairs(triangles(spark, d), pentagons(spark, d), 0.5)
    return found.select("a_id", "b_id", *[F.round(F.col(op) * 1e6).cast("long").alias(f"{op}_e6") for op in ("both", "either", "only_a", "only_b")])


# a five-pointed star inside its own ring: five tips, without the pentagon in the middle
_STAR = "(r * r * 0.8 * (5 * q * sin(pi() / 5) - 2.5 * q * q * sin(2 * pi() / 5)))"


@query(f"""SELECT id, 5 AS rings, 15 AS points, CAST(round({_STAR} * 1e6) AS BIGINT) AS area_e6 FROM (SELECT s_suppkey AS id, 0.25 + s_suppkey % 5 * 0.05 AS r, 1 / pow((1 + sqrt(5.0)) / 2, 2) AS q FROM supplier)""")
def polygon_repair(spark, d: str) -> DataFrame:
    found = overlay.repaired(pentagons(spark, d, leap=2).withColumnRenamed("id", "pair"))
    area = F.aggregate("rings", F.lit(0.0), lambda t, r: t + geo.shoelace(r))
    points = F.aggregate("rings", F.lit(0), lambda t, r: t + F.size(r))
    return found.select(F.col("pair").alias("id"), F.size("rings").alias("rings"), points.alias("points"), F.round(area * 1e6).cast("long").alias("area_e6"))


# covers by cells

_LINE_RES, _AREA_RES = 9, 11


def _cell_sql(row: str, column: str, res: int) -> str:
    return f"(({res} + 1) * {1 << 56} + {row} * {1 << 28} + {column})"


_S = 180.0 / (1 << _LINE_RES)


@query(f"""WITH p AS (SELECT l_orderkey AS id, {LON.format('l_partkey')} AS x, {LAT.format('l_partkey')} AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem),
s AS (SELECT id, x AS x1, y AS y1, lead(x, 1, x) OVER w - x AS dx, lead(y, 1, y) OVER w - y AS dy FROM p WINDOW w AS (PARTITION BY id ORDER BY i)),
c AS (SELECT DISTINCT s.id, r, k FROM s, range(cast(floor((-40.0 + 90) / {_S}) AS BIGINT), cast(floor((-33.0 + 90) / {_S}) AS BIGINT) + 1) a(r), range(cast(floor((140.0 + 180) / {_S}) AS BIGINT), cast(floor((151.0 + 180) / {_S}) AS BIGINT) + 1) b(k)
 WHERE r BETWEEN floor((least(y1, y1 + dy) + 90) / {_S}) AND floor((greatest(y1, y1 + dy) + 90) / {_S}) AND k BETWEEN floor((least(x1, x1 + dx) + 180) / {_S}) AND floor((greatest(x1, x1 + dx) + 180) / {_S})
 AND greatest(0, CASE WHEN dx != 0 THEN least((k * {_S} - 180 - x1) / dx, ((k + 1) * {_S} - 180 - x1) / dx) ELSE 0 END, CASE WHEN dy != 0 THEN least((r * {_S} - 90 - y1) / dy, ((r + 1) * {_S} - 90 - y1) / dy) ELSE 0 END)
  <= least(1, CASE WHEN dx != 0 THEN greatest((k * {_S} - 180 - x1) / dx, ((k + 1) * {_S} - 180 - x1) / dx) ELSE 1 END, CASE WHEN dy != 0 THEN greatest((r * {_S} - 90 - y1) / dy, ((r + 1) * {_S} - 90 - y1) / dy) ELSE 1 END))
SELECT id, count(*) AS cells, CAST(sum(r) AS BIGINT) AS rows_sum, CAST(sum(k) AS BIGINT) AS columns_sum FROM c GROUP BY id""")
def line_cover(spark, d: str) -> DataFrame:
    cover = cells.line_cells(order_lines(spark, d), _LINE_RES)
    _, row, column = cells.cell_parts(F.col("cell"))
    return cover.groupBy("id").agg(F.count("*").alias("cells"), F.sum(row).alias("rows_sum"), F.sum(column).alias("columns_sum"))


_A = 180.0 / (1 << _AREA_RES)
_FILL = f"""box AS (SELECT id, cast(floor((min(y) + 90) / {_A}) AS BIGINT) AS r1, cast(floor((max(y) + 90) / {_A}) AS BIGINT) AS r2, cast(floor((min(x) + 180) / {_A}) AS BIGINT) AS k1, cast(floor((max(x) + 180) / {_A}) AS BIGINT) AS k2 FROM pent GROUP BY id),
centres AS (SELECT id, r, k, (k + 0.5) * {_A} - 180 AS x, (r + 0.5) * {_A} - 90 AS y FROM (SELECT id, r, k2, unnest(range(k1, k2 + 1)) AS k FROM (SELECT *, unnest(range(r1, r2 + 1)) AS r FROM box))),
fill AS (SELECT c.id, r, k FROM centres c JOIN pent_e e ON c.id = e.id GROUP BY c.id, r, k, c.x, c.y
 HAVING count(*) FILTER ((e.y1 > c.y) != (e.y2 > c.y) AND c.x < e.x1 + (c.y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)) % 2 = 1)"""


@query(f"WITH {_PENTAGONS}, {_PENT_EDGES}, {_FILL} SELECT id, {_cell_sql('r', 'k', _AREA_RES)} AS cell FROM fill")
def polygon_cover(spark, d: str) -> DataFrame:
    return cells.polygon_cells(pentagons(spark, d), _AREA_RES)


_MERGED = f"""m0 AS (SELECT id, {_AREA_RES} AS res, r, k FROM fill), """ + ", ".join(
    f"""u{i + 1} AS (SELECT id, {_AREA_RES - i - 1} AS res, r // 2 AS r, k // 2 AS k FROM m{i} WHERE res = {_AREA_RES - i} GROUP BY id, r // 2, k // 2 HAVING count(*) = 4),
m{i + 1} AS (SELECT * FROM u{i + 1} UNION ALL SELECT m.* FROM m{i} m LEFT JOIN u{i + 1} u ON m.id = u.id AND m.res = {_AREA_RES - i} AND m.r // 2 = u.r AND m.k // 2 = u.k WHERE u.id IS NULL)"""
    for i in range(4)
)


@query(f"WITH {_PENTAGONS}, {_PENT_EDGES}, {_FILL}, {_MERGED} SELECT id, (res + 1) * {1 << 56} + r * {1 << 28} + k AS cell FROM m4")
def cover_compacted(spark, d: str) -> DataFrame:
    return cells.compacted(cells.polygon_cells(pentagons(spark, d), _AREA_RES), coarsest=_AREA_RES - 4)


@query(f"""WITH {_PENTAGONS}, {_PENT_EDGES}, {_FILL}, corners AS (SELECT id, r + dy AS r, k + dx AS k, count(*) AS n FROM fill, range(2) a(dy), range(2) b(dx) GROUP BY 1, 2, 3)
SELECT id, count(*) AS points, CAST(sum(r) AS BIGINT) AS rows_sum, CAST(sum(k) AS BIGINT) AS columns_sum FROM corners WHERE n < 4 GROUP BY id""")
def cover_hull(spark, d: str) -> DataFrame:
    hull = cells.hull_points(cells.polygon_cells(pentagons(spark, d), _AREA_RES))
    at = lambda c, low: F.sum(F.round((F.col(c) + low) / _A).cast("long"))
    return hull.groupBy("id").agg(F.count("*").alias("points"), at("y", 90).alias("rows_sum"), at("x", 180).alias("columns_sum"))


# exact predicates


def customer_lines(spark, d: str) -> DataFrame:
    """Every customer's line has two steps."""
    k = F.col("c_custkey")
    point = lambda dx, dy: F.struct((lon(k) + dx).alias("x"), (lat(k) + dy).alias("y"))
    line = F.array(point(F.lit(0.0), F.lit(0.0)), point((k % 9 - 4) * 0.1, (k % 7 - 3) * 0.1), point((k % 5 - 2) * 0.2, F.lit(0.3)))
    return table(spark, d, "customer").select(k.alias("id"), F.lit("line").alias("kind"), line.alias("line"), F.lit(None).cast("double").alias("km"))


def _as_polygons(rings: DataFrame) -> DataFrame:
    return rings.select("id", F.lit("polygon").alias("kind"), F.col("ring").alias("line"), F.lit(None).cast("double").alias("km"))


_LINES = f"""pts AS (SELECT c_custkey AS id, {LON.format('c_custkey')} AS x, {LAT.format('c_custkey')} AS y FROM customer),
line_e AS (SELECT id, x AS x1, y AS y1, x + (id % 9 - 4) * 0.1 AS x2, y + (id % 7 - 3) * 0.1 AS y2 FROM pts
 UNION ALL SELECT id, x + (id % 9 - 4) * 0.1, y + (id % 7 - 3) * 0.1, x + (id % 5 - 2) * 0.2, y + 0.3 FROM pts)"""
_CROSS = """(l.x2 - l.x1) * (e.y1 - l.y1) - (l.y2 - l.y1) * (e.x1 - l.x1)) * sign((l.x2 - l.x1) * (e.y2 - l.y1) - (l.y2 - l.y1) * (e.x2 - l.x1)) <= 0
 AND sign((e.x2 - e.x1) * (l.y1 - e.y1) - (e.y2 - e.y1) * (l.x1 - e.x1)) * sign((e.x2 - e.x1) * (l.y2 - e.y1) - (e.y2 - e.y1) * (l.x2 - e.x1)) <= 0
 AND least(l.x1, l.x2) <= greatest(e.x1, e.x2) AND least(e.x1, e.x2) <= greatest(l.x1, l.x2) AND least(l.y1, l.y2) <= greatest(e.y1, e.y2) AND least(e.y1, e.y2) <= greatest(l.y1, l.y2)"""
_HELD = """held AS (SELECT p.id AS point_id, e.id FROM pts p, pent_e e WHERE (e.y1 > p.y) != (e.y2 > p.y) AND p.x < e.x1 + (p.y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""


@query(f"""WITH {_PENTAGONS}, {_PENT_EDGES}, {_LINES}, {_HELD} SELECT DISTINCT l.id AS a_id, e.id AS b_id FROM line_e l, pent_e e WHERE sign({_CROSS} UNION SELECT point_id, id FROM held""")
def lines_meet_polygons(spark, d: str) -> DataFrame:
    return spatial.shapes_meet(customer_lines(spark, d), _as_polygons(pentagons(spark, d)), 0.5)


_NEAREST = _project("x1", "y1", "x2", "y2", "x", "y")


@query(f"""WITH {_PENTAGONS}, {_PENT_EDGES}, {_LINES}, {_HELD}, met AS (SELECT p.id AS a_id, e.id AS b_id, p.x, p.y, x1, y1, x2, y2, {_NEAREST} AS pos FROM pts p, pent_e e)
SELECT a_id, b_id FROM met GROUP BY 1, 2 HAVING min({_hav('(x1 + (x2 - x1) * pos)', '(y1 + (y2 - y1) * pos)', 'x', 'y')}) <= 1 + a_id % 40 UNION SELECT point_id, id FROM held""")
def circles_meet_polygons(spark, d: str) -> DataFrame:
    p = customer_points(spark, d)
    circles = p.select(F.col("point_id").alias("id"), F.lit("circle").alias("kind"), F.array(F.struct("x", "y")).alias("line"), (1.0 + F.col("point_id") % 40).alias("km"))
    return spatial.shapes_meet(circles, _as_polygons(pentagons(spark, d)), 0.5)


@query(f"WITH {_PENTAGONS}, {_PENT_EDGES}, {_LINES}, {_HELD} SELECT * FROM held")
def points_in_polygons(spark, d: str) -> DataFrame:
    return spatial.points_inside(customer_points(spark, d), pentagons(spark, d).withColumnRenamed("ring", "line"), 0.5)


@query(f"""WITH {_TRIANGLES}, {_PENTAGONS}, {_TRI_EDGES}, {_PENT_EDGES}, {_BOXES} SELECT DISTINCT a_id, b_id FROM near JOIN tri_e l ON l.id = a_id JOIN pent_e e ON e.id = b_id WHERE sign({_CROSS}
 UNION SELECT a_id, b_id FROM near JOIN tri p ON p.id = a_id JOIN pent_e e ON e.id = b_id WHERE p.i = 0 GROUP BY 1, 2 HAVING count(*) FILTER ((e.y1 > p.y) != (e.y2 > p.y) AND p.x < e.x1 + (p.y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)) % 2 = 1
 UNION SELECT a_id, b_id FROM near JOIN pent p ON p.id = b_id JOIN tri_e e ON e.id = a_id WHERE p.i = 0 GROUP BY 1, 2 HAVING count(*) FILTER ((e.y1 > p.y) != (e.y2 > p.y) AND p.x < e.x1 + (p.y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)) % 2 = 1""")
def polygons_meet(spark, d: str) -> DataFrame:
    return spatial.shapes_meet(_as_polygons(triangles(spark, d)), _as_polygons(pentagons(spark, d)), 0.5)


@query(f"""WITH pts AS (SELECT c_custkey AS point_id, {LON.format('c_custkey')} AS x, {LAT.format('c_custkey')} AS y FROM customer),
places AS (SELECT s_suppkey AS place_id, {LON.format('s_suppkey * 11')} AS px, {LAT.format('s_suppkey * 11')} AS py FROM supplier)
SELECT point_id, place_id, CAST(row_number() OVER (PARTITION BY point_id ORDER BY {_hav('x', 'y', 'px', 'py')}, place_id) AS INTEGER) AS r FROM pts, places
QUALIFY r <= 3""")
def nearest_widening(spark, d: str) -> DataFrame:
    return spatial.nearest_k_widening(customer_points(spark, d), supplier_places(spark, d), 3, 20.0).select("point_id", "place_id", "r")


@query(f"""WITH {_TRIANGLES} SELECT id, CAST(round(min(x) * 1e6) AS BIGINT) AS x1_e6, CAST(round(min(y) * 1e6) AS BIGINT) AS y1_e6 FROM tri GROUP BY id HAVING min(x) <= 144.6 AND max(x) >= 143.8 AND min(y) <= -36.2 AND max(y) >= -37.0""")
def packed_box(spark, d: str) -> DataFrame:
    path = fresh_path(spark, "packed")
    layout.write_packed(box_of(triangles(spark, d)), path)
    box = layout.read_box(spark, path, 143.8, -37.0, 144.6, -36.2)
    return box.select("id", *[F.round(F.col(c) * 1e6).cast("long").alias(f"{c}_e6") for c in ("x1", "y1")])


# every order is a road of four lines: one of five points to the east, its end carried on, its start carried on the other way
# around and a little aside, and a branch to the north


@query(f"""SELECT o_orderkey AS id, CAST(7 + o_orderkey % 3 + o_orderkey % 2 AS INTEGER) AS points, CAST(round(({LON.format('o_orderkey')} - (1 + o_orderkey % 2) * 0.01) * 1e4) AS BIGINT) AS x1_e4,
 CAST(round(({LON.format('o_orderkey')} + (5 + o_orderkey % 3) * 0.01) * 1e4) AS BIGINT) AS x2_e4, CAST(round({LAT.format('o_orderkey')} * 1e4) AS BIGINT) AS y_e4 FROM orders""")
def line_union(spark, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    row = lambda first, last, aside, step: F.transform(F.sequence(first, last, F.lit(step)), lambda i: F.struct((lon(k) + i * 0.01).alias("x"), (lat(k) + aside).alias("y")))
    zero, four = F.lit(0), F.lit(4)
    branch = F.transform(F.sequence(zero, F.lit(2)), lambda i: F.struct((lon(k) + 0.02).alias("x"), (lat(k) + i * 0.01).alias("y")))
    lines = F.array(row(zero, four, 0.0, 1), row(F.lit(3), (5 + k % 3).cast("int"), 0.0, 1), row(F.lit(1), (-1 - k % 2).cast("int"), 0.000002, -1), branch)
    each = table(spark, d, "orders").select(k.alias("id"), F.posexplode(lines).alias("seq", "line"))
    found = union.unite_lines(each, "id")
    bound = lambda f, c: F.round(f(F.transform("line", lambda p: p[c])) * 1e4).cast("long")
    return found.select("id", F.size("line").alias("points"), bound(F.array_min, "x").alias("x1_e4"), bound(F.array_max, "x").alias("x2_e4"), bound(F.array_min, "y").alias("y_e4"))


# text forms and selections


@query("""SELECT c_custkey AS id, 'POLYGON' AS type, 4 AS points, concat('POLYGON ((', x1, ' ', y1, ', ', x2, ' ', y1, ', ', x2, ' ', y2, ', ', x1, ' ', y1, '))') AS wkt FROM (
 SELECT c_custkey, printf('%.6f', (140200000 + c_custkey * 7919 % 10400000) / 1e6) AS x1, printf('%.6f', (-39700000 + c_custkey * 6271 % 6200000) / 1e6) AS y1,
  printf('%.6f', (140300000 + c_custkey * 7919 % 10400000) / 1e6) AS x2, printf('%.6f', (-39500000 + c_custkey * 6271 % 6200000) / 1e6) AS y2 FROM customer)""")
def wkt_polygon(spark, d: str) -> DataFrame:
    """Text of a triangle, read back."""
    k = F.col("c_custkey")
    corner = lambda dx, dy: F.struct(((lon_e6(k) + dx) / 1e6).alias("x"), ((lat_e6(k) + dy) / 1e6).alias("y"))
    ring = F.array(corner(0, 0), corner(100000, 0), corner(100000, 200000))
    rows = table(spark, d, "customer").select(k.alias("id"), geo.wkt_polygon(F.array(ring)).alias("wkt")).withColumn("g", geo.from_wkt(F.col("wkt")))
    return rows.select("id", "g.type", F.size(F.col("g.lines")[0]).alias("points"), geo.wkt_polygon(F.col("g.lines")).alias("wkt"))


@query("""SELECT p_partkey AS id FROM part WHERE CAST(p_partkey AS VARCHAR) LIKE '1%7' AND p_size IN (1, 5, 7, 20, 35)""")
def selected_features(spark, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return spatial.selected(parts, "1*7", {"p_size": [1, 5, 7, 20, 35]}).select("id")


@query(f"""WITH p AS (SELECT o_orderkey AS id, o_orderkey % 3 AS n, {LON.format('o_orderkey')} AS x, {LAT.format('o_orderkey')} AS y FROM orders)
SELECT id AS input_id, CASE WHEN n = 0 THEN 'LineString' ELSE 'MultiLineString' END AS type, CAST(CASE WHEN n = 0 THEN 1 ELSE 2 END AS INTEGER) AS parts,
 CAST(round((x + 0.003) * 1e5) AS BIGINT) AS x1_e5, CAST(round((x + CASE WHEN n = 0 THEN 0.017 ELSE 0.0125 END) * 1e5) AS BIGINT) AS x2_e5 FROM p""")
def recomputed_relationships(spark, d: str) -> DataFrame:
    """Each order's line runs beside two ways: that go on from each other, or with a gap between them."""
    k = F.col("o_orderkey")
    row = lambda xs, dy: F.array(*[F.struct((lon(k) + x).alias("x"), (lat(k) + dy).alias("y")) for x in xs])
    second = F.when(k % 3 == 0, row((0.01, 0.02), 0.0)).otherwise(row((0.0125, 0.02), 0.0))
    pairs = table(spark, d, "orders").select(k.alias("input_id"), row((0.003, 0.017), 0.0001).alias("line"), F.array(row((0.0, 0.01), 0.0), second).alias("ways"))
    found = relationships.recomputed(pairs)
    at = lambda part: F.round(F.array_max(F.transform(part, lambda p: p["x"])) * 1e5).cast("long")
    first = F.round(F.array_min(F.transform(F.col("parts")[0], lambda p: p["x"])) * 1e5).cast("long")
    last = F.when(F.size("parts") == 1, at(F.col("parts")[0])).otherwise(F.round(F.array_min(F.transform(F.get("parts", 1), lambda p: p["x"])) * 1e5).cast("long"))
    return found.select("input_id", "type", F.size("parts").alias("parts"), first.alias("x1_e5"), last.alias("x2_e5"))
