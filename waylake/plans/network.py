"""Graph, matching, resolution, splitting, export and stream queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from waylake.functions import geo
from waylake.operators import export, graph, matching, overlay, paths, polygons, resolve, splitting, trellis
from waylake.plans.spatial import ORDER_STEPS, _hav, customer_points, e4, order_lines, supplier_places
from waylake.plans.tables import LAT, LON, lat, lat_e6, lon, lon_e6, table
from waylake.streaming import windows

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# the road graph: each supplier is a way over three nodes; there are about half as many nodes as suppliers


def ways(spark, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("id"), F.array(F.expr("s_suppkey div 2"), F.expr("s_suppkey div 3"), F.expr("s_suppkey div 2 + 1 + s_suppkey % 3")).alias("nodes"), (k % 4 == 0).alias("oneway"), (k % 12 == 0).alias("reverseway"),
        F.concat(F.lit("road "), F.expr("s_suppkey div 3").cast("string")).alias("name"),
    )


def edges(spark, d: str) -> DataFrame:
    return graph.road_edges(ways(spark, d))


EDGES = """seg AS (SELECT s_suppkey AS way_id, 0 AS seq, s_suppkey // 2 AS a, s_suppkey // 3 AS b FROM supplier
  UNION ALL SELECT s_suppkey, 1, s_suppkey // 3, s_suppkey // 2 + 1 + s_suppkey % 3 FROM supplier),
e AS (SELECT a AS src, b AS dst, way_id, seq FROM seg WHERE way_id % 12 != 0
  UNION ALL SELECT b, a, way_id, seq FROM seg WHERE way_id % 12 = 0 OR way_id % 4 != 0)"""


@query(f"WITH {EDGES} SELECT * FROM e")
def road_edges(spark, d: str) -> DataFrame:
    return edges(spark, d)


@query(f"""WITH {EDGES}, h0 AS (SELECT DISTINCT src AS start, src AS node FROM e),
h1 AS (SELECT DISTINCT start, dst AS node FROM h0 JOIN e ON e.src = h0.node), h2 AS (SELECT DISTINCT start, dst AS node FROM h1 JOIN e ON e.src = h1.node),
a AS (SELECT *, 0 AS hops FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2)
SELECT start, node, CAST(min(hops) AS INTEGER) AS hops FROM a GROUP BY 1, 2""")
def khop_neighbours(spark, d: str) -> DataFrame:
    e = edges(spark, d)
    return graph.within_hops(e, e.select(F.col("src").alias("node")), 2)


@query("""WITH RECURSIVE l AS (SELECT * FROM (SELECT s_suppkey AS a, CASE WHEN s_suppkey % 21 = 0 THEN s_suppkey + 7 ELSE s_suppkey - s_suppkey % 7 END AS b FROM supplier) WHERE a != b),
l2 AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT a AS node, a AS other FROM l2 UNION SELECT r.node, l2.b FROM r JOIN l2 ON l2.a = r.other)
SELECT node, min(other) AS component FROM r GROUP BY node""")
def connected_components(spark, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    links = table(spark, d, "supplier").select(k.alias("a"), F.when(k % 21 == 0, k + 7).otherwise(k - k % 7).alias("b"))
    return graph.connected_components(links)


@query(f"""WITH {EDGES}, n AS (SELECT src AS node, dst AS other FROM e UNION ALL SELECT dst, src FROM e)
SELECT node, count(DISTINCT other) AS degree FROM n WHERE node != other GROUP BY 1 HAVING count(DISTINCT other) >= 3""")
def intersection_nodes(spark, d: str) -> DataFrame:
    return graph.intersection_nodes(edges(spark, d))


@query(f"""WITH {EDGES}, x AS (SELECT src AS node, dst AS other, way_id FROM e UNION ALL SELECT dst, src, way_id FROM e),
n AS (SELECT node, concat('road ', way_id // 3) AS name, other, count(*) AS c FROM x GROUP BY 1, 2, 3),
w AS (SELECT node, concat('road ', way_id // 3) AS name, count(DISTINCT way_id) AS ways FROM x GROUP BY 1, 2)
SELECT n.node, n.name FROM n JOIN w USING (node, name) GROUP BY n.node, n.name, w.ways
HAVING w.ways = 3 AND count(*) = 3 AND count(*) FILTER (c = 2) = 1 AND count(*) FILTER (c = 1) = 2""")
def carriageway_change(spark, d: str) -> DataFrame:
    return graph.carriageway_changes(edges(spark, d), ways(spark, d))


_DEGREE = "deg AS (SELECT node FROM (SELECT src AS node, dst AS other FROM e UNION ALL SELECT dst, src FROM e) WHERE node != other GROUP BY 1 HAVING count(DISTINCT other) >= 3)"
_CHANGES = """x AS (SELECT src AS node, dst AS other, way_id FROM e UNION ALL SELECT dst, src, way_id FROM e),
cn AS (SELECT node, concat('road ', way_id // 3) AS name, other, count(*) AS c FROM x GROUP BY 1, 2, 3), cw AS (SELECT node, concat('road ', way_id // 3) AS name, count(DISTINCT way_id) AS ways FROM x GROUP BY 1, 2),
change AS (SELECT DISTINCT node FROM (SELECT cn.node FROM cn JOIN cw USING (node, name) GROUP BY cn.node, cn.name, cw.ways HAVING cw.ways = 3 AND count(*) = 3 AND count(*) FILTER (c = 2) = 1 AND count(*) FILTER (c = 1) = 2))"""


@query(f"""WITH RECURSIVE {EDGES}, {_DEGREE}, {_CHANGES}, even AS (SELECT node FROM deg WHERE node % 2 = 0),
near AS (SELECT DISTINCT e.src AS a, e.dst AS b FROM e JOIN even p ON p.node = e.src JOIN even q ON q.node = e.dst WHERE e.src != e.dst), both_ways AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.other), cluster AS (SELECT node, min(other) AS cluster FROM reach GROUP BY 1),
kind AS (SELECT node, CASE WHEN node IN (SELECT node FROM change) THEN 'carriageway_change' WHEN node % 10 = 3 THEN 'roundabout' WHEN c.node IS NOT NULL THEN 'complex' ELSE 'simple' END AS type, cluster FROM deg LEFT JOIN cluster c USING (node)),
grouped AS (SELECT type, CASE WHEN type = 'roundabout' THEN 3 WHEN type = 'complex' THEN cluster ELSE node END AS g, list(node ORDER BY node) AS nodes FROM kind GROUP BY 1, 2)
SELECT sha256(array_to_string(nodes, ',')) AS uid, type, array_to_string(nodes, ',') AS nodes FROM grouped""")
def intersections(spark, d: str) -> DataFrame:
    e = edges(spark, d)
    nodes = graph.intersection_nodes(e).where("degree >= 3").select("node")
    rounds = nodes.where("node % 10 = 3").select("node", F.lit(3).cast("long").alias("cluster"))
    found = graph.assemble_intersections(nodes, graph.carriageway_changes(e, ways(spark, d)), rounds, graph.clusters(e, nodes.where("node % 2 = 0")))
    return found.withColumn("nodes", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ","))


@query(f"""SELECT c_custkey AS signal, s_suppkey AS node FROM (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) AS r FROM (
 SELECT c_custkey, s_suppkey, {_hav(LON.format('c_custkey'), LAT.format('c_custkey'), LON.format('s_suppkey * 11'), LAT.format('s_suppkey * 11'))} AS km FROM customer, supplier) WHERE km <= 60) WHERE r = 1""")
def signal_reallocate(spark, d: str) -> DataFrame:
    return graph.allocate_signals(customer_points(spark, d), supplier_places(spark, d), 60.0, 1.0)


# every supplier's path starts along its way; every customer's one follows the ways of even numbers down to node 0

_STEPS = 8
_PATHS = f"""RECURSIVE walk AS (SELECT c_custkey + 1000000 AS path_id, 0 AS i, c_custkey % 50 + 4 AS node FROM customer
  UNION ALL SELECT path_id, i + 1, node * 2 // 3 FROM walk WHERE i < {_STEPS}),
n AS (SELECT * FROM walk UNION ALL SELECT s_suppkey, 0, s_suppkey // 2 FROM supplier UNION ALL SELECT s_suppkey, 1, s_suppkey // 3 FROM supplier
  UNION ALL SELECT s_suppkey, 2, s_suppkey // 2 + 1 + s_suppkey % 3 FROM supplier),
s AS (SELECT path_id, i AS seq, node AS src, lead(node) OVER (PARTITION BY path_id ORDER BY i) AS dst FROM n QUALIFY dst IS NOT NULL)"""
_BEST = f"""{EDGES}, best AS (SELECT src, dst, way_id, (way_id % 9 + 1) / 8 AS km FROM e QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY way_id % 9, way_id) = 1)"""
_LANES = "CAST(CASE WHEN way_id IS NULL THEN NULL WHEN way_id % 4 = 0 THEN way_id % 5 + 1 ELSE greatest(1, (way_id % 5 + 1) // 2) END AS INTEGER)"


def road_paths(spark, d: str) -> DataFrame:
    own = ways(spark, d).select(F.col("id").alias("path_id"), "nodes")
    start = F.array(F.col("c_custkey") % 50 + 4)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), start, lambda acc, _: F.array_append(acc, F.floor(F.element_at(acc, -1) * 2 / 3)))
    return own.union(table(spark, d, "customer").select((F.col("c_custkey") + 1_000_000).alias("path_id"), walk.alias("nodes")))


def lane_edges(spark, d: str) -> DataFrame:
    k = F.col("way_id")
    e = edges(spark, d).drop("seq").join(ways(spark, d).select(F.col("id").alias("way_id"), "oneway"), "way_id")
    return e.withColumns({"km": (k % 9 + 1) / 8, "maxspeed": 40 + k % 7 * 10, "lanes": (k % 5 + 1).cast("int")})


@query(f"""WITH {_PATHS}, {_BEST} SELECT path_id, CAST(seq AS INTEGER) AS seq, s.src, s.dst, way_id, CAST(round((40 + way_id % 7 * 10) / 3.6 * 10000) AS BIGINT) AS speed_e4, {_LANES} AS lanes FROM s LEFT JOIN best USING (src, dst)""")
def path_edges(spark, d: str) -> DataFrame:
    rows = paths.path_edges(road_paths(spark, d), lane_edges(spark, d))
    return rows.select("path_id", "seq", "src", "dst", "way_id", F.round(F.col("speed_ms") * 10000).cast("long").alias("speed_e4"), "lanes")


@query(f"""WITH {_PATHS}, {_BEST} SELECT path_id, CAST(seq AS INTEGER) AS seq, s.src, s.dst FROM s ANTI JOIN best USING (src, dst)""")
def path_steps_missing(spark, d: str) -> DataFrame:
    return paths.missing_steps(paths.path_edges(road_paths(spark, d), lane_edges(spark, d)))


_SEGMENTS = f"sgm AS (SELECT row_number() OVER (ORDER BY src, dst) AS seg_id, src, dst, {_LANES} AS lanes FROM best)"


@query(f"WITH {_BEST}, {_SEGMENTS} SELECT * FROM sgm")
def segment_ids(spark, d: str) -> DataFrame:
    return paths.segment_ids(lane_edges(spark, d))


# nodes that three divides are centroids of intersections, two and two of one intersection


def centroids(spark, d: str) -> DataFrame:
    nodes = table(spark, d, "supplier").where("s_suppkey % 3 = 0")
    return nodes.select(F.col("s_suppkey").alias("node"), (F.floor(F.col("s_suppkey") / 6) + 1).alias("intersection"))


_AT = """c AS (SELECT s_suppkey AS node, s_suppkey // 6 + 1 AS intersection FROM supplier WHERE s_suppkey % 3 = 0),
along AS (SELECT path_id, seq, s.src, s.dst, sum(km) OVER (PARTITION BY path_id ORDER BY seq) AS so_far FROM s LEFT JOIN best USING (src, dst)),
dist AS (SELECT path_id, intersection, min(seq + 1) AS node_seq, arg_min(so_far, seq) AS km FROM along JOIN c ON c.node = along.dst GROUP BY 1, 2)"""


@query(f"WITH {_PATHS}, {_BEST}, {_AT} SELECT path_id, intersection, CAST(node_seq AS INTEGER) AS node_seq, CAST(km * 8 AS BIGINT) AS km_8 FROM dist")
def path_distances(spark, d: str) -> DataFrame:
    found = paths.distances(paths.path_edges(road_paths(spark, d), lane_edges(spark, d)), centroids(spark, d))
    return found.select("path_id", "intersection", "node_seq", (F.col("km") * 8).cast("long").alias("km_8"))


_WATCH = """watch AS (SELECT a.path_id, a.seq, a.src, a.dst, (SELECT arg_min(intersection, node_seq) FROM dist d WHERE d.path_id = a.path_id AND d.node_seq > a.seq) AS watches FROM along a),
segw AS (SELECT seg_id, coalesce(last(watches ORDER BY path_id, seq) FILTER (watches IS NOT NULL), 1) AS intersection FROM sgm LEFT JOIN watch USING (src, dst) GROUP BY seg_id)"""


@query(f"WITH {_PATHS}, {_BEST}, {_SEGMENTS}, {_AT}, {_WATCH} SELECT * FROM segw")
def segment_watches(spark, d: str) -> DataFrame:
    rows = paths.path_edges(road_paths(spark, d), lane_edges(spark, d))
    return paths.segment_watches(paths.watched(rows, paths.distances(rows, centroids(spark, d))), paths.segment_ids(lane_edges(spark, d)))


@query(f"""WITH {_PATHS}, {_BEST}, {_SEGMENTS}, {_AT}, {_WATCH}, low AS (SELECT i.intersection, coalesce(min(km), 1e8) AS least FROM (SELECT DISTINCT intersection FROM segw) i LEFT JOIN dist USING (intersection) GROUP BY 1)
SELECT a.path_id, seg_id, CAST(round(sum(coalesce(d.km, 1e8) - least + 0.0001) * 10000) AS BIGINT) AS correction_e4 FROM along a JOIN sgm USING (src, dst) JOIN segw USING (seg_id) JOIN low USING (intersection)
LEFT JOIN dist d ON d.path_id = a.path_id AND d.intersection = segw.intersection GROUP BY 1, 2""")
def path_corrections(spark, d: str) -> DataFrame:
    rows, segments = paths.path_edges(road_paths(spark, d), lane_edges(spark, d)), paths.segment_ids(lane_edges(spark, d))
    distance = paths.distances(rows, centroids(spark, d))
    watches = paths.segment_watches(paths.watched(rows, distance), segments)
    found = paths.corrections(rows, segments, watches, distance)
    return found.select("path_id", "seg_id", F.round(F.col("correction") * 10000).cast("long").alias("correction_e4"))


@query(f"""WITH {_PATHS}, {_BEST}, {_AT}, moves AS (SELECT s_suppkey % 8 + 1 AS intersection, s_suppkey // 2 AS in_node, s_suppkey // 3 AS out_node, CAST(s_suppkey % 23 - 11 AS INTEGER) AS priority FROM supplier
 QUALIFY row_number() OVER (PARTITION BY s_suppkey % 8, s_suppkey // 2, s_suppkey // 3 ORDER BY s_suppkey) = 1), size AS (SELECT path_id, count(*) AS len FROM n GROUP BY 1),
events AS (SELECT d.path_id, d.intersection, n.i, CASE WHEN n.i > 0 AND m.node = n.node THEN 0
  WHEN n.node IN (SELECT in_node FROM moves WHERE moves.intersection = d.intersection) THEN CASE WHEN n.i >= len - 3 THEN 0 ELSE
   (SELECT arg_min(v.priority, o.i) FROM n o JOIN moves v ON v.out_node = o.node WHERE o.path_id = d.path_id AND o.i > n.i AND v.intersection = d.intersection AND v.in_node = n.node
     AND NOT EXISTS (SELECT 1 FROM c WHERE c.node = o.node AND c.intersection = d.intersection)) END END AS p
 FROM dist d JOIN n ON n.path_id = d.path_id JOIN n m ON m.path_id = d.path_id AND m.i = n.i + 1 JOIN size ON size.path_id = d.path_id)
SELECT path_id, intersection, CAST(greatest(-9, least(9, coalesce(arg_min(p, i) FILTER (p IS NOT NULL), -9))) AS INTEGER) AS priority FROM events GROUP BY 1, 2""")
def path_priorities(spark, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    moves = table(spark, d, "supplier").select((k % 8 + 1).alias("intersection"), F.expr("s_suppkey div 2").alias("in_node"), F.expr("s_suppkey div 3").alias("out_node"), k.alias("k"))
    moves = moves.groupBy("intersection", "in_node", "out_node").agg(F.min("k").alias("k")).withColumn("priority", (F.col("k") % 23 - 11).cast("int")).drop("k")
    all_paths = road_paths(spark, d)
    distance = paths.distances(paths.path_edges(all_paths, lane_edges(spark, d)), centroids(spark, d))
    return paths.priorities(all_paths, distance, moves, centroids(spark, d))


@query("""SELECT l_orderkey AS path_id, CAST(arg_min(l_linenumber, (l_quantity, l_linenumber)) AS INTEGER) AS seq FROM lineitem GROUP BY 1""")
def path_to_point_min(spark, d: str) -> DataFrame:
    points = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path_id"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").alias("km"))
    return graph.path_to_point(points).select("path_id", "seq")


@query("""WITH p AS (SELECT s_suppkey AS path_id, 0 AS seq, s_suppkey AS way_id FROM supplier UNION ALL SELECT s_suppkey, 1, s_suppkey - 1 FROM supplier),
n AS (SELECT path_id, seq, way_id, [way_id // 2, way_id // 3, way_id // 2 + 1 + way_id % 3] AS nodes FROM p WHERE way_id IN (SELECT s_suppkey FROM supplier)),
a AS (SELECT *, lead(nodes) OVER w AS nxt, lag(nodes) OVER w AS prv FROM n WINDOW w AS (PARTITION BY path_id ORDER BY seq))
SELECT path_id, CAST(seq AS INTEGER) AS seq, way_id, CASE WHEN list_contains(nxt, nodes[3]) THEN 'A' WHEN list_contains(nxt, nodes[1]) THEN 'B'
 WHEN list_contains(prv, nodes[1]) THEN 'A' WHEN list_contains(prv, nodes[3]) THEN 'B' ELSE 'O' END AS tag FROM a""")
def direction_tags(spark, d: str) -> DataFrame:
    paths = table(spark, d, "supplier").select(F.col("s_suppkey").alias("path_id"), F.array(F.col("s_suppkey"), F.col("s_suppkey") - 1).alias("ways"))
    return graph.direction_tags(paths, ways(spark, d))


# matching

_EMIT = "exp(-0.5 * pow(l_quantity / 10, 2))"
_COST = "round(-ln(least({0}, 1.0)), 3)"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, CAST(round({_COST.format(_EMIT)} * 1000) AS BIGINT) AS cost_e3 FROM lineitem")
def emission_cost(spark, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(matching.cost(matching.emission(F.col("l_quantity"))) * 1000).cast("long").alias("cost_e3"))


#: Line items are states: the different line numbers of an order are its steps, parts the ways.
_STATES = """s AS (SELECT DISTINCT l_orderkey AS id, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS step, l_partkey AS way,
 CAST(l_quantity AS BIGINT) AS q FROM lineitem)"""


def trellis_states(spark, d: str) -> DataFrame:
    step = F.dense_rank().over(W.partitionBy("l_orderkey").orderBy("l_linenumber")).cast("long")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), step.alias("step"), F.col("l_partkey").alias("way"), F.col("l_quantity").cast("long").alias("q")
    ).distinct()


@query(f"WITH {_STATES} SELECT a.id, a.step, a.way AS u, b.way AS v, a.q * 1000 + abs(a.way - b.way) AS cost FROM s a JOIN s b ON a.id = b.id AND b.step = a.step + 1")
def trellis_edges(spark, d: str) -> DataFrame:
    s = trellis_states(spark, d)
    b = s.select("id", (F.col("step") - 1).alias("step"), F.col("way").alias("v"))
    return s.join(b, ["id", "step"]).select("id", "step", F.col("way").alias("u"), "v", (F.col("q") * 1000 + F.abs(F.col("way") - F.col("v"))).alias("cost"))


@query(f"""WITH RECURSIVE {_STATES}, n AS (SELECT id, max(step) AS last FROM s GROUP BY 1), c AS (SELECT id, step, way, q AS cost FROM s WHERE step = 1
 UNION ALL SELECT s.id, s.step, s.way, min(c.cost + abs(c.way - s.way) + s.q) FROM s JOIN c ON c.id = s.id AND s.step = c.step + 1 GROUP BY 1, 2, 3)
SELECT c.id, min(c.cost) AS cost FROM c JOIN n ON n.id = c.id AND n.last = c.step GROUP BY 1""")
def hmm_min_cost(spark, d: str) -> DataFrame:
    return matching.min_cost(trellis_states(spark, d))


# every supplier is a town of three streets by three, every customer drives in one of them: along a street, then to the
# north or the south, some metres aside


def towns(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """(ways, nodes) of all towns."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    at = F.explode(F.sequence(F.lit(0), F.lit(8)))
    node = s.select(k, at.alias("i")).select((k * 10 + F.col("i")).alias("id"), (lon(k * 11) + F.col("i") % 3 * 0.002).alias("x"), (lat(k * 11) + F.expr("i div 3") * 0.002).alias("y"))
    way = s.select(k, F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    across = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: k * 10 + F.when(F.col("i") < 3, F.col("i") * 3 + j).otherwise(j * 3 + F.col("i") - 3))
    return way.select((k * 10 + F.col("i")).alias("id"), across.alias("nodes"), ((k + F.col("i")) % 5 == 0).alias("oneway"), F.lit(False).alias("reverseway")), node


def drives(spark, d: str) -> DataFrame:
    n = table(spark, d, "supplier").agg(F.count("*").alias("n"))  # one row
    k = F.col("c_custkey")
    c = table(spark, d, "customer").crossJoin(F.broadcast(n)).withColumn("s", ((k - 1) % F.col("n") + 1) * 11)
    x0, y0 = lon(F.col("s")), lat(F.col("s")) + k % 3 * 0.002 + k % 7 * 1e-5
    point = lambda x, y: F.struct((x0 + x).alias("x"), (y0 + y).alias("y"))
    zero = F.lit(0.0)
    line = F.array(point(0.0005 + k % 5 * 1e-4, zero), point(F.lit(0.0021), zero), point(F.lit(0.0035), zero), point(F.lit(0.00395), F.when(k % 2 == 0, 0.0007).otherwise(-0.0008)), point(F.lit(0.00401), F.when(k % 2 == 0, 0.0013).otherwise(-0.0013)))
    return c.select(k.alias("id"), line.alias("line"))


def _chord_sql(a: str, b: str) -> str:
    place = lambda p: (f"cos(radians({p}.y)) * cos(radians({p}.x))", f"cos(radians({p}.y)) * sin(radians({p}.x))", f"sin(radians({p}.y))")
    return "6371.0 * sqrt(" + " + ".join(f"pow({u} - {v}, 2)" for u, v in zip(place(a), place(b))) + ")"


_K = "s_suppkey"
_TOWNS = f"""RECURSIVE nodes AS (SELECT {_K} * 10 + i AS id, {LON.format(f'{_K} * 11')} + i % 3 * 0.002::DOUBLE AS x, {LAT.format(f'{_K} * 11')} + i // 3 * 0.002::DOUBLE AS y FROM supplier, range(9) t(i)),
seg AS (SELECT w.*, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, {_hav('a.x', 'a.y', 'b.x', 'b.y')} AS km FROM (
 SELECT {_K} AS town, {_K} * 10 + i AS way_id, j AS seg, ({_K} + i) % 5 != 0 AS two, {_K} * 10 + CASE WHEN i < 3 THEN i * 3 + j ELSE j * 3 + i - 3 END AS n1,
  {_K} * 10 + CASE WHEN i < 3 THEN i * 3 + j + 1 ELSE (j + 1) * 3 + i - 3 END AS n2 FROM supplier, range(6) t(i), range(2) u(j)) w JOIN nodes a ON a.id = n1 JOIN nodes b ON b.id = n2),
link AS (SELECT n1 AS src, n2 AS dst, km FROM seg UNION ALL SELECT n2, n1, km FROM seg WHERE two),
pts AS (SELECT c_custkey AS id, i + 1 AS step, town, {LON.format('town * 11')} + [0.0005::DOUBLE + c_custkey % 5 * 1e-4::DOUBLE, 0.0021, 0.0035, 0.00395, 0.00401][i + 1] AS x,
  {LAT.format('town * 11')} + c_custkey % 3 * 0.002::DOUBLE + c_custkey % 7 * 1e-5::DOUBLE + CASE WHEN i < 3 THEN 0.0 WHEN c_custkey % 2 = 0 THEN [0.0007, 0.0013][i - 2] ELSE [-0.0008, -0.0013][i - 2] END::DOUBLE AS y
  FROM (SELECT c_custkey, (c_custkey - 1) % (SELECT count(*) FROM supplier) + 1 AS town FROM customer), range(5) t(i)),
near AS (SELECT *, {_hav('(x1 + (x2 - x1) * pos)', '(y1 + (y2 - y1) * pos)', 'x', 'y')} AS d FROM (SELECT p.id, step, x, y, way_id, seg, n1, n2, km, x1, y1, x2, y2,
  greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS pos FROM pts p JOIN seg s ON s.town = p.town)),
st AS (SELECT *, round(pow(d * 1000 / 10, 2) / 2, 3) AS own FROM near WHERE d <= 0.02 QUALIFY row_number() OVER (PARTITION BY id, step, way_id ORDER BY d, seg) = 1),
road AS (SELECT id AS src, id AS dst, 0.0::DOUBLE AS km, 0 AS hops FROM nodes UNION ALL SELECT r.src, l.dst, r.km + l.km, hops + 1 FROM road r JOIN link l ON l.src = r.dst WHERE hops < 4),
best AS (SELECT src, dst, min(km) AS km FROM road GROUP BY 1, 2),
pair AS (SELECT u.id, u.step, u.way_id AS a, v.way_id AS b, u.n1 AS un1, u.n2 AS un2, u.pos AS up, u.km AS uk, v.n1 AS vn1, v.n2 AS vn2, v.pos AS vp, v.km AS vk, {_chord_sql('u', 'v')} AS chord FROM st u JOIN st v ON v.id = u.id AND v.step = u.step + 1),
ways_between AS (
 SELECT id, step, a, b, chord, 0.0 AS km FROM pair WHERE un1 = vn1 AND un2 = vn2 AND up = vp
 UNION ALL SELECT id, step, a, b, chord, abs(up - vp) * l.km FROM pair JOIN link l ON l.src = CASE WHEN up <= vp THEN un1 ELSE un2 END AND l.dst = CASE WHEN up <= vp THEN un2 ELSE un1 END WHERE un1 = vn1 AND un2 = vn2 AND up != vp
 UNION ALL SELECT id, step, a, b, chord, o.c + best.km + t.c FROM pair,
   LATERAL (SELECT un2 AS node, (1 - up) * uk AS c WHERE up = 1 OR EXISTS (SELECT 1 FROM link WHERE src = un1 AND dst = un2) UNION ALL SELECT un1, up * uk WHERE up = 0 OR EXISTS (SELECT 1 FROM link WHERE src = un2 AND dst = un1)) o,
   LATERAL (SELECT vn1 AS node, vp * vk AS c WHERE vp = 0 OR EXISTS (SELECT 1 FROM link WHERE src = vn1 AND dst = vn2) UNION ALL SELECT vn2, (1 - vp) * vk WHERE vp = 1 OR EXISTS (SELECT 1 FROM link WHERE src = vn2 AND dst = vn1)) t
   JOIN best ON best.src = o.node AND best.dst = t.node WHERE NOT (un1 = vn1 AND un2 = vn2)),
move AS (SELECT id, step, a, b, min(km) AS km, any_value(chord) AS chord FROM ways_between WHERE km <= CASE WHEN chord > 1e-9 THEN 2 * chord ELSE 0.1 END OR (km = 0 AND chord = 0) GROUP BY 1, 2, 3, 4),
priced AS (SELECT m.id, m.step + 1 AS step, a, b, round(abs(m.chord - m.km) * 1000, 3) + st.own AS c FROM move m JOIN st ON st.id = m.id AND st.step = m.step + 1 AND st.way_id = b WHERE abs(m.chord - m.km) * 1000 < 745),
total AS (SELECT id, step, way_id, own AS cost FROM st WHERE step = 1 UNION ALL SELECT p.id, p.step, p.b, min(t.cost + p.c) FROM priced p JOIN total t ON t.id = p.id AND p.step = t.step + 1 AND p.a = t.way_id GROUP BY 1, 2, 3)"""


@query(f"""WITH {_TOWNS}, done AS (SELECT id, min(cost) AS cost FROM total WHERE step = 5 GROUP BY 1)
SELECT c_custkey AS line_id, CAST(round(cost * 1000) AS BIGINT) AS cost_e3, cost IS NULL AS failed FROM customer LEFT JOIN done ON done.id = c_custkey""")
def match_lines(spark, d: str) -> DataFrame:
    found = trellis.match_lines(drives(spark, d), *towns(spark, d))
    return found.select("line_id", F.round(F.col("cost") * 1000).cast("long").alias("cost_e3"), F.col("error").isNotNull().alias("failed"))


# resolution


_MATCHES = """m AS (SELECT l_partkey AS way, l_suppkey % 4 AS name, l_quantity / 4096 AS km, CAST(l_suppkey % 90 AS DOUBLE) AS angle, CAST(l_orderkey % 40 AS DOUBLE) AS error FROM lineitem),
c AS (SELECT way, name, sum(km) AS L, median(angle) AS A, median(error) AS E FROM m GROUP BY 1, 2)"""


def match_rows(spark, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("way"), (F.col("l_suppkey") % 4).alias("name"), (F.col("l_quantity") / 4096).alias("km"),
        (F.col("l_suppkey") % 90).cast("double").alias("angle"), (F.col("l_orderkey") % 40).cast("double").alias("error"),
    )


@query(f"WITH {_MATCHES} SELECT way, name, CAST(round(L * 4096) AS BIGINT) AS l, CAST(A * 2 AS BIGINT) AS a2, CAST(E * 2 AS BIGINT) AS e2 FROM c")
def median_metrics(spark, d: str) -> DataFrame:
    c = resolve.candidates(match_rows(spark, d))
    return c.select("way", "name", F.round(F.col("L") * 4096).cast("long").alias("l"), (F.col("A") * 2).cast("long").alias("a2"), (F.col("E") * 2).cast("long").alias("e2"))


def _ladder(derived: bool) -> str:
    good_a, good_e = "(A < 8 OR A <= 1.2 * minA)", "(E < 10 OR E <= 1.5 * minE)"
    steps = [("L > 0.0025", "<= 1")]
    steps += [] if derived else [(f"L > 0.0025 AND {good_a} AND {good_e}", ">= 1")]
    steps += [("L > 0.0025 AND L = maxL AND E = minE AND A = minA", "= 1")]
    steps += [(f"L > 0.0025 AND {good_a} AND {good_e} AND L = maxL", "= 1")] if derived else []
    steps += [
        ("L > 0.0025 AND A = minA AND E = minE", "= 1"),
        ("L > 0.0025 AND E = minE AND L = maxL AND (A < 10 OR A < 1.2 * minA)", "= 1"),
        (f"L > 0.0025 AND A = minA AND L = maxL AND {good_e}", "= 1"),
        ("A < 50 AND E < 25", "<= 1"),
        ("A < 50 AND E < 25 AND L = maxL", "= 1"),
        ("A < 50 AND E < 25 AND E = minE", "= 1"),
    ]
    n = ", ".join(f"count(*) FILTER ({r}) OVER (PARTITION BY way) AS n{i}" for i, (r, _) in enumerate(steps))
    pick = " ".join(f"WHEN n{i} {w} THEN ({r})" for i, (r, w) in enumerate(steps))
    return f"""WITH {_MATCHES}, b AS (SELECT *, max(L) OVER (PARTITION BY way) AS maxL, min(A) OVER (PARTITION BY way) AS minA, min(E) OVER (PARTITION BY way) AS minE FROM c),
s AS (SELECT *, {n} FROM b) SELECT way, name FROM s WHERE CASE {pick} ELSE false END"""


@query(_ladder(False))
def resolve_ladder(spark, d: str) -> DataFrame:
    return resolve.resolve(resolve.candidates(match_rows(spark, d)))


@query(_ladder(True))
def resolve_ladder_derived(spark, d: str) -> DataFrame:
    return resolve.resolve(resolve.candidates(match_rows(spark, d)), derived=True)


@query("""SELECT l_partkey % 50 AS way, count(*) AS total, count(CASE WHEN l_linenumber != 7 THEN 1 END) AS matched FROM lineitem GROUP BY 1""")
def matched_share(spark, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 50).alias("way"))
    return m.agg(F.count("*").alias("total"), F.count_if(F.col("l_linenumber") != 7).alias("matched"))


@query("""WITH m AS (SELECT l_orderkey, CASE WHEN l_linenumber != 7 THEN CAST(l_orderkey % 40 AS DOUBLE) END AS error FROM lineitem)
SELECT CAST(CASE WHEN error >= 30 THEN 16 ELSE floor(error / 2) + 1 END AS BIGINT) AS bin, count(*) AS n FROM m WHERE error IS NOT NULL GROUP BY 1""")
def error_histogram(spark, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") != 7, (F.col("l_orderkey") % 40).cast("double")).alias("error"))
    return polygons.error_histogram(m)


@query("""WITH m AS (SELECT l_quantity AS km, CASE WHEN l_linenumber != 7 THEN CAST(l_orderkey % 40 AS DOUBLE) END AS error FROM lineitem)
SELECT count(*) AS total, count(error) AS matched, count(*) FILTER (error <= 10) AS good, CAST(round(sum(error * km) / sum(km) FILTER (error IS NOT NULL) * 10000) AS BIGINT) AS weighted_e4 FROM m""")
def error_summary(spark, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select(F.col("l_quantity").alias("km"), F.when(F.col("l_linenumber") != 7, (F.col("l_orderkey") % 40).cast("double")).alias("error"))
    return polygons.error_summary(m).select("total", "matched", "good", e4(F.col("weighted_error")).alias("weighted_e4"))


def _utm_sql(x: str, y: str, zone: str) -> tuple[str, str]:
    """Metres east and north by the transverse Mercator series, with a third flattening of WGS 84."""
    n = (1 / 298.257223563) / (2 - 1 / 298.257223563)
    big = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    lam, sin = f"radians({x} - ({zone} * 6 - 183))", f"sin(radians({y}))"
    t = f"sinh(atanh({sin}) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * {sin}))"
    xi, eta = f"atan2({t}, cos({lam}))", f"asinh(sin({lam}) / sqrt(pow({t}, 2) + pow(cos({lam}), 2)))"
    east = " + ".join([eta, *[f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1)]]).replace(eta, "eta", 1)
    north = " + ".join(["xi", *[f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1)]])
    return f"{xi} AS xi, {eta} AS eta", f"{big!r}::DOUBLE * ({east}) AS x, {big!r}::DOUBLE * ({north}) AS y"


_XI_ETA, _EN = _utm_sql("x", "y", "zone")

# the even-odd area of each ring: strips between all vertices and crossings, trapezoids between every other pair of edges
_EVEN_ODD = """edge AS (SELECT id, i, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM flat WINDOW w AS (PARTITION BY id ORDER BY i)),
cross_at AS (SELECT p.id, p.y1 + (p.y2 - p.y1) * ((q.x1 - p.x1) * (q.y2 - q.y1) - (q.y1 - p.y1) * (q.x2 - q.x1)) / ((p.x2 - p.x1) * (q.y2 - q.y1) - (p.y2 - p.y1) * (q.x2 - q.x1)) AS y FROM edge p JOIN edge q ON p.id = q.id AND p.i < q.i
 WHERE ((q.x1 - p.x1) * (q.y2 - q.y1) - (q.y1 - p.y1) * (q.x2 - q.x1)) / ((p.x2 - p.x1) * (q.y2 - q.y1) - (p.y2 - p.y1) * (q.x2 - q.x1)) BETWEEN 1e-12 AND 1 - 1e-12
  AND ((q.x1 - p.x1) * (p.y2 - p.y1) - (q.y1 - p.y1) * (p.x2 - p.x1)) / ((p.x2 - p.x1) * (q.y2 - q.y1) - (p.y2 - p.y1) * (q.x2 - q.x1)) BETWEEN 1e-12 AND 1 - 1e-12),
cut AS (SELECT id, y AS lo, lead(y) OVER (PARTITION BY id ORDER BY y) AS hi FROM (SELECT id, y FROM flat UNION SELECT id, y FROM cross_at)),
bar AS (SELECT c.id, lo, hi, x1 + ((lo + hi) / 2 - y1) * (x2 - x1) / (y2 - y1) AS xm FROM cut c JOIN edge e ON e.id = c.id AND least(y1, y2) <= lo AND greatest(y1, y2) >= hi WHERE hi > lo AND y1 != y2),
area AS (SELECT id, sum((hi - lo) * (CASE WHEN r % 2 = 0 THEN xm ELSE -xm END)) AS m2 FROM (SELECT *, row_number() OVER (PARTITION BY id, lo ORDER BY xm) AS r FROM bar) GROUP BY id)"""


@query(f"""WITH {ORDER_STEPS}, n AS (SELECT id, count(*) AS n, sum({_hav('x', 'y', 'x2', 'y2')}) FILTER (x2 IS NOT NULL) AS km, sum({_hav('(x + 0.0001)', '(y + 0.0001)', '(x2 + 0.0001)', '(y2 + 0.0001)')}) FILTER (x2 IS NOT NULL) AS km2,
 ceil((first(x ORDER BY i) + 180) / 6) AS zone FROM steps GROUP BY 1),
ring AS (SELECT id, i, x, y, zone, n FROM steps JOIN n USING (id) WHERE n > 1 UNION ALL SELECT id, 2 * n + 1 - i, x + 0.0001, y + 0.0001, zone, n FROM steps JOIN n USING (id) WHERE n > 1),
flat0 AS (SELECT id, i, {_EN} FROM (SELECT id, i, {_XI_ETA} FROM ring)),
flat AS (SELECT id, i, x - first(x) OVER w AS x, y - first(y) OVER w AS y FROM flat0 WINDOW w AS (PARTITION BY id ORDER BY i)), {_EVEN_ODD}
SELECT n.id, CAST(round(coalesce(m2, 0) / (nullif(km + km2, 0) * 500) * 1000) AS BIGINT) AS error_e3 FROM n LEFT JOIN area USING (id) WHERE n > 1""")
def polygon_error(spark, d: str) -> DataFrame:
    """Error between each order's line and the same line a little aside."""
    near = order_lines(spark, d).where(F.size("line") > 1)
    moved = F.transform("line", lambda p: F.struct((p["x"] + 0.0001).alias("x"), (p["y"] + 0.0001).alias("y")))
    pairs = near.select(F.col("id").alias("pair"), F.col("line").alias("a"), moved.alias("b"))
    return overlay.area_between(pairs).select(F.col("pair").alias("id"), F.round(F.col("error") * 1000).cast("long").alias("error_e3"))


@query(f"""WITH {ORDER_STEPS}, far AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM (SELECT *, CASE WHEN x2 IS NULL THEN 0 ELSE 1000 * {_hav('x', 'y', 'x2', 'y2')} END AS m FROM steps)),
size AS (SELECT id, sum(m) AS whole, CASE WHEN sum(m) < 500 THEN sum(m) / 10 ELSE 50.0 END AS cut FROM far GROUP BY 1),
kept AS (SELECT id, i::DOUBLE AS o, x, y FROM far JOIN size USING (id) WHERE whole = 0 OR pos > cut
 UNION ALL SELECT id, i + 0.5, x + (x2 - x) * (cut - pos) / m, y + (y2 - y) * (cut - pos) / m FROM far JOIN size USING (id) WHERE whole > 0 AND pos <= cut AND pos + m > cut),
back AS (SELECT *, lag(x) OVER w AS x2, lag(y) OVER w AS y2 FROM kept WINDOW w AS (PARTITION BY id ORDER BY o)),
left_m AS (SELECT *, CASE WHEN x2 IS NULL THEN 0 ELSE 1000 * {_hav('x', 'y', 'x2', 'y2')} END AS m FROM back), rest AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY id ORDER BY o DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM left_m),
done AS (SELECT id, o, x, y FROM rest JOIN size USING (id) WHERE whole = 0 OR pos > cut
 UNION ALL SELECT id, o - 0.25, x + (x2 - x) * (cut - pos) / m, y + (y2 - y) * (cut - pos) / m FROM rest JOIN size USING (id) WHERE whole > 0 AND pos <= cut AND pos + m > cut),
last AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM done WINDOW w AS (PARTITION BY id ORDER BY o))
SELECT id, CAST(round(coalesce(sum({_hav('x', 'y', 'x2', 'y2')}) FILTER (x2 IS NOT NULL), 0) * 10000) AS BIGINT) AS km_e4, CAST(count(*) AS INTEGER) AS points FROM last GROUP BY id""")
def trim_ends(spark, d: str) -> DataFrame:
    return splitting.trim_ends(order_lines(spark, d)).select("id", e4(geo.length_km(F.col("line"))).alias("km_e4"), F.size("line").alias("points"))


@query(f"""WITH cut AS (SELECT DISTINCT l_orderkey AS way_id, l_partkey % 40 AS c FROM lineitem WHERE l_partkey % 40 BETWEEN 5 AND 34),
numbered AS (SELECT way_id, c, (SELECT max(o_orderkey) * 10 + 4 FROM orders) + row_number() OVER (ORDER BY way_id, c) AS node_id FROM cut),
v AS (SELECT way_id, c * 10 - 47 AS pos, node_id, true AS is_new FROM numbered UNION ALL SELECT o_orderkey, i * 100, o_orderkey * 10 + i, false FROM orders, range(4) t(i) WHERE o_orderkey IN (SELECT way_id FROM cut)),
n AS (SELECT *, sum(is_new::INT) OVER (PARTITION BY way_id ORDER BY pos) AS before FROM v),
p AS (SELECT way_id, before AS piece, pos, node_id, is_new FROM n UNION ALL SELECT way_id, before - 1, pos, node_id, is_new FROM n WHERE is_new)
SELECT way_id, CAST(piece AS INTEGER) AS piece, CAST(row_number() OVER (PARTITION BY way_id, piece ORDER BY pos) - 1 AS INTEGER) AS seq, node_id, is_new FROM p""")
def way_split_pieces(spark, d: str) -> DataFrame:
    """Orders are ways of four nodes east to west, line items cut points near them."""
    k = F.col("o_orderkey")
    node = lambda i: F.struct((k * 10 + i).alias("id"), (lon(k) + i * 0.01).alias("x"), lat(k).alias("y"))
    w = table(spark, d, "orders").select(k.alias("way_id"), F.array(*[node(i) for i in range(4)]).alias("nodes"))
    order = F.col("l_orderkey")
    cuts = table(spark, d, "lineitem").select(
        order.alias("way_id"), F.col("l_linenumber").alias("seq"), (lon(order) + F.col("l_partkey") % 40 / 1000 - 0.0047).alias("x"), (lat(order) + 0.0001).alias("y")
    )
    top = table(spark, d, "orders").agg(F.max(k * 10 + 4).alias("top")).first()["top"] or 0  # one number
    return splitting.number_new_nodes(splitting.split_ways(w, cuts), top).select("way_id", "piece", "seq", "node_id", "is_new")


# export


@query("""SELECT n_nationkey AS id, concat('{"id":', n_nationkey, ',"type":"node","manual_edit":false,"lon":', printf('%.6f', (140200000 + n_nationkey * 7919 % 10400000) / 1e6),
 ',"lat":', printf('%.6f', (-39700000 + n_nationkey * 6271 % 6200000) / 1e6), '}') AS element FROM nation
UNION ALL SELECT 1000 + n_nationkey, concat('{"id":', 1000 + n_nationkey, ',"way_id":', 1000 + n_nationkey, ',"type":"way","manual_edit":false,"nodes":[', n_nationkey, ',', n_regionkey,
 '],"source_matched_id":"', n_name, '","tags":{"name":"', n_name, '"}}') FROM nation""")
def osm_json_export(spark, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    k = F.col("n_nationkey").cast("long")
    nodes = n.select(k.alias("id"), (lon_e6(k).cast("decimal(18,0)") / 1000000).alias("x"), (lat_e6(k).cast("decimal(18,0)") / 1000000).alias("y"))
    w = n.select(
        (k + 1000).alias("id"), F.lit(None).cast("long").alias("parent_id"), F.array(k, F.col("n_regionkey").cast("long")).alias("nodes"),
        F.col("n_name").alias("matched_id"), F.create_map(F.lit("name"), "n_name").alias("tags"),
    )
    return export.node_elements(nodes).unionByName(export.way_elements(w))


@query("""SELECT n_nationkey AS id, concat('{"type":"Feature","id":', n_nationkey, ',"geometry":{"type":"Point","coordinates":[', printf('%.6f', (140200000 + n_nationkey * 7919 % 10400000) / 1e6), ',',
 printf('%.6f', (-39700000 + n_nationkey * 6271 % 6200000) / 1e6), ']},"properties":{"name":"', n_name, '"}}') AS feature FROM nation""")
def geojson_features(spark, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    x, y = lon_e6(k).cast("decimal(18,0)") / 1000000, lat_e6(k).cast("decimal(18,0)") / 1000000
    return table(spark, d, "nation").select(k.alias("id"), export.point_feature(k, x, y, F.struct(F.col("n_name").alias("name"))).alias("feature"))


# streams


def cents(df: DataFrame) -> DataFrame:
    """Events with values in whole cents, so that sums are exact."""
    return windows.instants(df).withColumn("value", F.round(F.col("value") * 100).cast("long"))


@query("""SELECT event_id, count(*) OVER w AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS total FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""")
def trailing_window_stats(spark, d: str) -> DataFrame:
    return windows.trailing(cents(table(spark, d, "events")), 86400, ["user_id"]).select("event_id", "n", "total")


_BY_HOUR = """SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2"""


def shown(df: DataFrame, *by: str) -> DataFrame:
    return df.select(F.unix_micros("start").alias("start_us"), *by, "n", "total")


@query(_BY_HOUR)
def tumbling_counts(spark, d: str) -> DataFrame:
    return shown(windows.tumbling(cents(table(spark, d, "events")), "1 hour", ["event_type"]), "event_type")


@query(_BY_HOUR)
def stream_tumbling_counts(spark, d: str) -> DataFrame:
    """The same counts from a stream over the file."""
    schema = table(spark, d, "events").schema
    stream = cents(windows.file_stream(spark, f"{d}/events.parque[t]", schema)).withWatermark("ts", "1 hour")
    return shown(windows.run_available(windows.tumbling(stream, "1 hour", ["event_type"]), "complete"), "event_type")


@query("""WITH b AS (SELECT epoch_us(time_bucket(INTERVAL '30 minutes', ts)) AS half, event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events),
w AS (SELECT half AS start_us, event_type, v FROM b UNION ALL SELECT half - 1800000000, event_type, v FROM b)
SELECT start_us, event_type, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM w GROUP BY 1, 2""")
def sliding_counts(spark, d: str) -> DataFrame:
    return shown(windows.sliding(cents(table(spark, d, "events")), "1 hour", "30 minutes", ["event_type"]), "event_type")


@query("""WITH g AS (SELECT user_id, ts, CAST(round(value * 100) AS BIGINT) AS v, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT epoch_us(min(ts)) AS start_us, user_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM s GROUP BY user_id, session""")
def session_counts(spark, d: str) -> DataFrame:
    return shown(windows.sessions(cents(table(spark, d, "events")), "2 hours", ["user_id"]), "user_id")
