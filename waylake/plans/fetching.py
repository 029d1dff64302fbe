"""Graph fetches, loads, searches around nodes and points along lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waylake.operators import eav, fetch, graph, loads, relationships, search, versions
from waylake.plans.network import EDGES, edges, ways
from waylake.plans.spatial import ORDER_STEPS, _hav, e4, order_lines
from waylake.plans.tables import LAT, LON, lat, lon, table

QUERIES = {}
ORACLES = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# parts are ways of the original or the derived graph, customers nodes

HIGHWAYS = ("residential", "cycleway", "primary", "footway", "roundabout", "track", "circular", "pedestrian", "service")

GRAPH_SQL = f"""w AS (SELECT p_partkey AS k, concat(CASE WHEN p_partkey % 4 = 0 THEN 'DTP' ELSE 'OSM' END, '&&WAY&&', p_partkey) AS feature_id, p_name FROM part),
feat AS (SELECT feature_id, 'LINE' AS feature_type, CAST(NULL AS VARCHAR) AS geometry FROM w WHERE k % 6 != 0
 UNION ALL SELECT concat('OSM&&NODE&&', c_custkey), 'POINT', concat('{{"type":"Point","coordinates":[', printf('%.6f', {LON.format('c_custkey')}), ',', printf('%.6f', {LAT.format('c_custkey')}), ']}}')
 FROM customer WHERE c_custkey % 8 != 0),
attr AS (SELECT feature_id, s_name, max(s_value) AS s_value FROM (SELECT feature_id, 'highway' AS s_name, {list(HIGHWAYS)}[CAST(k % 9 + 1 AS INTEGER)] AS s_value FROM w WHERE k % 10 != 0
 UNION ALL SELECT feature_id, 'name', p_name FROM w WHERE k % 14 != 0
 UNION ALL SELECT feature_id, 'name', concat('a ', p_name) FROM w WHERE k % 15 = 0
 UNION ALL SELECT feature_id, 'nodes', CASE WHEN k % 17 = 0 THEN 'none' ELSE concat('["OSM&&NODE&&', k // 2, '", "OSM&&NODE&&', k // 3, '", "OSM&&NODE&&', k % 50, '"]') END FROM w WHERE k % 13 != 0) GROUP BY 1, 2)"""


def stored_graph(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """(features, attributes) with rows that aren't current among them."""
    k, c = F.col("p_partkey"), F.col("c_custkey")
    current = lambda hit: {"version_start": F.when(hit, 1), "version_end": F.lit(None).cast("int")}
    p = table(spark, d, "part").withColumn("feature_id", F.concat(F.when(k % 4 == 0, "DTP").otherwise("OSM"), F.lit("&&WAY&&"), k.cast("string")))
    more = {"layer_id": F.lit("OSM"), "s_source_id": F.lit(None).cast("string")}
    lines = p.select("feature_id", F.lit("LINE").alias("feature_type"), F.col("p_name").alias("s_name"), F.lit(None).cast("string").alias("geometry"), (k % 6 != 0).alias("hit"))
    place = F.format_string('{"type":"Point","coordinates":[%.6f,%.6f]}', lon(c), lat(c))
    points = table(spark, d, "customer").select(
        F.concat(F.lit("OSM&&NODE&&"), c.cast("string")).alias("feature_id"), F.lit("POINT").alias("feature_type"), F.lit(None).cast("string").alias("s_name"), place.alias("geometry"), (c % 8 != 0).alias("hit")
    )
    features = lines.unionByName(points).withColumns({**more, **current(F.col("hit"))}).drop("hit")
    node = lambda i: F.concat(F.lit('"OSM&&NODE&&'), i.cast("string"), F.lit('"'))
    listed = F.concat(F.lit("["), F.concat_ws(", ", node(F.expr("p_partkey div 2")), node(F.expr("p_partkey div 3")), node(k % 50)), F.lit("]"))
    wide = p.select(
        "feature_id", "p_partkey", F.element_at(F.array(*map(F.lit, HIGHWAYS)), (k % 9 + 1).cast("int")).alias("highway"), F.col("p_name").alias("name"), F.when(k % 17 == 0, "none").otherwise(listed).alias("nodes")
    )
    tall = eav.unpivot(wide, ["feature_id", "p_partkey"], ["highway", "name", "nodes"])
    old = ((F.col("s_name") == "highway") & (k % 10 == 0)) | ((F.col("s_name") == "name") & (k % 14 == 0)) | ((F.col("s_name") == "nodes") & (k % 13 == 0))
    again = p.where(k % 15 == 0).select("feature_id", F.lit("name").alias("s_name"), F.concat(F.lit("a "), "p_name").alias("s_value"), F.lit(1).alias("version_start"), F.lit(None).cast("int").alias("version_end"))
    return features, tall.withColumns(current(~old)).drop("p_partkey").unionByName(again)


def _rows_sql(kind: str, prefixes: str) -> str:
    tags = "string_agg(concat(s_name, '=', s_value), ';' ORDER BY s_name) AS tags, max(CASE WHEN s_name = 'nodes' THEN s_value END) AS nodes"
    if kind == "full":
        return f"""WITH {GRAPH_SQL}, t AS (SELECT feature_id, {tags} FROM attr GROUP BY 1)
SELECT feature_id, tags, feature_type, geometry FROM feat LEFT JOIN t USING (feature_id) WHERE regexp_matches(feature_id, '^({prefixes})&&')"""
    values = "'cycleway', 'footway', 'pedestrian', 'track'" + (", 'circular', 'roundabout'" if kind == "road" else "")
    keep = "NOT" if kind == "road" else ""
    return f"""WITH {GRAPH_SQL}, t AS (SELECT feature_id, {tags}, bool_or(s_name = 'highway' AND s_value IN ({values})) AS hit FROM attr WHERE regexp_matches(feature_id, '^({prefixes})&&WAY') GROUP BY 1),
way AS (SELECT * FROM t WHERE {keep} hit)
SELECT feature_id, tags, feature_type, geometry FROM feat JOIN way USING (feature_id)
UNION ALL SELECT feature_id, NULL, feature_type, geometry FROM feat WHERE feature_id IN (SELECT unnest(regexp_extract_all(nodes, 'OSM&&NODE&&[0-9]+')) FROM way)"""


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("feature_id", eav.as_text(F.col("tags")).alias("tags"), "feature_type", "geometry")


@query(_rows_sql("road", "OSM"))
def fetch_road(spark, d: str) -> DataFrame:
    return shown(fetch.graph_rows(*stored_graph(spark, d), "road"))


@query(_rows_sql("trail", "OSM"))
def fetch_trail(spark, d: str) -> DataFrame:
    return shown(fetch.graph_rows(*stored_graph(spark, d), "trail"))


@query(_rows_sql("full", "OSM"))
def fetch_full(spark, d: str) -> DataFrame:
    return shown(fetch.graph_rows(*stored_graph(spark, d), "full"))


@query(_rows_sql("road", "OSM|DTP"))
def fetch_road_derived(spark, d: str) -> DataFrame:
    return shown(fetch.graph_rows(*stored_graph(spark, d), "road", fetch.DERIVED))


@query(_rows_sql("trail", "OSM|DTP"))
def fetch_trail_derived(spark, d: str) -> DataFrame:
    return shown(fetch.graph_rows(*stored_graph(spark, d), "trail", fetch.DERIVED))


@query(_rows_sql("full", "OSM|DTP"))
def fetch_full_derived(spark, d: str) -> DataFrame:
    return shown(fetch.graph_rows(*stored_graph(spark, d), "full", fetch.DERIVED))


@query(f"""WITH {GRAPH_SQL} SELECT feature_id AS id, array_to_string(regexp_extract_all(s_value, 'OSM&&NODE&&[0-9]+'), ',') AS nodes FROM feat JOIN attr USING (feature_id)
WHERE s_name = 'nodes' AND s_value != 'none' AND feature_id LIKE 'OSM%'""")
def graph_ways(spark, d: str) -> DataFrame:
    found, _ = fetch.elements(fetch.graph_rows(*stored_graph(spark, d), "full"))
    return found.select("id", F.array_join("nodes", ",").alias("nodes"))


@query(f"SELECT concat('OSM&&NODE&&', c_custkey) AS id, CAST(round({LON.format('c_custkey')} * 1000000) AS BIGINT) AS x_e6, CAST(round({LAT.format('c_custkey')} * 1000000) AS BIGINT) AS y_e6 FROM customer WHERE c_custkey % 8 != 0")
def graph_points(spark, d: str) -> DataFrame:
    _, found = fetch.elements(fetch.graph_rows(*stored_graph(spark, d), "full"))
    return found.select("id", F.round(F.col("x") * 1000000).cast("long").alias("x_e6"), F.round(F.col("y") * 1000000).cast("long").alias("y_e6"))


@query("""SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'POINT' WHEN 1 THEN 'LINE' END AS kind, upper(n_name) AS name FROM nation""")
def geometry_kinds(spark, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    element = F.element_at(F.array(F.lit("node"), F.lit("way"), F.lit("relation")), (k % 3 + 1).cast("int"))
    return table(spark, d, "nation").select(k.alias("id"), fetch.geometry_kind(element).alias("kind"), F.upper("n_name").alias("name"))


# scans, loads, versions


@query("""SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey >= 100 AND o_orderstatus IN ('F', 'P') AND o_orderpriority LIKE '1-%' AND o_custkey % 2 = 0""")
def table_scan(spark, d: str) -> DataFrame:
    filters = [("o_orderkey", ">=", 100), ("o_orderstatus", "in", ["F", "P"]), ("o_orderpriority", "like", "1-%"), "o_custkey % 2 = 0"]
    return loads.select_from(table(spark, d, "orders"), {"o_orderkey": "id", "o_orderstatus": "status"}, filters)


_LOAD_SQL = """old AS (SELECT o_orderkey AS id, o_custkey AS customer, 'old' AS kind FROM orders WHERE o_orderkey % 3 != 0),
new AS (SELECT o_orderkey AS id, o_custkey AS customer, 'new' AS kind FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment != 'MACHINERY'))"""


def loaded(spark, d: str, conflict: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = lambda hit, kind: table(spark, d, "orders").where(hit).select(k.alias("id"), F.col("o_custkey").alias("customer"), F.lit(kind).alias("kind"))
    parents = table(spark, d, "customer").where("c_mktsegment != 'MACHINERY'")
    return loads.load(rows(k % 3 != 0, "old"), rows(k % 2 == 0, "new"), ["id"], conflict, [("customer", parents, "c_custkey")])


@query(f"WITH {_LOAD_SQL} SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)")
def load_keeping(spark, d: str) -> DataFrame:
    return loaded(spark, d, "nothing")


@query(f"WITH {_LOAD_SQL} SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)")
def load_replacing(spark, d: str) -> DataFrame:
    return loaded(spark, d, "error")


@query("""SELECT c_custkey AS id, c_mktsegment AS layer_id FROM customer WHERE c_mktsegment != 'BUILDING' UNION ALL SELECT s_suppkey, 'BUILDING' FROM supplier""")
def layer_reload(spark, d: str) -> DataFrame:
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("layer_id"))
    return loads.reload_layer(old, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("BUILDING").alias("layer_id")), "BUILDING")


@query("""SELECT c_custkey AS id FROM customer WHERE c_mktsegment != 'MACHINERY' OR (c_custkey % 2 = 0 AND c_custkey % 3 != 0)""")
def superseded_dropped(spark, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rel = table(spark, d, "customer").select(k.alias("id"), F.col("c_mktsegment").alias("layer_id"), F.when(k % 2 == 0, 1).alias("version_start"), F.when(k % 3 == 0, 2).alias("version_end"))
    return loads.drop_superseded(rel, "MACHINERY").select("id")


@query("SELECT 'INITIAL_CHANGESET' AS changeset_id, '0.0' AS layer_version, CAST(1700000000 AS BIGINT) AS opened, 0 AS global_version_id")
def version_zero(spark, d: str) -> DataFrame:
    changesets, published = loads.first_version(spark, 1700000000)
    return changesets.join(published, "changeset_id").select("changeset_id", "layer_version", "opened", "global_version_id")


@query("""SELECT o_orderpriority AS layer_id, max_by(o_custkey, o_orderkey) AS changeset_id, max(o_orderkey) AS global_version_id FROM orders WHERE o_orderkey % 4 != 0 GROUP BY 1""")
def newest_changesets(spark, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    published = o.select(F.struct("o_custkey", "o_orderkey").alias("changeset_id"), F.col("o_orderkey").alias("global_version_id"))
    sets = o.where("o_orderkey % 4 != 0").select(F.struct("o_custkey", "o_orderkey").alias("changeset_id"), F.col("o_orderpriority").alias("layer_id"))
    return loads.newest_changesets(published, sets).select("layer_id", F.col("changeset_id.o_custkey").alias("changeset_id"), "global_version_id")


_COPY_SQL = f"""{GRAPH_SQL}, copied AS (SELECT feature_id, feature_type FROM feat WHERE feature_type = 'POINT'
 OR (feature_id LIKE 'OSM&&WAY%' AND feature_id NOT IN (SELECT concat('OSM&&WAY&&', l_partkey) FROM lineitem WHERE l_linenumber = 1)))"""


def copies(spark, d: str) -> tuple[DataFrame, DataFrame]:
    split = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.concat(F.lit("OSM&&WAY&&"), F.col("l_partkey").cast("string")).alias("feature_id"))
    return loads.derived_copy(*stored_graph(spark, d), split, 7, "set-7")


@query(f"WITH {_COPY_SQL} SELECT feature_id, feature_type, 'DTP_OSM' AS layer_id, 7 AS version_start, 'set-7' AS changeset_id FROM copied")
def derived_features(spark, d: str) -> DataFrame:
    return copies(spark, d)[0].select("feature_id", "feature_type", "layer_id", "version_start", "changeset_id")


@query(f"WITH {_COPY_SQL} SELECT feature_id, s_name, s_value, 7 AS version_start FROM attr WHERE feature_id IN (SELECT feature_id FROM copied)")
def derived_attributes(spark, d: str) -> DataFrame:
    return copies(spark, d)[1].select("feature_id", "s_name", "s_value", "version_start")


@query("SELECT l_partkey AS value, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def repeated_values(spark, d: str) -> DataFrame:
    return loads.repeated_values(table(spark, d, "lineitem"), "l_partkey")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 != 0 AND c_custkey % 5 != 0")
def matched_inputs(spark, d: str) -> DataFrame:
    k = F.col("c_custkey")
    matched = F.when(k % 3 == 0, F.array(F.lit(""))).when(k % 5 != 0, F.array(k.cast("string"), F.lit("")))
    return table(spark, d, "customer").select(k.alias("id"), matched.alias("matched")).where(loads.is_matched(F.col("matched"))).select("id")


_EDITED_SQL = """old AS (SELECT o_orderkey AS id, o_orderkey % 3 AS changeset_id, o_orderstatus AS s_value, CASE WHEN o_orderkey % 3 != 2 THEN 1 END AS version_start FROM orders WHERE o_orderkey % 5 != 0),
edit AS (SELECT o_orderkey AS id, concat(o_orderstatus, '+') AS s_value FROM orders WHERE o_orderkey % 7 != 0)"""


@query(f"""WITH {_EDITED_SQL} SELECT old.id, changeset_id, CASE WHEN changeset_id = 2 AND edit.id IS NOT NULL THEN edit.s_value ELSE old.s_value END AS s_value, version_start FROM old LEFT JOIN edit ON edit.id = old.id
UNION ALL SELECT id, 2, s_value, NULL FROM edit WHERE id NOT IN (SELECT id FROM old WHERE changeset_id = 2)""")
def edits_applied(spark, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    old = o.where(k % 5 != 0).select(
        k.alias("feature_id"), F.lit("status").alias("s_name"), F.col("o_orderstatus").alias("s_value"), (k % 3).cast("long").alias("changeset_id"), F.when(k % 3 != 2, 1).alias("version_start"), F.lit(None).cast("int").alias("version_end")
    )
    edits = o.where(k % 7 != 0).select(k.alias("feature_id"), F.lit("status").alias("s_name"), F.concat("o_orderstatus", F.lit("+")).alias("s_value"))
    options = spark.createDataFrame([], "s_name string, options array<string>")
    decided = versions.edit_attributes(old, edits, options, 2)
    return versions.apply_edits(old, decided, ["feature_id", "s_name"], ["s_value"], 2).select(F.col("feature_id").alias("id"), "changeset_id", "s_value", "version_start")


@query("""WITH old AS (SELECT o_orderkey AS input_id, o_orderkey % 3 AS changeset_id, concat('w', o_custkey) AS matched FROM orders WHERE o_orderkey % 5 != 0), edit AS (SELECT o_orderkey AS input_id, 'w0' AS matched FROM orders WHERE o_orderkey % 7 = 0)
SELECT input_id, changeset_id, CASE WHEN changeset_id = 2 AND input_id IN (SELECT input_id FROM edit) THEN 'w0' ELSE matched END AS matched FROM old
UNION ALL SELECT input_id, 2, matched FROM edit WHERE input_id NOT IN (SELECT input_id FROM old WHERE changeset_id = 2)""")
def relationship_edits_applied(spark, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    old = o.where(k % 5 != 0).select(k.alias("input_id"), (k % 3).cast("long").alias("changeset_id"), F.array(F.concat(F.lit("w"), F.col("o_custkey").cast("string"))).alias("matched"))
    edits = o.where(k % 7 == 0).select(k.alias("input_id"), F.array(F.lit("w0")).alias("matched"))
    done = versions.apply_edits(old, relationships.edit_relationships(old, edits, 2), ["input_id"], ["matched"], 2)
    return done.select("input_id", "changeset_id", F.array_join("matched", ",").alias("matched"))


# searches around nodes


@query(f"""WITH RECURSIVE {EDGES}, s AS (SELECT src, dst, min(way_id % 7 + 1) AS u FROM (SELECT src, dst, way_id FROM e UNION ALL SELECT dst, src, way_id FROM e) WHERE src != dst GROUP BY 1, 2),
r AS (SELECT DISTINCT src AS start, src AS node, CAST(0 AS BIGINT) AS u FROM s UNION SELECT r.start, s.dst, r.u + s.u FROM r JOIN s ON s.src = r.node WHERE r.u + s.u <= 4),
t AS (SELECT node FROM (SELECT src AS node, dst AS other FROM s) GROUP BY 1 HAVING count(DISTINCT other) >= 3)
SELECT start, node, CAST(min(u) AS BIGINT) AS units FROM r WHERE start != node AND node IN (SELECT node FROM t) GROUP BY 1, 2""")
def nearby_intersections(spark, d: str) -> DataFrame:
    e = edges(spark, d)
    long = e.withColumn("km", (F.col("way_id") % 7 + 1) / 1024)
    starts = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    found = search.nearby(long, starts, graph.intersection_nodes(e), 4 / 1024)
    return found.select("start", "node", F.round(F.col("km") * 1024).cast("long").alias("units"))


@query(f"""WITH {EDGES}, n AS (SELECT src AS node, dst AS after, NULL AS before FROM e UNION ALL SELECT dst, NULL, src FROM e)
SELECT node, coalesce(array_to_string(list_sort(list_distinct(list(before))), ','), '') AS incoming, coalesce(array_to_string(list_sort(list_distinct(list(after))), ','), '') AS outgoing FROM n GROUP BY 1""")
def neighbour_sets(spark, d: str) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), ",").alias(c)
    return search.neighbour_sets(edges(spark, d)).select("node", text("incoming"), text("outgoing"))


@query("""WITH p AS (SELECT s_suppkey AS way_id, unnest([s_suppkey // 2, s_suppkey // 3, s_suppkey // 2 + 1 + s_suppkey % 3]) AS node FROM supplier)
SELECT CAST(min(node // 20) AS BIGINT) AS group_id, way_id FROM p GROUP BY way_id HAVING min(node // 20) = max(node // 20)""")
def internal_ways(spark, d: str) -> DataFrame:
    e = edges(spark, d)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst"))
    return search.internal_ways(ways(spark, d), nodes.select(F.expr("node div 20").alias("group_id"), "node"))


@query(f"""WITH RECURSIVE {EDGES}, c AS (SELECT node FROM (SELECT src AS node, dst AS other FROM e UNION ALL SELECT dst, src FROM e) WHERE node != other GROUP BY 1 HAVING count(DISTINCT other) >= 3),
p AS (SELECT DISTINCT s_suppkey AS way_id, unnest([s_suppkey // 2, s_suppkey // 3, s_suppkey // 2 + 1 + s_suppkey % 3]) AS node FROM supplier WHERE s_suppkey % 9 = 0),
o AS (SELECT * FROM p WHERE node IN (SELECT node FROM c)), l AS (SELECT a.node AS a, b.node AS b FROM o a JOIN o b USING (way_id) WHERE a.node != b.node),
r AS (SELECT DISTINCT a AS node, a AS other FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.other)
SELECT node, min(other) AS cluster FROM r GROUP BY 1""")
def roundabout_groups(spark, d: str) -> DataFrame:
    tagged = ways(spark, d).withColumn("tags", F.when(F.col("id") % 9 == 0, F.create_map(F.lit("junction"), F.lit("roundabout"))))
    return search.roundabout_groups(tagged, graph.intersection_nodes(edges(spark, d)))


@query(f"""WITH {EDGES}, a AS (SELECT DISTINCT dst AS node, src AS arm, CAST((src * 37 + dst * 11) % 360 - 180 AS DOUBLE) AS heading FROM e WHERE src != dst),
q AS (SELECT s_suppkey AS request, s_suppkey // 2 AS node, CAST(s_suppkey * 7 % 360 - 180 AS DOUBLE) AS angle FROM supplier),
j AS (SELECT request, node, arm, (heading - angle + 720) % 360 AS t FROM q JOIN a USING (node))
SELECT request, node, arg_min(arm, (least(t, 360 - t), arm)) AS arm FROM j GROUP BY 1, 2""")
def nearest_arm(spark, d: str) -> DataFrame:
    src, dst, k = F.col("src"), F.col("dst"), F.col("s_suppkey")
    arms = edges(spark, d).where("src != dst").select(dst.alias("node"), src.alias("arm"), ((src * 37 + dst * 11) % 360 - 180).cast("double").alias("heading")).distinct()
    wanted = table(spark, d, "supplier").select(k.alias("request"), F.expr("s_suppkey div 2").alias("node"), (k * 7 % 360 - 180).cast("double").alias("angle"))
    return search.nearest_arm(wanted, arms)


@query("""WITH i AS (SELECT o_orderkey AS uid, CASE WHEN o_orderkey % 6 = 0 THEN 'UNNAMED' ELSE o_orderpriority END AS a, CASE WHEN o_orderkey % 6 = 0 THEN 'UNNAMED' ELSE o_orderstatus END AS b FROM orders),
r AS (SELECT uid, a AS road FROM i UNION SELECT uid, b FROM i) SELECT road, count(*) AS n, min(uid) AS first_uid, max(uid) AS last_uid FROM r GROUP BY 1""")
def road_intersections(spark, d: str) -> DataFrame:
    roads = F.when(F.col("o_orderkey") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderpriority", "o_orderstatus"))
    found = search.road_intersections(table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), roads.alias("roads")))
    return found.select("road", F.size("uids").cast("long").alias("n"), F.element_at("uids", 1).alias("first_uid"), F.element_at("uids", -1).alias("last_uid"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN concat_ws(',', p_partkey + 2, p_partkey + 1, p_partkey, p_partkey + 8, p_partkey + 9)
 WHEN 1 THEN concat_ws(',', p_partkey + 2, p_partkey + 1, p_partkey, p_partkey + 8, p_partkey + 9) WHEN 2 THEN concat_ws(',', p_partkey, p_partkey + 1, p_partkey + 2, p_partkey + 8, p_partkey + 9)
 WHEN 3 THEN concat_ws(',', p_partkey, p_partkey + 1, p_partkey + 2, p_partkey + 8, p_partkey + 9) END AS chain FROM part""")
def chains_joined(spark, d: str) -> DataFrame:
    k = F.col("p_partkey")
    a = F.array(k, k + 1, k + 2)
    b = F.when(k % 5 == 0, F.array(k, k + 8, k + 9)).when(k % 5 == 1, F.array(k + 9, k + 8, k)).when(k % 5 == 2, F.array(k + 2, k + 8, k + 9)).when(k % 5 == 3, F.array(k + 9, k + 8, k + 2)).otherwise(F.array(k + 7, k + 1, k + 8))
    joined = search.join_chains(a, b)
    return table(spark, d, "part").select(k.alias("id"), F.array_join(F.transform(joined, lambda n: n.cast("string")), ",").alias("chain"))


def _along_sql(gap: str, count: str, point: str) -> str:
    return f"""WITH {ORDER_STEPS}, k AS (SELECT *, {_hav('x', 'y', 'x2', 'y2')} AS km FROM steps WHERE x2 IS NOT NULL), c AS (SELECT *, sum(km) OVER (PARTITION BY id ORDER BY i) - km AS at FROM k),
g AS (SELECT id, {gap} AS gap, {count} AS n FROM (SELECT id, sum(km) AS total FROM k GROUP BY 1) WHERE total > 0), t AS (SELECT *, ({point} - 1) * gap AS d FROM g),
h AS (SELECT t.id, t.n, t.d, arg_max(c, c.i) AS s FROM t JOIN c ON c.id = t.id AND c.at <= t.d + 1e-9 AND c.km > 0 GROUP BY ALL)
SELECT id, n, CAST(round((s.x + (s.x2 - s.x) * least(1.0, (d - s.at) / s.km)) * 10000) AS BIGINT) AS x_e4, CAST(round((s.y + (s.y2 - s.y) * least(1.0, (d - s.at) / s.km)) * 10000) AS BIGINT) AS y_e4 FROM h"""


def _placed(lines: DataFrame, i) -> DataFrame:
    point = F.element_at("points", i)
    return lines.select("id", F.size("points").cast("long").alias("n"), e4(point["x"]).alias("x_e4"), e4(point["y"]).alias("y_e4"))


@query(_along_sql("100.0", "CAST(floor(total / 100.0) AS BIGINT) + 2", "(n // 2)"))
def along_interval(spark, d: str) -> DataFrame:
    """Points every 100 km along each order's line: how many, and the middle one."""
    lines = order_lines(spark, d).select("id", "line", search.along(F.col("line"), 100.0).alias("points")).where("size(points) > 1").where("line[0] != line[1] or size(line) > 2")
    return _placed(lines, F.floor(F.size("points") / 2).cast("int"))


@query(_along_sql("total / 10", "CAST(11 AS BIGINT)", "5"))
def along_parts(spark, d: str) -> DataFrame:
    """Ten equal parts of each order's line: the fifth point."""
    return _placed(order_lines(spark, d).select("id", search.along(F.col("line"), parts=10).alias("points")).where("size(points) > 1"), 5)
