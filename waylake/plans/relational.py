"""Attribute and relational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from waylake.operators import eav, eligibility, spatial
from waylake.plans.tables import PART_SQL, part_attributes, part_features, table

QUERIES = {}
ORACLES = {}


def query(sql: str):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# attributes


@query("""
SELECT p_partkey AS id, 'p_brand' AS s_name, p_brand AS s_value FROM part
UNION ALL SELECT p_partkey, 'p_type', p_type FROM part UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part""")
def eav_unpivot(spark, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumnRenamed("p_partkey", "id")
    return eav.unpivot(p, ["id"], ["p_brand", "p_type", "p_size"], drop_nulls=True)


@query(f"""WITH {PART_SQL} SELECT id, string_agg(concat(s_name, '=', s_value), ';' ORDER BY s_name) AS tags FROM attrs GROUP BY id""")
def eav_pivot_map(spark, d: str) -> DataFrame:
    return eav.tag_map(part_attributes(spark, d), "id").select("id", eav.as_text(F.col("tags")).alias("tags"))


@query(f"""WITH {PART_SQL}
SELECT id, coalesce(string_agg(concat(s_name, '=', s_value), ';' ORDER BY s_name) FILTER (s_name IN ('class_code')), '') AS own,
       coalesce(string_agg(concat(s_name, '=', s_value), ';' ORDER BY s_name) FILTER (s_name NOT IN ('class_code')), '') AS other
FROM attrs GROUP BY id""")
def tags_filtered_split(spark, d: str) -> DataFrame:
    name = F.col("s_name")
    pairs = F.struct("s_name", "s_value")
    both = part_attributes(spark, d).groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.when(name == "class_code", pairs))).alias("own"),
        F.map_from_entries(F.collect_list(F.when(name != "class_code", pairs))).alias("other"),
    )
    return both.select("id", eav.as_text(F.col("own")).alias("own"), eav.as_text(F.col("other")).alias("other"))


@query("""SELECT e.event_id AS id, k.k AS s_name, json_extract_string(e.props, concat('$.', k.k)) AS s_value
FROM events e, LATERAL (SELECT unnest(json_keys(e.props)) AS k) k""")
def json_props_explode(spark, d: str) -> DataFrame:
    return eav.json_tags(table(spark, d, "events").select(F.col("event_id").alias("id"), "props"), ["id"], "props")


@query(f"""WITH {PART_SQL} SELECT f.id, f.name FROM features f WHERE EXISTS (SELECT 1 FROM attrs a WHERE a.id = f.id AND a.s_value = 'road')""")
def semi_exists_road(spark, d: str) -> DataFrame:
    roads = part_attributes(spark, d).where("s_value = 'road'").select("id")
    return part_features(spark, d).join(roads, "id", "left_semi").select("id", "name")


@query(f"""WITH {PART_SQL} SELECT f.id, f.name FROM features f WHERE NOT EXISTS (SELECT 1 FROM attrs a WHERE a.id = f.id AND a.s_value = 'track')""")
def anti_not_exists(spark, d: str) -> DataFrame:
    tracks = part_attributes(spark, d).where("s_value = 'track'").select("id")
    return part_features(spark, d).join(tracks, "id", "left_anti").select("id", "name")


def _has(values: str, name: str = "feature_type_code") -> str:
    return f"EXISTS (SELECT 1 FROM attrs a WHERE a.id = f.id AND a.s_name = '{name}' AND a.s_value IN ({values}))"


_TRACK = "EXISTS (SELECT 1 FROM attrs a WHERE a.id = f.id AND a.s_value = 'track')"
_ROAD_TRACK = _has("'track'", "road_type")
_CLS = "(SELECT CAST(max(s_value) AS INTEGER) FROM attrs c WHERE c.id = f.id AND c.s_name = 'class_code')"


@query(f"""WITH {PART_SQL}, g AS (SELECT f.*, {_CLS} AS cls FROM features f)
SELECT id FROM g f WHERE (cls BETWEEN 0 AND 4 AND NOT {_has("'connector','ford'")})
 OR (cls = 5 AND NOT {_has("'connector','ford'")} AND NOT {_TRACK})
 OR (cls = 6 AND NOT {_has("'connector','ford','tunnel'")} AND NOT {_TRACK})
 OR (cls = 7 AND NOT {_has("'connector','ford','bridge'")} AND NOT {_TRACK} AND name != 'UNNAMED')
 OR (cls = 13 AND {_has("'road'")})""")
def eligibility_road(spark, d: str) -> DataFrame:
    return eligibility.feature_flags(part_features(spark, d), part_attributes(spark, d)).where(eligibility.road()).select("id")


@query(f"""WITH {PART_SQL}, g AS (SELECT f.*, {_CLS} AS cls FROM features f)
SELECT id FROM g f WHERE (cls = 9 AND {_has("'trail','tunnel'")}) OR (cls = 8 AND {_has("'bridge','road'")}) OR (cls = 7 AND {_has("'bridge'")})
 OR (cls IN (6, 7) AND {_has("'road'")} AND {_ROAD_TRACK}) OR (cls IN (5, 6) AND {_has("'bridge'")} AND {_ROAD_TRACK}) OR (cls = 6 AND {_has("'tunnel'")})""")
def eligibility_trail(spark, d: str) -> DataFrame:
    return eligibility.feature_flags(part_features(spark, d), part_attributes(spark, d)).where(eligibility.trail()).select("id")


# joins


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_not_in(spark, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("o_totalprice > 400000 and o_custkey is not null").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_anti")


@query("SELECT o.o_orderkey FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL")
def left_anti_unsplit(spark, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_in(spark, d: str) -> DataFrame:
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "lang").join(good, "doc_id", "left_semi")


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_inner(spark, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", "n_name", "r_name")


@query(f"""WITH {PART_SQL}
SELECT f.id, f.name, a.s_value AS class_code, b.s_value AS road_type FROM features f
LEFT JOIN attrs a ON a.id = f.id AND a.s_name = 'class_code' LEFT JOIN attrs b ON b.id = f.id AND b.s_name = 'road_type'""")
def join_left2_attr(spark, d: str) -> DataFrame:
    picked = eav.pick(part_attributes(spark, d), "id", ["class_code", "road_type"])
    return part_features(spark, d).join(picked, "id", "left").select("id", "name", "class_code", "road_type")


@query("""
WITH a AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey % 2 = 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'right' ELSE 'left' END AS side FROM a FULL OUTER JOIN b ON a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL""")
def join_full_outer(spark, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("a_id")).where("a_id % 3 = 0")
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("b_id")).where("b_id % 2 = 0").distinct()
    one_sided = a.join(b, F.col("a_id") == F.col("b_id"), "full_outer").where("a_id is null or b_id is null")
    return one_sided.select(F.coalesce("a_id", "b_id").alias("id"), F.when(F.col("a_id").isNull(), "right").otherwise("left").alias("side"))


@query("""SELECT n.n_name, count(s.s_suppkey) AS n_suppliers FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name""")
def join_right(spark, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "right").groupBy("n_name").agg(F.count("s_suppkey").alias("n_suppliers"))


@query("""SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) - (SELECT CAST(max(round(p_retailprice * 100)) AS BIGINT) FROM part) AS below FROM part""")
def join_cross_scalar(spark, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    top = p.agg(F.max("cents").alias("top"))
    return p.crossJoin(F.broadcast(top)).select("p_partkey", (F.col("cents") - F.col("top")).alias("below"))  # top is one row


@query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""")
def join_self_value(spark, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    a = s.select(F.col("s_suppkey").alias("a"), "s_nationkey")
    b = s.select(F.col("s_suppkey").alias("b"), "s_nationkey")
    return a.join(b, "s_nationkey").where("a < b").select("a", "b")


_MATCHED = "(SELECT l_orderkey AS id, list_sort(list(DISTINCT l_partkey)) AS matched FROM lineitem GROUP BY 1)"


def order_matches(spark, d: str) -> DataFrame:
    """Orders as relationships: the parts of an order are the ways that it matched."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("matched"))


@query(f"SELECT id, unnest(matched) AS way FROM {_MATCHED}")
def join_lateral_unnest(spark, d: str) -> DataFrame:
    return order_matches(spark, d).select("id", F.explode("matched").alias("way"))


@query(f"""SELECT m.id, string_agg(DISTINCT p.p_brand, ',' ORDER BY p.p_brand) AS brands FROM (SELECT id, unnest(matched) AS way FROM {_MATCHED}) m
JOIN part p ON p.p_partkey = m.way GROUP BY m.id""")
def join_array_remap(spark, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("way"), "p_brand")
    remapped = order_matches(spark, d).select("id", F.explode("matched").alias("way")).join(p, "way")
    return remapped.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))


# aggregates


@query("""SELECT l_partkey AS way, count(DISTINCT l_suppkey) AS n_inputs, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS inputs
FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2""")
def multi_match_ways(spark, d: str) -> DataFrame:
    inputs = F.array_sort(F.collect_set(F.col("l_suppkey").cast("string")))
    g = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("way")).agg(inputs.alias("inputs"))
    return g.where(F.size("inputs") >= 2).select("way", F.size("inputs").cast("long").alias("n_inputs"), F.array_join("inputs", ",").alias("inputs"))


@query("SELECT count(*) AS n, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def count_distinct(spark, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query(f"""WITH {PART_SQL}, rel AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey % 4 != 0), g AS (SELECT f.*, {_CLS} AS cls FROM features f),
kept AS (SELECT * FROM g f WHERE NOT coalesce((cls BETWEEN 0 AND 7 AND {_has("'connector','ford'")})
  OR (cls = 8 AND {_has("'road','connector','ford','bridge','tunnel','trail'")} AND NOT {_has("'bridge','road'")})
  OR (cls = 9 AND {_has("'road','connector','ford','bridge','tunnel','trail'")} AND NOT {_has("'trail','tunnel'")})
  OR (cls = 13 AND {_has("'road','connector','ford','bridge','tunnel','trail'")} AND NOT {_has("'road'")}), false))
SELECT layer_id, count(*) AS total, count(r.id) AS matched, count(*) - count(r.id) AS failed, round(count(r.id) / count(*), 6) AS rate
FROM kept k LEFT JOIN rel r ON r.id = k.id GROUP BY layer_id""")
def match_report(spark, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.when(F.col("l_partkey") % 4 == 0, "").otherwise(F.col("l_suppkey").cast("string")).alias("way"))
    relationships = lines.groupBy("id").agg(F.collect_set("way").alias("matched"))
    flags = eligibility.feature_flags(part_features(spark, d), part_attributes(spark, d))
    return eligibility.match_report(flags, relationships)


# keeping one row


@query("""SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1""")
def distinct_on(spark, d: str) -> DataFrame:
    best = F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey")))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(best.alias("c_custkey"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def group_dedupe(spark, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_brand", "p_type").dropDuplicates()


@query("""SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY md5(html) ORDER BY url DESC NULLS FIRST, page_id) AS r FROM pages) WHERE r = 1""")
def seed_dedupe_window(spark, d: str) -> DataFrame:
    first = W.partitionBy("h").orderBy(F.col("url").desc_nulls_first(), "page_id")
    pages = table(spark, d, "pages").select("page_id", "url", F.md5("html").alias("h"))
    return pages.withColumn("r", F.row_number().over(first)).where("r = 1").select("page_id", "url")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS id FROM part")
def surrogate_row_number(spark, d: str) -> DataFrame:
    return eav.surrogate_ids(table(spark, d, "part").select("p_name", "p_partkey"), ["p_name", "p_partkey"]).select("p_partkey", F.col("id").cast("long").alias("id"))


@query("""SELECT c_custkey, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey) AS id FROM customer""")
def next_ids(spark, d: str) -> DataFrame:
    top = table(spark, d, "orders").agg(F.max("o_orderkey").alias("top")).first()["top"] or 0  # one number
    new = table(spark, d, "customer").select("c_custkey")
    return eav.surrogate_ids(new, ["c_custkey"], after=top).select("c_custkey", F.col("id").cast("long").alias("id"))


# sequences


_W_EVENTS = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS total FROM events {_W_EVENTS}")
def running_length(spark, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.sum(F.round(F.col("value") * 100).cast("long")).over(w).alias("total"))


@query(f"SELECT event_id, coalesce(CAST(round(value * 100) AS BIGINT) - lag(CAST(round(value * 100) AS BIGINT)) OVER w, 0) AS step, coalesce(lead(event_id) OVER w, -1) AS after FROM events {_W_EVENTS}")
def pairwise_step(spark, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    cents = F.round(F.col("value") * 100).cast("long")
    return table(spark, d, "events").select("event_id", F.coalesce(cents - F.lag(cents).over(w), F.lit(0)).alias("step"), F.coalesce(F.lead("event_id").over(w), F.lit(-1)).alias("after"))


@query(f"SELECT event_id, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER w AS before FROM events {_W_EVENTS}) WHERE before IS NULL OR before != event_type")
def consecutive_dedupe(spark, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", "event_type", F.lag("event_type").over(w).alias("before"))
    return e.where("before is null or before != event_type").select("event_id", "event_type")


# top rows and versions


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS changeset FROM orders GROUP BY 1""")
def latest_changeset(spark, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("changeset"))


@query("""WITH v AS (SELECT o_orderpriority AS layer, o_orderkey % 12 AS major, o_custkey % 15 AS minor FROM orders)
SELECT layer, concat(m // 100, '.', m % 100) AS version FROM (SELECT layer, max(major * 100 + minor) AS m FROM v GROUP BY 1)""")
def semantic_version_max(spark, d: str) -> DataFrame:
    from waylake.operators.versions import newest_version

    text = F.concat_ws(".", (F.col("o_orderkey") % 12).cast("string"), (F.col("o_custkey") % 15).cast("string"))
    v = table(spark, d, "orders").select(F.col("o_orderpriority").alias("layer"), text.alias("version"))
    return newest_version(v, ["layer"])


@query("""SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, c_custkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(CAST(round(s_acctbal * 100) AS BIGINT) - CAST(round(c_acctbal * 100) AS BIGINT)), c_custkey) AS r
FROM supplier JOIN customer ON s_nationkey = c_nationkey) WHERE r <= 3""")
def topk_nearest(spark, d: str) -> DataFrame:
    row = lambda t, p, key, name: table(spark, d, t).select(F.col(key).alias(name), F.col(f"{p}_nationkey").alias("grp"), F.round(F.col(f"{p}_acctbal") * 100).cast("long").alias("v"))
    found = spatial.nearest_numbers(row("supplier", "s", "s_suppkey", "asked_id"), row("customer", "c", "c_custkey", "given_id"), 3)
    return found.select(F.col("asked_id").alias("s_suppkey"), F.col("given_id").alias("c_custkey"))


# sets

_SETS = """a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0),
n AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 = 0)"""


def _key_sets(spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")), c.where("k % 3 = 0"), c.where("k % 7 = 0")


@query(f"WITH {_SETS} SELECT k FROM (SELECT k FROM a EXCEPT SELECT k FROM b INTERSECT SELECT k FROM a EXCEPT SELECT k FROM n)")
def except_intersect_precedence(spark, d: str) -> DataFrame:
    a, b, n = _key_sets(spark, d)
    return a.subtract(b.intersect(a)).subtract(n)


@query(f"WITH {_SETS} SELECT k FROM a UNION SELECT k FROM b UNION SELECT k FROM n")
def union_distinct(spark, d: str) -> DataFrame:
    a, b, n = _key_sets(spark, d)
    return a.union(b).union(n).distinct()


@query("""SELECT c_custkey AS id, c_name AS name, NULL::VARCHAR AS brand FROM customer UNION ALL SELECT p_partkey, NULL, p_brand FROM part""")
def union_by_name(spark, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    return c.unionByName(p, allowMissingColumns=True)
