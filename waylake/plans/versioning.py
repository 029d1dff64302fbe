"""Changesets, versions and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from waylake.operators import eav, relationships, versions
from waylake.operators.versions import classify
from waylake.plans.delta import LATEST_SQL, incoming_orders, keyed, latest_orders
from waylake.plans.relational import order_matches
from waylake.plans.tables import ORDER_VERSIONS_SQL, PART_SQL, order_versions, part_attributes, table

QUERIES = {}
ORACLES = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_STATUS = "CASE WHEN old.k IS NULL THEN 'ADDED' WHEN new.k IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END"


@query(f"WITH {LATEST_SQL} SELECT id, {_STATUS} AS status, old.k AS old_key, new.k AS new_key FROM old FULL OUTER JOIN new USING (id) WHERE old.k IS DISTINCT FROM new.k")
def delta_rows(spark, d: str) -> DataFrame:
    return classify(keyed(latest_orders(spark, d)), keyed(incoming_orders(spark, d)), ["id"], "join_key")


#: Attributes that a source update never removes.
PROTECTED = ("declared",)


def attribute_changes(spark, d: str) -> DataFrame:
    def attributes(df: DataFrame) -> DataFrame:
        tall = eav.unpivot(df.withColumn("declared", F.lit("Y")), ["id"], ["status", "priority", "declared"])
        return tall.where(~F.col("s_name").isin(*PROTECTED)).withColumn("key", F.md5(F.concat("id", "s_name", "s_value")))

    new = incoming_orders(spark, d).withColumn("priority", F.when(F.col("id") % 9 == 0, "9-NEW").otherwise(F.col("priority")))
    return classify(attributes(latest_orders(spark, d)), attributes(new), ["id", "s_name"], "key")


_ATTR = f"""{LATEST_SQL},
olda AS (SELECT id, 'status' AS s_name, status AS v FROM latest UNION ALL SELECT id, 'priority', priority FROM latest),
newa AS (SELECT id, 'status' AS s_name, status AS v FROM incoming UNION ALL SELECT id, 'priority', CASE WHEN id % 9 = 0 THEN '9-NEW' ELSE priority END FROM incoming),
attr_delta AS (SELECT id, s_name, CASE WHEN olda.v IS NULL THEN 'ADDED' WHEN newa.v IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS status
  FROM olda FULL OUTER JOIN newa USING (id, s_name) WHERE olda.v IS DISTINCT FROM newa.v)"""


@query(f"WITH {_ATTR} SELECT * FROM attr_delta")
def delta_attribute_rows(spark, d: str) -> DataFrame:
    return attribute_changes(spark, d).select("id", "s_name", "status")


@query(f"""WITH {_ATTR}, f AS (SELECT id, {_STATUS} AS status FROM old FULL OUTER JOIN new USING (id) WHERE old.k IS DISTINCT FROM new.k)
SELECT coalesce(f.id, a.id) AS id, coalesce(f.status, 'MODIFIED') AS status FROM f FULL OUTER JOIN (SELECT DISTINCT id FROM attr_delta) a ON a.id = f.id""")
def feature_rollup(spark, d: str) -> DataFrame:
    return versions.roll_up(delta_rows(spark, d).select("id", "status"), attribute_changes(spark, d))


@query(f"WITH {LATEST_SQL} SELECT id, k AS join_key FROM old")
def change_key_md5(spark, d: str) -> DataFrame:
    return keyed(latest_orders(spark, d)).select("id", "join_key")


_MERGE = """t AS (SELECT c_custkey AS id, c_name AS name FROM customer), s AS (SELECT c_custkey * 2 AS id, concat('new ', c_name) AS name FROM customer)"""


def _merge_sides(spark, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), c.select(
        (F.col("c_custkey") * 2).alias("id"), F.concat(F.lit("new "), "c_name").alias("name")
    )


@query(f"WITH {_MERGE} SELECT coalesce(s.id, t.id) AS id, coalesce(s.name, t.name) AS name FROM t FULL OUTER JOIN s ON s.id = t.id")
def upsert_update(spark, d: str) -> DataFrame:
    return versions.upsert(*_merge_sides(spark, d), ["id"])


@query(f"WITH {_MERGE} SELECT coalesce(t.id, s.id) AS id, coalesce(t.name, s.name) AS name FROM t FULL OUTER JOIN s ON s.id = t.id")
def upsert_nothing(spark, d: str) -> DataFrame:
    return versions.upsert(*_merge_sides(spark, d), ["id"], update=False)


@query("SELECT c_custkey, coalesce(c_acctbal < 0, false) AS deleted FROM customer")
def delete_returning(spark, d: str) -> DataFrame:
    kept, gone = versions.delete_returning(table(spark, d, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal") < 0)
    mark = lambda df, x: df.select("c_custkey", F.lit(x).alias("deleted"))
    return mark(kept, False).unionByName(mark(gone, True))


@query("""WITH c AS (SELECT n_name AS layer_id, CASE WHEN n_nationkey % 4 != 0 THEN concat(n_nationkey % 12, '.', n_regionkey + 8) END AS v, n_nationkey % 2 = 0 AS src FROM nation)
SELECT layer_id, CASE WHEN v IS NULL THEN '1.0' WHEN src THEN concat(CAST(split_part(v, '.', 1) AS INTEGER) + 1, '.0')
 ELSE concat(split_part(v, '.', 1), '.', CAST(split_part(v, '.', 2) AS INTEGER) + 1) END AS version FROM c""")
def changeset_numbering(spark, d: str) -> DataFrame:
    n, key = table(spark, d, "nation"), F.col("n_nationkey")
    current = F.when(key % 4 != 0, versions.version_text(key % 12, F.col("n_regionkey") + 8))
    return n.select(F.col("n_name").alias("layer_id"), versions.next_version(current, key % 2 == 0).alias("version"))


_PUBLISHED = f"""{ORDER_VERSIONS_SQL},
changes AS (SELECT id, cents + 1 AS cents, CASE WHEN id % 3 = 0 THEN 'REMOVED' ELSE 'MODIFIED' END AS status FROM versions WHERE id % 4 = 1),
published AS (
  SELECT v.id, v.cents, v.status, v.version_start,
    CAST(CASE WHEN c.id IS NOT NULL AND v.version_start IS NOT NULL AND v.version_end IS NULL THEN 19 ELSE v.version_end END AS INTEGER) AS version_end
  FROM versions v LEFT JOIN changes c ON c.id = v.id
  UNION ALL SELECT id, cents, status, 20, CASE WHEN status = 'REMOVED' THEN 20 END FROM changes)"""


def published(spark, d: str) -> DataFrame:
    rows = order_versions(spark, d)
    changes = rows.where("id % 4 = 1").select("id", (F.col("cents") + 1).alias("cents"), F.when(F.col("id") % 3 == 0, "REMOVED").otherwise("MODIFIED").alias("status"))
    return versions.publish(rows, changes, 20)


@query(f"WITH {_PUBLISHED} SELECT id, cents, status, coalesce(version_start, -1) AS version_start, coalesce(version_end, -1) AS version_end FROM published")
def publish_versions(spark, d: str) -> DataFrame:
    shown = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("version_start", "version_end")]
    return published(spark, d).select("id", "cents", "status", *shown)


_AS_OF = "version_start <= {0} AND (version_end IS NULL OR version_end >= {0}) AND NOT (coalesce(version_start = version_end, false) AND status = 'REMOVED')"


@query(f"WITH {ORDER_VERSIONS_SQL} SELECT id, cents FROM versions WHERE {_AS_OF.format(8)}")
def as_of_version(spark, d: str) -> DataFrame:
    return versions.as_of(order_versions(spark, d), 8).select("id", "cents")


@query(f"WITH {_PUBLISHED} SELECT id, cents FROM published WHERE {_AS_OF.format(20)}")
def as_of_published(spark, d: str) -> DataFrame:
    return versions.as_of(published(spark, d), 20).select("id", "cents")


@query(f"WITH {_PUBLISHED} SELECT id, version_start FROM published WHERE version_start = version_end AND status = 'REMOVED'")
def tombstones(spark, d: str) -> DataFrame:
    return published(spark, d).where("version_start = version_end and status = 'REMOVED'").select("id", "version_start")


@query(f"""WITH {ORDER_VERSIONS_SQL} SELECT id, CAST(coalesce(CASE WHEN version_start != 9 AND version_end IS NULL THEN 8 ELSE version_end END, -1) AS INTEGER) AS version_end FROM versions""")
def bulk_invalidate(spark, d: str) -> DataFrame:
    return versions.invalidate(order_versions(spark, d), 9).select("id", F.coalesce("version_end", F.lit(-1)).alias("version_end"))


@query(f"""WITH {PART_SQL}, rel AS (SELECT DISTINCT l_suppkey AS input_id, l_partkey AS way FROM lineitem)
SELECT r.way AS feature_id, s.s_name, max(s.s_value) AS s_value FROM rel r
JOIN (SELECT s_suppkey AS input_id, 'owner' AS s_name, s_name AS s_value FROM supplier) s ON s.input_id = r.input_id GROUP BY 1, 2""")
def inherit_attributes(spark, d: str) -> DataFrame:
    rel = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("input_id")).agg(F.collect_set("l_partkey").alias("matched"))
    owners = table(spark, d, "supplier").select(F.col("s_suppkey").alias("feature_id"), F.lit("owner").alias("s_name"), F.col("s_name").alias("s_value"))
    return versions.inherit(rel, owners)


@query("""SELECT p_partkey AS id, p_partkey AS parent_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 26)""")
def copy_unsplit(spark, d: str) -> DataFrame:
    split = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count_distinct("l_suppkey").alias("n")).where("n >= 26")
    return versions.copy_unsplit(table(spark, d, "part").select(F.col("p_partkey").alias("id")), split).select("id", "parent_id")


_EDITS = f"""{PART_SQL}, cur AS (SELECT id AS feature_id, s_name, s_value, CAST(id % 5 AS INTEGER) AS changeset_id, id % 6 != 0 AS latest FROM attrs),
edits AS (SELECT p_partkey AS feature_id, CASE WHEN p_partkey % 2 = 0 THEN 'road_type' ELSE 'colour' END AS s_name,
  CASE WHEN p_partkey % 3 = 0 THEN 'track' WHEN p_partkey % 3 = 1 THEN 'sealed' ELSE 'gravel' END AS s_value FROM part)"""


@query(f"""WITH {_EDITS}, mine AS (SELECT DISTINCT feature_id, s_name FROM cur WHERE changeset_id = 3), now AS (SELECT * FROM cur WHERE latest)
SELECT e.feature_id, e.s_name, e.s_value, n.s_value AS old_value,
 CASE WHEN e.s_name = 'road_type' AND e.s_value NOT IN ('track', 'sealed') THEN 'INVALID' WHEN m.feature_id IS NOT NULL THEN 'UPDATE'
      WHEN n.feature_id IS NULL THEN 'NEW' WHEN n.s_value IS NOT DISTINCT FROM e.s_value THEN 'NONE' ELSE 'NEW_VERSION' END AS action
FROM edits e LEFT JOIN mine m USING (feature_id, s_name) LEFT JOIN now n USING (feature_id, s_name)""")
def edit_attribute_batch(spark, d: str) -> DataFrame:
    current = part_attributes(spark, d).select(
        F.col("id").alias("feature_id"), "s_name", "s_value", (F.col("id") % 5).cast("int").alias("changeset_id"),
        F.when(F.col("id") % 6 != 0, 1).alias("version_start"), F.lit(None).cast("int").alias("version_end"),
    )
    key = F.col("p_partkey")
    edits = table(spark, d, "part").select(
        key.alias("feature_id"),
        F.when(key % 2 == 0, "road_type").otherwise("colour").alias("s_name"),
        F.when(key % 3 == 0, "track").when(key % 3 == 1, "sealed").otherwise("gravel").alias("s_value"),
    )
    options = spark.createDataFrame([("road_type", ["track", "sealed"]), ("colour", None)], "s_name string, options array<string>")
    return versions.edit_attributes(current, edits, options, 3)


@query("""SELECT c_custkey AS id, CASE WHEN c_mktsegment != 'MACHINERY' THEN s WHEN s = 'PROCESSING' THEN 'PENDING' WHEN s = 'APPROVING' THEN 'APPROVED' ELSE s END AS status
FROM (SELECT *, ['PROCESSING', 'PENDING', 'APPROVING', 'DECLINED'][CAST(c_custkey % 4 + 1 AS INTEGER)] AS s FROM customer)""")
def status_transition(spark, d: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("PROCESSING", "PENDING", "APPROVING", "DECLINED"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    sets = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("layer_id"), status.alias("status"))
    return versions.set_status(sets, {"PROCESSING": "PENDING", "APPROVING": "APPROVED"}, "MACHINERY").select("id", "status")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN true WHEN c_custkey % 15 = 0 THEN false END AS rejected FROM customer""")
def reject_restore(spark, d: str) -> DataFrame:
    f = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("boolean").alias("rejected"))
    out = versions.reject(f, f.where("id % 5 = 0 and (id % 10 = 0 or id % 15 = 0)"), rejected=True)
    return versions.reject(out, f.where("id % 15 = 0 and id % 10 != 0"), rejected=False)


@query("""SELECT c_mktsegment AS layer_id, count(*) AS n FROM customer WHERE c_custkey % 4 < 3 AND c_mktsegment = 'MACHINERY' GROUP BY 1""")
def blocking_changesets(spark, d: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("PROCESSING", "PENDING", "APPROVING", "DECLINED"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    sets = table(spark, d, "customer").select(F.col("c_mktsegment").alias("layer_id"), status.alias("status"))
    return versions.blocked(sets, "MACHINERY").groupBy("layer_id").agg(F.count("*").alias("n"))


@query("""WITH rel AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_partkey)) AS matched FROM lineitem GROUP BY 1)
SELECT r.id, md5(concat(r.id, array_to_string(r.matched, ','))) AS join_key FROM rel r
 WHERE r.id % 5 != 3 AND NOT EXISTS (SELECT 1 FROM rel o WHERE o.id % 2 = 0 AND o.id = r.id)""")
def new_relationships(spark, d: str) -> DataFrame:
    rel = order_matches(spark, d).select("id", F.md5(F.concat("id", F.array_join("matched", ","))).alias("join_key"))
    edited = rel.where("id % 5 = 3").select(F.col("id").alias("input_id"))
    staged = rel.withColumnRenamed("id", "input_id")
    return relationships.changed_matches(rel.where("id % 2 = 0"), staged, edited).select(F.col("input_id").alias("id"), "join_key")


@query("""WITH o AS (SELECT o_orderkey AS id, year(o_orderdate) - 1990 AS v FROM orders)
SELECT v AS version, count(*) AS added, CAST(sum(count(*)) OVER (ORDER BY v) AS BIGINT) AS total FROM o GROUP BY v""")
def version_history(spark, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy((F.year("o_orderdate") - 1990).cast("long").alias("version")).agg(F.count("*").alias("added"))
    return o.withColumn("total", F.sum("added").over(W.orderBy("version").rowsBetween(W.unboundedPreceding, 0)))  # one row per version
