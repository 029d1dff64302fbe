"""Changes between the stored snapshot and an incoming one (V2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waylake.functions.exprs import cents, change_key
from waylake.operators.versions import classify


def latest_orders(spark, sf_dir: str) -> DataFrame:
    """Orders as features: id, status, price in cents, priority."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("status"),
        cents("o_totalprice").alias("cents"),
        F.col("o_orderpriority").alias("priority"),
    )


def incoming_orders(spark, sf_dir: str) -> DataFrame:
    """The next snapshot: every 10th id is gone, every 7th price is one cent up, every 13th id also comes anew."""
    base = latest_orders(spark, sf_dir)
    changed = base.where("id % 10 != 0").withColumn("cents", F.col("cents") + F.when(F.col("id") % 7 == 0, 1).otherwise(0))
    return changed.unionByName(base.where("id % 13 = 0").withColumn("id", F.col("id") + 10_000_000))


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("join_key", change_key(F.col("id"), F.col("status"), F.col("cents")))


def delta_status_counts(spark, sf_dir: str) -> DataFrame:
    changes = classify(keyed(latest_orders(spark, sf_dir)), keyed(incoming_orders(spark, sf_dir)), ["id"], "join_key", True)
    return changes.groupBy("status").agg(F.count("*").alias("n"))


LATEST_SQL = """
latest AS (SELECT o_orderkey AS id, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
                  o_orderpriority AS priority FROM orders),
base AS (SELECT id, status, cents + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS cents, priority FROM latest WHERE id % 10 != 0),
incoming AS (SELECT * FROM base UNION ALL SELECT id + 10000000, status, cents, priority FROM latest WHERE id % 13 = 0),
old AS (SELECT *, md5(concat(id, status, cents)) AS k FROM latest),
new AS (SELECT *, md5(concat(id, status, cents)) AS k FROM incoming)
"""

QUERIES = {"delta_status_counts": delta_status_counts}

ORACLES = {
    "delta_status_counts": f"""
WITH {LATEST_SQL}
SELECT CASE WHEN old.k IS NULL THEN 'ADDED' WHEN new.k IS NULL THEN 'REMOVED'
            WHEN old.k != new.k THEN 'MODIFIED' ELSE 'SAME' END AS status, count(*) AS n
FROM old FULL OUTER JOIN new USING (id) GROUP BY 1""",
}
