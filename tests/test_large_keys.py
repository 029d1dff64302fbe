"""Queries whose results are made of the keys, on few rows with the keys of larger tables."""

import duckdb

from waylake.plans import catalogue


def same_as_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, str(folder))
    wanted = con.execute(catalogue.ORACLES[name]).df()[df.columns]
    found = sorted(map(tuple, df.collect()))
    assert found == sorted(wanted.itertuples(index=False, name=None))
    return found


def test_clock_times_in_far_years(spark, tmp_path):
    orders = "select (6651321 + i)::bigint as o_orderkey, timestamp '1998-12-10 00:00:00' as o_orderdate from range(12) t(i)"
    found = same_as_sql(spark, tmp_path, "clock_times", orders=orders)
    # from 2^59 microseconds on doubles are 128 apart
    assert {r[0]: r[1] for r in found}[6651325] == "20237-04-27 16:53:44"


def test_stars_with_a_nearly_horizontal_edge(spark, tmp_path):
    # by 355 / 113, turns by 51535 + 71 n radians come close to whole tenths
    supplier = "select unnest([51535, 51961, 52032, 52103, 52174, 156309, 260515])::bigint as s_suppkey"
    assert len(same_as_sql(spark, tmp_path, "polygon_repair", supplier=supplier)) == 7


def test_rows_made_of_cells_are_not_broadcast(spark, tmp_path):
    spark.range(400).selectExpr("id as s_suppkey", "int(id % 25) as s_nationkey", "id / 7D as s_acctbal").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(600).selectExpr("id as c_custkey", "int(id % 25) as c_nationkey", "id / 9D as c_acctbal").write.parquet(str(tmp_path / "customer.parquet"))
    plan = lambda name: catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan("topk_nearest")
    # cells that are crowded, at most one in 100,000 points, are
    assert plan("grid_spatial_join_north").count("BroadcastHashJoin") == 2 and "SortMergeJoin" in plan("grid_spatial_join_north")
