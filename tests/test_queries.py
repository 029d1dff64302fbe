"""Every query of the catalogue with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import duckdb
import pytest

from waylake.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "NULL"
    return repr(float(v)) if isinstance(v, float) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(name, spark, sf, duck):
    df = catalogue.QUERIES[name](spark, sf)
    result = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_gives_rows(name, spark, sf):
    assert catalogue.QUERIES[name](spark, sf).count() > 0
