"""Tables with constraints, their description, scripts and refreshed views."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from waylake.functions.storage import fresh_path, materialise

PROPERTY = "waylake.columns"


@dataclass(frozen=True)
class ColumnSpec:
    """A column of a table; ``check`` is a predicate. Several key columns make one key."""

    name: str
    type: str
    not_null: bool = False
    unique: bool = False
    primary_key: bool = False
    check: str | None = None


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def create_table(spark: SparkSession, name: str, columns: Sequence[ColumnSpec]) -> None:
    """Create a table from a description unless it exists (B7); constraints are kept with it for ``describe`` and ``append``."""
    if len({c.name.lower() for c in columns}) < len(columns):
        raise ValueError(f"repeated column names in {name}")
    listed = ", ".join(f"`{c.name}` {c.type}" for c in columns)
    kept = json.dumps([asdict(c) for c in columns]).replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_quoted(name)} ({listed}) USING parquet LOCATION '{fresh_path(spark, 'table')}' TBLPROPERTIES ('{PROPERTY}' = '{kept}')")


def specs(spark: SparkSession, name: str) -> list[ColumnSpec]:
    """The description that a table was created from, or one without constraints."""
    found = spark.sql(f"SHOW TBLPROPERTIES {_quoted(name)}").where(F.col("key") == PROPERTY).collect()
    if found:
        return [ColumnSpec(**c) for c in json.loads(found[0]["value"])]
    return [ColumnSpec(c.name, c.dataType) for c in spark.catalog.listColumns(name)]


def describe(spark: SparkSession, name: str) -> DataFrame:
    """(column_name, type, not_null, is_unique, in_key, check_text), one row per column."""
    if not spark.catalog.tableExists(name):
        raise ValueError(f"no table {name}")
    rows = [(c.name, c.type, c.not_null or c.primary_key, c.unique, c.primary_key, c.check) for c in specs(spark, name)]
    return spark.createDataFrame(rows, "column_name string, type string, not_null boolean, is_unique boolean, in_key boolean, check_text string")


def violations(df: DataFrame, columns: Sequence[ColumnSpec]) -> DataFrame:
    """(rule, n): how many rows break each constraint, for those that are broken. As in SQL, a check that
    gives null holds, and nulls are never equal; of rows that share a unique value all but one break it."""
    keys = [c.name for c in columns if c.primary_key]
    rules = {f"not null {c.name}": F.col(c.name).isNull() for c in columns if c.not_null or c.primary_key}
    rules |= {f"check {c.name}": ~F.coalesce(F.expr(c.check), F.lit(True)) for c in columns if c.check}
    found = []
    if rules:  # one pass over the rows
        counted = df.agg(*[F.count_if(broken).alias(rule) for rule, broken in rules.items()])
        found.append(counted.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").alias("n")) for r in rules])).alias("v")).select("v.*"))
    distinct = [([c.name], f"unique {c.name}") for c in columns if c.unique]
    for names, rule in distinct + ([(keys, f"key {', '.join(keys)}")] if keys else []):
        repeated = df.dropna(subset=names).groupBy(*names).agg((F.count("*") - 1).alias("n")).where("n > 0")
        found.append(repeated.agg(F.sum("n").alias("n")).select(F.lit(rule).alias("rule"), "n"))
    if not found:
        return df.sparkSession.createDataFrame([], "rule string, n long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.where("n > 0")


def append(df: DataFrame, name: str) -> None:
    """Add rows to a table; an error, and no row, if the table then broke one of its constraints."""
    spark = df.sparkSession
    columns = specs(spark, name)
    fresh = materialise(df.select(*[F.col(c.name).cast(c.type) for c in columns]), "append")
    broken = violations(spark.table(name).unionByName(fresh), columns).collect()  # one row per constraint at most
    if broken:
        raise ValueError(f"{name}: " + "; ".join(f"{r['rule']} broken by {r['n']} rows" for r in broken))
    fresh.write.insertInto(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a table if it exists, its rows too."""
    if not spark.catalog.tableExists(name):
        return
    place = spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(name)}").where("col_name = 'Location'").first()["data_type"]
    spark.sql(f"DROP TABLE {_quoted(name)}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run_script(spark: SparkSession, script: str, parameters: Mapping[str, object] | None = None) -> DataFrame | None:
    """Run the statements of a script in their order; the last one's result (A16). Parameters are named, as in ``:name``.

    A semicolon in quotes or in a line comment ends no statement.
    """
    last = None
    for part in re.findall(r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|[^;])+""", script):
        if re.sub(r"--[^\n]*", "", part).strip():
            last = spark.sql(part, args=dict(parameters or {}))
    return last


def refresh_view(df: DataFrame, name: str) -> DataFrame:
    """Store a view's rows and make ``name`` stand for them; readers of the former rows keep these."""
    stored = materialise(df, "view")
    stored.createOrReplaceTempView(name)
    return stored
