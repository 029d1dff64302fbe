"""Written intermediates in the folder that all machines share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set (local mode)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        set_by_code = spark.sparkContext.getCheckpointDir()
        folder = set_by_code.rsplit("/", 1)[0] if set_by_code else None
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="waylake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/waylake/{tag}-{uuid.uuid4().hex}"


#: While this is on, Spark deletes the shuffle files of a query as soon as the query has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that run to their end in this block, such as writes, leave no shuffle files behind."""
    if not spark.conf.isModifiable(CLEAN_UP):  # not known to this Spark
        yield
        return
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors. Once the rows are written the
    shuffles behind them aren't needed any more, so they go at once rather than when the driver next collects garbage."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    with shuffles_cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
