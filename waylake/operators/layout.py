"""Features in Hilbert order on disk, so that a box query reads few row groups.

Rows are dealt to files by ranges of the Hilbert number of their centre and sorted by it, so every Parquet row group
holds features near each other, and the minimum and maximum of x1, y1, x2, y2 that Parquet keeps per row group are those
of a small box. A box query is four plain comparisons, which the scan checks against these bounds before it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bits of each coordinate in the Hilbert number.
BITS = 20


def hilbert(x: Column, y: Column, box: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0)) -> Column:
    """The place of a point along the Hilbert curve through a box; points outside count as on its edge."""
    top = (1 << BITS) - 1
    at = lambda v, low, high: F.least(F.greatest(F.floor((v - low) / (high - low) * (top + 1)), F.lit(0)), F.lit(top)).cast("long")
    start = F.struct(at(x, box[0], box[2]).alias("x"), at(y, box[1], box[3]).alias("y"), F.lit(0).cast("long").alias("d"))

    def step(acc: Column, bit: Column) -> Column:
        s = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        rx, ry = (F.when(acc[c].bitwiseAND(s) > 0, 1).otherwise(0).cast("long") for c in "xy")
        d = acc["d"] + s * s * (rx * 3).bitwiseXOR(ry)
        # a quadrant below is turned, those on the right of it mirrored as well
        flip = (ry == 0) & (rx == 1)
        fx, fy = (F.when(flip, top - acc[c]).otherwise(acc[c]) for c in "xy")
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    return F.aggregate(F.sequence(F.lit(BITS - 1), F.lit(0), F.lit(-1)), start, step, lambda a: a["d"])


def write_packed(features: DataFrame, path: str, files: int | None = None, row_group_bytes: int = 8 << 20, **options) -> None:
    """Write features (x1, y1, x2, y2 and any other columns) in Hilbert order of their centres."""
    order = features.withColumn("_h", hilbert((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, **options))
    dealt = order.repartitionByRange(files, "_h") if files else order.repartitionByRange("_h")
    dealt.sortWithinPartitions("_h").drop("_h").write.option("parquet.block.size", row_group_bytes).mode("errorifexists").parquet(path)


def read_box(spark: SparkSession, path: str, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """The features whose box shares a point with a box."""
    f = spark.read.parquet(path)
    return f.where((F.col("x1") <= x2) & (F.col("x2") >= x1) & (F.col("y1") <= y2) & (F.col("y2") >= y1))
