"""Competing matches on a way: candidates, their figures and the ladder that picks one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# fixed values of the ladder: kilometres, degrees, square metres per metre
MIN_KM, ANGLE, ERROR = 0.0025, 8.0, 10.0
LOOSE_ANGLE, LOOSE_ERROR = 50.0, 25.0


def candidates(matches: DataFrame, by: str = "name") -> DataFrame:
    """(way, by, L, A, E): length, median angle and median error of each candidate of a way."""
    return matches.groupBy("way", by).agg(F.sum("km").alias("L"), F.median("angle").alias("A"), F.median("error").alias("E"))


def contested(matches: DataFrame, by: str = "name") -> DataFrame:
    """Matches of ways that more than one candidate claims."""
    several = matches.groupBy("way").agg(F.count_distinct(by).alias("n")).where("n > 1").select("way")
    return matches.join(several, "way", "left_semi")


def resolve(cands: DataFrame, by: str = "name", derived: bool = False) -> DataFrame:
    """(way, by) of the candidates that stay; a way whose candidates all fail has none.

    The bests are those of all candidates. Each step of the ladder applies to a way only if no step
    before it has decided, so a window counts the survivors of every step per way.
    """
    w = W.partitionBy("way")
    best = cands.withColumn("maxL", F.max("L").over(w)).withColumn("minA", F.min("A").over(w)).withColumn("minE", F.min("E").over(w))
    c = F.col
    long_enough = c("L") > MIN_KM
    good_angle = (c("A") < ANGLE) | (c("A") <= 1.2 * c("minA"))
    good_error = (c("E") < ERROR) | (c("E") <= 1.5 * c("minE"))
    longest, straightest, closest = c("L") == c("maxL"), c("A") == c("minA"), c("E") == c("minE")
    loose = (c("A") < LOOSE_ANGLE) & (c("E") < LOOSE_ERROR)

    def sole(rule: Column) -> tuple[Column, str]:
        return rule, "n = 1"

    steps: list[tuple[Column, str]] = [(long_enough, "n <= 1")]
    if not derived:
        steps.append((long_enough & good_angle & good_error, "n >= 1"))
    steps.append(sole(long_enough & longest & closest & straightest))
    if derived:
        steps.append(sole(long_enough & good_angle & good_error & longest))
    steps += [
        sole(long_enough & straightest & closest),
        sole(long_enough & closest & longest & ((c("A") < 10) | (c("A") < 1.2 * c("minA")))),
        sole(long_enough & straightest & longest & good_error),
        (loose, "n <= 1"),
        sole(loose & longest),
        sole(loose & closest),
    ]
    decided, keep = F.lit(False), F.lit(False)
    for i, (rule, when) in enumerate(steps):
        best = best.withColumn(f"_r{i}", F.coalesce(rule, F.lit(False))).withColumn(f"_n{i}", F.sum(F.col(f"_r{i}").cast("int")).over(w))
        hit = F.expr(when.replace("n", f"_n{i}", 1))
        keep = F.when(~decided & hit, F.col(f"_r{i}")).otherwise(keep)
        decided = decided | hit
    return best.where(keep).select("way", by)


def losers(cands: DataFrame, kept: DataFrame, by: str = "name") -> DataFrame:
    return cands.select("way", by).join(kept, ["way", by], "left_anti")
