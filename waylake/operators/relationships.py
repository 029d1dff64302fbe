"""Relationships between input features and the ways that they matched."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from waylake.functions import geo
from waylake.functions.rows import with_program
from waylake.functions.storage import materialise
from waylake.operators import overlay, polygons, versions

Point = tuple[float, float]


def relationship_key(wkt: Column, error: Column, input_id: Column, matched: Column) -> Column:
    """MD5 over geometry, error, input and ways, nulls as empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.md5(F.concat(text(wkt), text(error), text(input_id), F.coalesce(F.concat(F.lit("{"), F.array_join(matched, ","), F.lit("}")), F.lit(""))))


def load_matches(target: DataFrame, staged: DataFrame) -> DataFrame:
    """Add staged matches that have ways; rows whose id and changeset exist are left as they are."""
    fresh = staged.where(F.col("matched").isNotNull())
    return versions.upsert(target, fresh, ["id", "changeset_id"], update=False)


def changed_matches(latest: DataFrame, staged: DataFrame, user_edited: DataFrame) -> DataFrame:
    """Staged matches with a new key, but for inputs that a user edited."""
    keys = latest.where("join_key is not null").select("join_key").distinct()
    return staged.join(keys, "join_key", "left_anti").join(user_edited.select("input_id").distinct(), "input_id", "left_anti")


def detach_removed(relationships: DataFrame, removed: DataFrame) -> DataFrame:
    """Relationships of removed features lose their ways and geometry."""
    gone = removed.select(F.col("id").alias("input_id")).distinct().withColumn("_gone", F.lit(True))
    joined = relationships.join(gone, "input_id", "left")
    blank = {c: F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(c)) for c in ("matched", "geometry", "error") if c in relationships.columns}
    return joined.withColumns(blank).select(*relationships.columns)


def edit_relationships(relationships: DataFrame, edits: DataFrame, changeset: int) -> DataFrame:
    """Apply a batch of edits (input_id, matched): (input_id, matched, action).

    UPDATE if the changeset holds the relationship, NEW if none ever existed, NEW_VERSION if an older one does.
    """
    mine = relationships.where(F.col("changeset_id") == changeset).select("input_id").distinct().withColumn("_mine", F.lit(True))
    known = relationships.select("input_id").distinct().withColumn("_known", F.lit(True))
    action = F.when(F.col("_mine"), "UPDATE").when(F.col("_known"), "NEW_VERSION").otherwise("NEW")
    return edits.join(mine, "input_id", "left").join(known, "input_id", "left").select("input_id", "matched", action.alias("action"))


# the part of a way beside an input line


def nearest_ends(line: list[Point], way: list[Point]) -> tuple[int, int]:
    """Vertices of the way nearest to both ends of the line, the first on a tie. If one vertex is nearest to both, the end
    takes the neighbour of it that is nearer to the line's start."""
    near = lambda p: min(range(len(way)), key=lambda i: math.dist(way[i], p))
    start, end = near(line[0]), near(line[-1])
    if start == end and len(way) > 1:
        beside = [i for i in (end - 1, end + 1) if 0 <= i < len(way)]
        end = min(beside, key=lambda i: math.dist(way[i], line[0]))
    return start, end


def _foot(way: list[Point], i: int, p: Point) -> tuple[float, Point]:
    """(position along the way in vertices, point) of the perpendicular foot of p next to vertex i."""
    best = (float(i), way[i])
    for j in (i - 1, i + 1):
        if 0 <= j < len(way):
            (x, y), (u, v) = way[i], way[j]
            square = (u - x) ** 2 + (v - y) ** 2
            t = ((p[0] - x) * (u - x) + (p[1] - y) * (v - y)) / square if square else 0.0
            foot = (x + (u - x) * t, y + (v - y) * t)
            if 0 < t <= 1 and math.dist(foot, p) < math.dist(best[1], p):
                best = (i + (j - i) * t, foot)
    return best


def clipped(line: list[Point], way: list[Point]) -> list[Point]:
    """The way between the feet of the line's ends, in the line's direction."""
    if len(way) < 2 or len(line) < 2:
        return way
    i, j = nearest_ends(line, way)
    (a, p), (b, q) = _foot(way, i, line[0]), _foot(way, j, line[-1])
    if a > b:
        return clipped(line, way[::-1])
    inner = [way[k] for k in range(math.floor(a) + 1, math.ceil(b))]
    found = [p, *inner, q]
    return [x for k, x in enumerate(found) if k == 0 or x != found[k - 1]]


def clip_matches(pairs: DataFrame) -> DataFrame:
    """``pairs`` (line, way) with ``clipped``, the part of the way beside the line."""

    @F.pandas_udf(geo.LINE)
    def clip(lines: pd.Series, ways: pd.Series) -> pd.Series:
        points = lambda s: [(p["x"], p["y"]) for p in s]
        return pd.Series([[{"x": x, "y": y} for x, y in clipped(points(a), points(b))] if a is not None and b is not None else None for a, b in zip(lines, ways)])

    return pairs.withColumn("clipped", clip("line", "way"))


def recomputed(pairs: DataFrame) -> DataFrame:
    """(input_id, type, parts, error): the geometry of relationships that a user gave (Z9), from pairs of input_id, line and
    ways (an array of lines in order): ways that go on from each other are joined, each is clipped to the line, and the
    error is the area between, as for matches. A relationship without a way of two points has no geometry."""

    def cut(line: list | None, ways: list | None) -> list:
        points = lambda s: [(p["x"], p["y"]) for p in s]
        parts = [clipped(points(line), part) for part in polygons.merged([points(w) for w in ways])] if line and ways else []
        return [[{"x": x, "y": y} for x, y in part] for part in parts if len(part) > 1]

    # few bytes, much to compute: as many tasks as the session asks for, not as the files have splits
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = pairs.select(F.col("input_id").alias("pair"), F.col("line").alias("a"), "ways").repartition(tasks, "pair")
    rows = materialise(with_program(slim, "parts", f"array<{geo.LINE}>", cut, "a", "ways").drop("ways"), "recomputed")
    single = overlay.area_between(rows.where(F.size("parts") == 1).select("pair", "a", F.col("parts")[0].alias("b"))).select("pair", "error")
    several = overlay.area_to_parts(rows.where(F.size("parts") > 1)).select("pair", "error")
    kind = F.when(F.size("parts") == 1, "LineString").when(F.size("parts") > 1, "MultiLineString")
    return rows.join(single.union(several), "pair", "left").select(F.col("pair").alias("input_id"), kind.alias("type"), "parts", "error")


def edited_geometry(edits: DataFrame, lines: DataFrame, ways: DataFrame) -> DataFrame:
    """Edits (input_id, matched: ids of ways in order) with the type, parts and error of their new geometry.

    lines: id, line; ways: id, line. Ways that aren't known are passed over."""
    each = edits.select("input_id", F.posexplode("matched").alias("k", "way")).join(ways.select(F.col("id").alias("way"), "line"), "way")
    drawn = each.groupBy("input_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda w: w["line"]).alias("ways"))
    pairs = edits.select("input_id").join(lines.select(F.col("id").alias("input_id"), "line"), "input_id", "left").join(drawn, "input_id", "left")
    return edits.select("input_id", "matched").join(recomputed(pairs), "input_id", "left")
