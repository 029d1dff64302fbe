"""Way splitting at the ends of matched lines (X29-X31), and trimming of line ends.

Each way is one group: its vertices and its cut candidates. Groups are as large as a way. place_cuts() and pieces() are the
rule for one way; _split_all() takes the same steps for all ways of a block at once, with NumPy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from waylake.functions import geo
from waylake.functions.storage import materialise
from waylake.operators.eav import surrogate_ids

SNAP_M = 2.5
Point = tuple[float, float]


def metres(a: Point, b: Point) -> float:
    (x1, y1), (x2, y2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2000 * geo.RADIUS_KM * math.asin(math.sqrt(min(1.0, h)))


def _side(points: list[Point], i: int, p: Point) -> tuple[int, float] | None:
    """(neighbour, projection parameter) of the segment next to vertex i that the point lies along."""
    v = points[i]
    o = (p[0] - v[0], p[1] - v[1])

    def along(j: int) -> tuple[float, float]:
        t = (points[j][0] - v[0], points[j][1] - v[1])
        dot, square = o[0] * t[0] + o[1] * t[1], t[0] * t[0] + t[1] * t[1]
        return (dot, dot / square) if square else (0.0, 0.0)

    sides = [(j, *along(j)) for j in (i + 1, i - 1) if 0 <= j < len(points)]
    ahead = [s for s in sides if s[1] > 0]
    if not ahead:
        return None
    if len(ahead) == 2:  # a sharp bend: the longer scalar projection, the right side on a tie
        ahead.sort(key=lambda s: -s[1] / math.dist(points[s[0]], v))
    return ahead[0][0], ahead[0][2]


def place_cuts(points: list[Point], candidates: list[Point]) -> tuple[list[Point], list[bool], list[int]]:
    """(vertices, whether each is new, cut positions): candidates in order, later ones see inserted vertices."""
    points, fresh, cuts = list(points), [False] * len(points), []
    marks = [False] * len(points)
    for p in candidates:
        i = min(range(len(points)), key=lambda k: math.dist(points[k], p))
        side = _side(points, i, p)
        if side is None:
            continue
        j, t = side
        q = (points[i][0] + (points[j][0] - points[i][0]) * t, points[i][1] + (points[j][1] - points[i][1]) * t)
        if metres(points[i], q) >= SNAP_M:
            at = max(i, j)
            points.insert(at, q)
            fresh.insert(at, True)
            marks.insert(at, True)
        else:
            marks[i] = True
    cuts = [k for k, m in enumerate(marks) if m]
    return points, fresh, cuts


def pieces(n: int, cuts: list[int]) -> list[tuple[int, int]]:
    """(first, last) vertex of each piece; pieces share their cut. A single cut at an end makes none."""
    if len(cuts) == 1 and cuts[0] in (0, n - 1) or not cuts:
        return []
    edges = sorted({0, *cuts, n - 1})
    return list(zip(edges, edges[1:]))


SCHEMA = "way_id long, piece int, seq int, x double, y double, is_new boolean, node_id long"


#: Ways of more vertices and candidates than this go one by one.
MOST_POINTS = 64


def split_ways(ways: DataFrame, cuts: DataFrame) -> DataFrame:
    """Vertices of all pieces of all split ways.

    ways: way_id, nodes array<struct<id,x,y>>; cuts: way_id, seq, x, y, the candidates in order. New
    vertices have no node_id yet; see number_new_nodes().
    """

    at = F.struct("seq", *[F.col(k).cast("double").alias(k) for k in "xy"])
    listed = cuts.groupBy("way_id").agg(F.sort_array(F.collect_list(at)).alias("cuts"))
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))
    typed = [F.col("way_id").cast("long").alias("way_id"), F.col("nodes").cast("array<struct<id:long,x:double,y:double>>").alias("nodes"), "cuts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [batch.column(k).value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for k in (1, 2)]
            small = np.flatnonzero((n[0] + n[1] <= MOST_POINTS) & (n[0] > 0))
            if len(small):
                yield pa.RecordBatch.from_arrays(_split_all(batch.take(pa.array(small))), schema=schema)
            for k in np.flatnonzero(n[0] + n[1] > MOST_POINTS):
                rows = _split(*(batch.column(c)[int(k)].as_py() for c in range(3)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*rows), schema)], schema=schema)

    return ways.join(listed, "way_id").select(*typed).mapInArrow(run, SCHEMA)


def _padded(column: pa.ListArray, names: tuple[str, ...], width: int, fill: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """(lengths, one matrix per field) of a column of lists of structs."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat, held = column.flatten(), np.arange(width) < n[:, None]
    fields = []
    for name in names:
        values = flat.field(name).to_numpy(zero_copy_only=False)
        fields.append(np.full(held.shape, fill, values.dtype))
        fields[-1][held] = values
    return n, fields


def _first_of_equals(n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of each row's n points aren't a repetition of an earlier one."""
    row, k = np.nonzero(np.arange(x.shape[1]) < n[:, None])
    order = np.lexsort((k, y[row, k], x[row, k], row))
    row, k = row[order], k[order]
    again = np.zeros(len(row), bool)
    again[1:] = (row[1:] == row[:-1]) & (x[row, k][1:] == x[row, k][:-1]) & (y[row, k][1:] == y[row, k][:-1])
    first = np.zeros(x.shape, bool)
    first[row, k] = ~again
    return first


def _metres_all(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    h = np.sin(np.radians(y2 - y1) / 2) ** 2 + np.cos(np.radians(y1)) * np.cos(np.radians(y2)) * np.sin(np.radians(x2 - x1) / 2) ** 2
    return 2000 * geo.RADIUS_KM * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def _split_all(batch: pa.RecordBatch) -> list[pa.Array]:
    """_split() of all ways of a batch at once: one candidate of every way after the other."""
    width = max(int(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).max()), 1)
    many = int(batch.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).max())
    n, (x, y, ids) = _padded(batch.column(1), ("x", "y", "id"), width + many, 0)
    given, (cx, cy) = _padded(batch.column(2), ("x", "y"), max(many, 1), 0)
    wanted = _first_of_equals(given, cx, cy)
    n, column = n.copy(), np.arange(width + many)
    fresh, marks = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
    for k in range(many):
        r = np.flatnonzero(wanted[:, k])
        px, py = cx[r, k], cy[r, k]
        i = np.where(column < n[r, None], np.hypot(x[r] - px[:, None], y[r] - py[:, None]), np.inf).argmin(1)
        vx, vy = x[r, i], y[r, i]
        ahead, part, length = [], [], []
        for j in (i + 1, i - 1):
            at = np.clip(j, 0, x.shape[1] - 1)
            tx, ty = x[r, at] - vx, y[r, at] - vy
            dot, square = (px - vx) * tx + (py - vy) * ty, tx * tx + ty * ty
            ok = (j >= 0) & (j < n[r]) & (square > 0) & (dot > 0)
            safe = np.where(square > 0, square, 1.0)
            ahead.append(ok)
            part.append(dot / safe)
            length.append(np.where(ok, dot / np.sqrt(safe), -np.inf))
        # a sharp bend: as in _side(), which takes the larger of these, the right side on a tie
        left = ahead[1] & (~ahead[0] | (length[1] > length[0]))
        some = ahead[0] | ahead[1]
        r, i, vx, vy, left = r[some], i[some], vx[some], vy[some], left[some]
        j, t = np.where(left, i - 1, i + 1), np.where(left, part[1][some], part[0][some])
        qx, qy = vx + (x[r, j] - vx) * t, vy + (y[r, j] - vy) * t
        new = _metres_all(vx, vy, qx, qy) >= SNAP_M
        marks[r[~new], i[~new]] = True
        r, at, qx, qy = r[new], np.maximum(i, j)[new], qx[new], qy[new]
        source = column - (column > at[:, None])
        for values, value in ((x, qx), (y, qy), (ids, 0), (fresh, True), (marks, True)):
            values[r] = np.take_along_axis(values[r], source, 1)
            values[r, at] = value
        n[r] += 1
    held, last = column < n[:, None], column == n[:, None] - 1
    marks &= held
    cut = marks.any(1) & ~((marks.sum(1) == 1) & (marks[:, 0] | (marks & last).any(1)))
    ends = held & (marks | (column == 0) | last)
    number = np.cumsum(ends, 1)
    start = np.maximum.accumulate(np.where(ends, column, 0), 1)  # the last end up to each vertex
    before = np.concatenate([np.zeros((len(n), 1), start.dtype), start[:, :-1]], 1)
    # a vertex is in the piece that begins at or before it; an end but the first also closes the piece before
    parts = [(held & ~last & cut[:, None], number - 1, column - start), (ends & (column > 0) & cut[:, None], number - 2, column - before)]
    row, k = (np.concatenate(v) for v in zip(*[np.nonzero(p[0]) for p in parts]))
    piece, seq = (np.concatenate([p[f][p[0]] for p in parts]).astype(np.int32) for f in (1, 2))
    way = batch.column(0).to_numpy(zero_copy_only=False)[row]
    values = [pa.array(v) for v in (way, piece, seq, x[row, k], y[row, k], fresh[row, k])]
    return [*values, pa.array(ids[row, k].astype(np.int64), mask=fresh[row, k])]


def _split(way_id: int, nodes: list, candidates: list) -> list[tuple]:
    unique = list(dict.fromkeys((c["x"], c["y"]) for c in candidates))
    placed, fresh, at = place_cuts([(n["x"], n["y"]) for n in nodes], unique)
    ids: list[int | None] = []
    k = 0
    for f in fresh:
        ids.append(None if f else nodes[k]["id"])
        k += not f
    return [
        (way_id, number, k - a, *placed[k], fresh[k], ids[k]) for number, (a, b) in enumerate(pieces(len(placed), at)) for k in range(a, b + 1)
    ]


def number_new_nodes(split: DataFrame, after: int) -> DataFrame:
    """Ids after ``after`` for the new vertices, one per place of a way, in a fixed order."""
    split = materialise(split, "split")  # read twice
    places = split.where("is_new").select("way_id", "x", "y").distinct()
    ids = surrogate_ids(places, ["way_id", "x", "y"], "new_id", after)
    return (
        split.join(ids, ["way_id", "x", "y"], "left")
        .withColumn("node_id", F.when(F.col("is_new"), F.col("new_id")).otherwise(F.col("node_id")))
        .drop("new_id")
    )


def _walk(line: list[Point], cut: float) -> list[Point]:
    done = 0.0
    for i, (a, b) in enumerate(zip(line, line[1:])):
        step = metres(a, b)
        if done + step > cut:
            t = (cut - done) / step
            return [(a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t), *line[i + 1 :]]
        done += step
    return line


def trimmed(line: list[Point]) -> list[Point]:
    """A tenth off each end of a line under 500 m, else 50 m; the cut comes from the whole length."""
    total = sum(metres(a, b) for a, b in zip(line, line[1:]))
    cut = total / 10 if total < 500 else 50.0
    return _walk(_walk(line, cut)[::-1], cut)[::-1]


def trim_ends(lines: DataFrame) -> DataFrame:
    """``lines`` (id, line) with both ends cut back before matching."""

    @F.pandas_udf(geo.LINE)
    def cut(series: pd.Series) -> pd.Series:
        return series.map(lambda line: [{"x": x, "y": y} for x, y in trimmed([(p["x"], p["y"]) for p in line])] if line is not None else None)

    return lines.withColumn("line", cut("line"))
