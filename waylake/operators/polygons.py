"""Polygon kernels: area of rings that may cross themselves, UTM, polygon error between lines (X13-X15), line merge."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

Point = tuple[float, float]
# fixed values: WGS 84 semi-major axis and flattening, UTM scale
A, FLAT, K0 = 6378137.0, 1 / 298.257223563, 0.9996


def utm(points: list[Point], zone: int | None = None) -> np.ndarray:
    """Metres east and north by the transverse Mercator series; the zone is the first vertex's."""
    p = np.asarray(points, float).reshape(-1, 2)
    zone = math.ceil((p[0, 0] + 180) / 6) if zone is None else zone
    lam, phi = np.radians(p[:, 0] - (zone * 6 - 183)), np.radians(p[:, 1])
    n = FLAT / (2 - FLAT)
    big = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.hypot(t, np.cos(lam)))
    east = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    north = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return np.stack([K0 * big * east + 500000, K0 * big * north], axis=1)


def even_odd_area(ring: np.ndarray) -> float:
    """Area inside a ring that may cross itself, by even-odd filling.

    Horizontal strips are cut at every vertex and crossing, so within a strip the edges don't cross and
    bound trapezoids.
    """
    ring = np.asarray(ring, float)
    a, b = ring, np.roll(ring, -1, axis=0)
    keep = (a != b).any(axis=1)
    a, b = a[keep], b[keep]
    cuts = set(a[:, 1].tolist())
    for i in range(len(a)):
        d, e = b[i] - a[i], b[i + 1 :] - a[i + 1 :]
        den = d[0] * e[:, 1] - d[1] * e[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = a[i + 1 :] - a[i]
            s = (gap[:, 0] * e[:, 1] - gap[:, 1] * e[:, 0]) / den
            t = (gap[:, 0] * d[1] - gap[:, 1] * d[0]) / den
        hit = (den != 0) & (s > 0) & (s < 1) & (t > 0) & (t < 1)
        cuts.update((a[i, 1] + s[hit] * d[1]).tolist())
    ys = sorted(cuts)
    total = 0.0
    for low, high in zip(ys, ys[1:]):
        across = (np.minimum(a[:, 1], b[:, 1]) <= low) & (np.maximum(a[:, 1], b[:, 1]) >= high)
        p, q = a[across], b[across]
        slope = (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1])
        x1, x2 = p[:, 0] + slope * (low - p[:, 1]), p[:, 0] + slope * (high - p[:, 1])
        order = np.argsort(x1 + x2)
        widths = np.diff((x1 + x2)[order])[::2]
        total += widths.sum() / 2 * (high - low)
    return float(total)


def area_m2(ring: list[Point]) -> float:
    if len(ring) < 3:
        return 0.0
    flat = utm(ring)
    return even_odd_area(flat - flat.mean(axis=0))


def centroid(ring: list[Point]) -> Point:
    """Centroid of a simple ring in the plane; the mean of its points if it has no area."""
    p = np.asarray(ring, float)
    q = np.roll(p, -1, axis=0)
    cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    if cross.sum() == 0:
        return tuple(p.mean(axis=0))
    return tuple(((p + q) * cross[:, None]).sum(axis=0) / (3 * cross.sum()))


def _length_m(line: list[Point]) -> float:
    from waylake.operators.splitting import metres

    return sum(metres(a, b) for a, b in zip(line, line[1:]))


def polygon_error(a: list[Point], b: list[Point]) -> float | None:
    """Area between two lines over their mean length, in m^2 per m."""
    mean = (_length_m(a) + _length_m(b)) / 2
    return area_m2([*a, *b[::-1]]) / mean if mean else None


def polygon_errors(pairs: DataFrame) -> DataFrame:
    """``pairs`` (with lines ``a`` and ``b``) and their ``error``."""

    @F.pandas_udf("double")
    def err(a: pd.Series, b: pd.Series) -> pd.Series:
        line = lambda s: [(p["x"], p["y"]) for p in s]
        return pd.Series([polygon_error(line(x), line(y)) if x is not None and y is not None else None for x, y in zip(a, b)])

    return pairs.withColumn("error", err("a", "b"))


def error_summary(matches: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Length-weighted error and shares matched and under the threshold; matches: km, error (null: unmatched)."""
    m = matches.agg(
        F.count("*").alias("total"), F.count("error").alias("matched"), F.sum((F.col("error") <= threshold).cast("int")).alias("good"),
        (F.sum(F.col("error") * F.col("km")) / F.sum(F.when(F.col("error").isNotNull(), F.col("km")))).alias("weighted"),
    )
    return m.select("total", "matched", F.coalesce("good", F.lit(0)).alias("good"), F.round("weighted", 6).alias("weighted_error"))


def error_histogram(matches: DataFrame, top: float = 30.0, bins: int = 15) -> DataFrame:
    """Matches per error bin; larger errors are in bin ``bins`` + 1."""
    return matches.where("error is not null").groupBy(F.expr(f"width_bucket(error, 0.0D, {top}D, {bins})").alias("bin")).agg(F.count("*").alias("n"))


def merged(lines: list[list[Point]]) -> list[list[Point]]:
    """Lines joined end to end where exactly two meet; the rest stay as parts."""
    parts = {i: list(line) for i, line in enumerate(lines) if len(line) > 1}
    at: dict[Point, set[int]] = {}
    for i, p in parts.items():
        for end in (p[0], p[-1]):
            at.setdefault(end, set()).add(i)
    degree: dict[Point, int] = {}
    for p in parts.values():
        for end in (p[0], p[-1]):
            degree[end] = degree.get(end, 0) + 1
    for end in sorted(at):
        here = sorted(at[end])
        if degree[end] != 2 or len(here) != 2:
            continue
        i, j = here
        a, b = parts[i], parts.pop(j)
        if a[0] == end:
            a = a[::-1]
        if b[-1] == end:
            b = b[::-1]
        parts[i] = a + b[1:]
        for other in at.values():
            if j in other:
                other.discard(j)
                other.add(i)
    return [parts[i] for i in sorted(parts)]


def merge_lines(lines: DataFrame, key: str) -> DataFrame:
    """(key, parts) of the lines of each key; a key's lines are those of one way or match."""
    from waylake.functions.geo import LINE

    def run(g: pd.DataFrame) -> pd.DataFrame:
        found = merged([[(p["x"], p["y"]) for p in line] for line in g.sort_values("seq")["line"]])
        return pd.DataFrame({key: [g[key].iloc[0]], "parts": [[[{"x": x, "y": y} for x, y in part] for part in found]]})

    kind = lines.schema[key].dataType.simpleString()
    return lines.groupBy(key).applyInPandas(run, f"{key} {kind}, parts array<{LINE}>")


def simplify(line: Column, tolerance: float) -> Column:
    """Points kept at least so far from the last kept one; both ends stay."""

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        far = F.sqrt(F.pow(last["x"] - p["x"], 2) + F.pow(last["y"] - p["y"], 2)) >= tolerance
        return F.when((F.size(acc) == 0) | F.coalesce(far, F.lit(True)), F.array_append(acc, p)).otherwise(acc)

    kept = F.aggregate(line, F.slice(line, 1, 1), step)
    return F.when(F.element_at(kept, -1) == F.element_at(line, -1), kept).otherwise(F.array_append(kept, F.element_at(line, -1)))
