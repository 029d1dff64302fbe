"""Geometry as column expressions: distances, headings, projections, lines as text.

Points are columns of longitude and latitude in degrees; lines are ``array<struct<x,y>>``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Mean radius of the earth in km, for distances; the equatorial one is used for the inverse.
RADIUS_KM = 6371.0
EQUATORIAL_KM = 6378.137
LINE = "array<struct<x:double,y:double>>"


def haversine_km(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(y2 - y1) / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # null for a missing point


#: Below this the series of sin() and asin() give all digits of a double.
SHORT = 0.02


def sin(x: Column) -> Column:
    """F.sin(), by its series where the angle is short, which costs a tenth; ``x`` is a column already computed."""
    q = x * x
    return F.when(F.abs(x) < SHORT, x * (1 - q * (1 / 6 - q * (1 / 120 - q / 5040)))).otherwise(F.sin(x))


def asin(x: Column) -> Column:
    """F.asin(), by its series where the value is small; ``x`` is a column already computed."""
    q = x * x
    return F.when(F.abs(x) < SHORT, x * (1 + q * (1 / 6 + q * (3 / 40 + q * (15 / 336 + q * (35 / 1152)))))).otherwise(F.asin(x))


def chord_km(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Straight-line distance through the earth."""

    def place(x: Column, y: Column) -> tuple[Column, Column, Column]:
        lam, phi = F.radians(x), F.radians(y)
        return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)

    return RADIUS_KM * F.sqrt(sum((F.pow(a - b, 2) for a, b in zip(place(x1, y1), place(x2, y2))), F.lit(0.0)))


def heading(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Initial bearing in degrees, -180 to 180, north is 0 and east is 90."""
    dx, a, b = F.radians(x2 - x1), F.radians(y1), F.radians(y2)
    return F.degrees(F.atan2(F.sin(dx) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dx)))


def compass(angle: Column) -> Column:
    """Sector of a heading; the edges belong to the north and the side sectors."""
    return (
        F.when((angle < -135) | (angle > 135), "SOUTHBOUND")
        .when(angle < -45, "WESTBOUND")
        .when(angle > 45, "EASTBOUND")
        .otherwise("NORTHBOUND")
    )


def turn(angle: Column, reference: Column) -> Column:
    """Smallest turn between two headings, 0 to 180."""
    d = F.pmod(angle - reference, F.lit(360.0))
    return F.least(d, 360.0 - d)


def within_angle(angle: Column, reference: Column, buffer: Column, two_way: Column | None = None) -> Column:
    """Whether a heading, or its opposite on a two-way road, is within the buffer of the reference."""
    hit = turn(angle, reference) <= F.abs(buffer)
    if two_way is not None:
        hit = hit | (two_way & (turn(angle + 180, reference) <= F.abs(buffer)))
    return hit | (buffer > 180)


def fold_angle(angle: Column) -> Column:
    """Difference of two undirected lines, 0 to 90 degrees."""
    d = F.pmod(angle, F.lit(180.0))
    return F.least(d, 180.0 - d)


def project(x1: Column, y1: Column, x2: Column, y2: Column, x: Column, y: Column) -> Column:
    """Position 0..1 on a segment that is nearest to a point, in plane degrees; 0 on a segment without length."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square > 0, ((x - x1) * dx + (y - y1) * dy) / square).otherwise(F.lit(0.0))
    return F.when(t < 0, 0.0).when(t > 1, 1.0).otherwise(t)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def destination(x: Column, y: Column, bearing: Column, km: Column) -> tuple[Column, Column]:
    """(lon, lat) at a bearing in radians and a distance."""
    lon, lat, d = F.radians(x), F.radians(y), km / EQUATORIAL_KM
    lat2 = F.asin(F.sin(lat) * F.cos(d) + F.cos(lat) * F.sin(d) * F.cos(bearing))
    lon2 = lon + F.atan2(F.sin(bearing) * F.sin(d) * F.cos(lat), F.cos(d) - F.sin(lat) * F.sin(lat2))
    return F.degrees(lon2), F.degrees(lat2)


def steps(line: Column) -> Column:
    """Consecutive pairs of a line's points, as struct<a,b>."""
    n = F.size(line)
    pairs = F.zip_with(F.slice(line, F.lit(1), n - 1), F.slice(line, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))


def length_km(line: Column) -> Column:
    """Length of a line; 0 under two points."""
    each = F.transform(steps(line), lambda s: haversine_km(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]))
    return F.aggregate(each, F.lit(0.0), lambda t, d: t + d)


def planar_length(line: Column) -> Column:
    """Length in the plane."""
    each = F.transform(steps(line), lambda s: F.sqrt(F.pow(s["b"]["x"] - s["a"]["x"], 2) + F.pow(s["b"]["y"] - s["a"]["y"], 2)))
    return F.aggregate(each, F.lit(0.0), lambda t, d: t + d)


def shoelace(ring: Column) -> Column:
    """Signed area in the plane of a closed or open ring without crossings."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    each = F.transform(steps(closed), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])
    return F.aggregate(each, F.lit(0.0), lambda t, d: t + d) / 2


def wkt_line(line: Column, decimals: int = 6) -> Column:
    """LINESTRING text with fixed decimals."""
    text = lambda v: F.format_string(f"%.{decimals}f", v)
    points = F.transform(line, lambda p: F.concat_ws(" ", text(p["x"]), text(p["y"])))
    return F.concat(F.lit("LINESTRING ("), F.array_join(points, ", "), F.lit(")"))


def _wkt_points(line: Column, decimals: int) -> Column:
    text = lambda v: F.format_string(f"%.{decimals}f", v)
    return F.array_join(F.transform(line, lambda p: F.concat_ws(" ", text(p["x"]), text(p["y"]))), ", ")


def wkt_point(x: Column, y: Column, decimals: int = 6) -> Column:
    """POINT text with fixed decimals."""
    return F.concat(F.lit("POINT ("), F.format_string(f"%.{decimals}f %.{decimals}f", x, y), F.lit(")"))


def wkt_polygon(rings: Column, decimals: int = 6) -> Column:
    """POLYGON text of an array of rings, each closed if it isn't."""
    closed = lambda r: F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    each = F.transform(rings, lambda r: F.concat(F.lit("("), _wkt_points(closed(r), decimals), F.lit(")")))
    return F.concat(F.lit("POLYGON ("), F.array_join(each, ", "), F.lit(")"))


def from_wkt(text: Column) -> Column:
    """struct<type, lines>: the type of a WKT geometry in capitals, and its lists of points in order (X1): one point of a
    POINT, one list of a LINESTRING, the rings of a POLYGON, those of all parts of a multi-part geometry. Points of three
    numbers lose the third. Text that isn't WKT gives null; EMPTY gives no list."""
    kind = F.upper(F.regexp_extract(text, r"^\s*(?:SRID=\d+;)?\s*([A-Za-z]+)", 1))
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    lists = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1))
    point = lambda p: F.struct(F.get(p, F.lit(0)).cast("double").alias("x"), F.get(p, F.lit(1)).cast("double").alias("y"))
    pairs = F.transform(lists, lambda one: F.transform(F.split(one, ","), lambda p: point(F.regexp_extract_all(p, F.lit(number), F.lit(0)))))
    # points of a MULTIPOINT may have brackets of their own or none
    pairs = F.when(kind == "MULTIPOINT", F.transform(F.flatten(pairs), lambda p: F.array(p))).otherwise(pairs)
    known = kind.isin("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON")
    return F.when(known, F.struct(kind.alias("type"), pairs.alias("lines")))


def line_ends(line: Column) -> tuple[Column, Column]:
    """First and last point."""
    return F.element_at(line, 1), F.element_at(line, -1)


def utm_zone(x: Column) -> Column:
    return F.ceil((x + 180) / 6).cast("int")


#: fixed values: WGS 84 semi-major axis and flattening, scale of UTM
UTM_A, UTM_FLAT, UTM_K0 = 6378137.0, 1 / 298.257223563, 0.9996


def utm(x: Column, y: Column, zone: Column) -> Column:
    """struct<x,y> in metres east and north of a UTM zone, by the transverse Mercator series."""
    n = UTM_FLAT / (2 - UTM_FLAT)
    big = UTM_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * UTM_K0
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    lam, sin = F.radians(x - (zone * 6 - 183)), F.sin(F.radians(y))
    t = F.sinh(F.atanh(sin) - e * F.atanh(e * sin))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    east = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alpha, 1)), F.lit(0.0))
    north = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alpha, 1)), F.lit(0.0))
    return F.struct((big * east + 500000).alias("x"), (big * north).alias("y"))


def cell(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Grid cell of a point."""
    return F.floor(x / size).cast("long"), F.floor(y / size).cast("long")


def reach_of_km(km: float, lat: Column) -> tuple[Column, Column]:
    """Degrees of longitude and of latitude that hold everything within a distance of positions up to a latitude."""
    up = math.degrees(km / RADIUS_KM)
    farthest = F.least(F.abs(lat) + up, F.lit(90.0))
    # beyond a pole all longitudes are within reach
    across = F.when(farthest < 89.9, F.least(F.lit(up) / F.cos(F.radians(farthest)), F.lit(180.0))).otherwise(180.0)
    return across, F.lit(up)


def square_cell_id(x: Column, y: Column, resolution: int) -> Column:
    """A cell id of our own grid: 2^resolution rows of latitude, twice as many columns (in place of X33's hexagons).

    Ids are nested: the parent of a cell comes from halving row and column. A missing point has id 0.
    """
    n = 1 << resolution
    row = F.least(F.floor((y + 90) / 180 * n), F.lit(n - 1)).cast("long")
    column = F.least(F.floor((x + 180) / 180 * n), F.lit(2 * n - 1)).cast("long")
    cell_id = (F.lit(resolution).cast("long") + 1) * (1 << 56) + row * (1 << 28) + column
    return F.when(x.isNull() | y.isNull(), F.lit(0).cast("long")).otherwise(cell_id)
