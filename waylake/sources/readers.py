"""Sources: CSV, GeoJSON, OSM JSON, newest file, paged feature services, grid cells (A1-A10)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

GEOMETRY = "struct<type:string,coordinates:string>"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column as text."""
    return spark.read.option("header", True).csv(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(id, geometry as JSON text, properties as a map of text), one row per feature.

    Properties stay a map, so that no feature widens the schema of the others; arrays become JSON text.
    """
    schema = "type string, features array<struct<id:string,geometry:string,properties:map<string,string>>>"
    files = spark.read.schema(schema).option("multiLine", True).json(path)
    return files.select(F.explode("features").alias("f")).select("f.id", "f.geometry", "f.properties")


def geojson_line(geometry: str = "geometry"):
    """The points of a LineString geometry's JSON text, null for other types."""
    parsed = F.from_json(F.col(geometry), "type string, coordinates array<array<double>>")
    points = F.transform(parsed["coordinates"], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return F.when(parsed["type"] == "LineString", points)


def read_osm_json(spark: SparkSession, path: str, prefix: str = "OSM") -> DataFrame:
    """(id, type, tags, nodes, line): nodes and ways; ways get their nodes' positions by a join.

    Ids are prefixed for every element, with or without tags.
    """
    schema = "elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>"
    e = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")
    full = lambda kind, key: F.concat_ws("&&", F.lit(prefix), F.lit(kind), key.cast("string"))
    empty = F.create_map().cast("map<string,string>")
    nodes = e.where("type = 'node'").select(
        full("NODE", F.col("id")).alias("id"), F.lit("node").alias("type"), F.coalesce("tags", empty).alias("tags"),
        F.array().cast("array<string>").alias("nodes"), F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))).alias("line"),
    )
    at = e.where("type = 'node'").select(F.col("id").alias("node"), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("xy"))
    ways = e.where("type = 'way'").select("id", F.coalesce("tags", empty).alias("tags"), "nodes")
    placed = ways.select("id", F.posexplode("nodes").alias("pos", "node")).join(at, "node").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "xy"))).alias("p"))
    lines = ways.join(placed, "id", "left").select(
        full("WAY", F.col("id")).alias("id"), F.lit("way").alias("type"), "tags",
        F.transform("nodes", lambda n: full("NODE", n)).alias("nodes"), F.transform("p", lambda s: s["xy"]).alias("line"),
    )
    return nodes.unionByName(lines)


def newest_file(spark: SparkSession, folder: str, part: str) -> str | None:
    """The last file by name, among those of a folder whose name contains ``part``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if part in s.getPath().getName())
    return f"{folder.rstrip('/')}/{names[-1]}" if names else None


@dataclass
class _Page(InputPartition):
    offset: int
    size: int
    last: int = 0  # the last page's number


class LostPage(RuntimeError):
    """A page before the last one didn't hold as many rows as the others: rows would be missing."""


def _tried(fetch: Callable[[int, int], list[tuple]], offset: int, size: int, retries: int, wait: float) -> list[tuple]:
    """The rows of a page; a failed try is repeated after a wait that doubles."""
    for attempt in range(retries + 1):
        try:
            return list(fetch(offset, size))
        except OSError:
            if attempt == retries:
                raise
            time.sleep(wait * 2**attempt)
    return []


class _PagedReader(DataSourceReader):
    def __init__(self, fetch: Callable[[int, int], list[tuple]], count: Callable[[], int], size: int, retries: int, wait: float):
        self.fetch, self.count, self.size, self.retries, self.wait = fetch, count, size, retries, wait

    def partitions(self) -> list[_Page]:
        return [_Page(at, self.size) for at in range(0, max(1, self.count()), self.size)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        if self.retries:
            yield from _tried(self.fetch, partition.offset, partition.size, self.retries, self.wait)
        else:
            yield from self.fetch(partition.offset, partition.size)


class _UncountedReader(DataSourceReader):
    """Pages of a service that doesn't say how many rows it has: a few pages tell the driver how many there are."""

    def __init__(self, fetch: Callable[[int, int], list[tuple]], size: int, retries: int, wait: float):
        self.fetch, self.size, self.retries, self.wait = fetch, size, retries, wait

    def _rows(self, page: int) -> int:
        return len(_tried(self.fetch, page * self.size, self.size, self.retries, self.wait))

    def partitions(self) -> list[_Page]:
        first = self._rows(0)
        if first and first < self.size and _tried(self.fetch, first, self.size, self.retries, self.wait):
            self.size = first  # the service gives fewer rows a page than it is asked for
        # pages double until one isn't full, then the first such page lies between the last two
        low, high = (0, 1) if first >= self.size else (-1, 0)
        while low >= 0 and self._rows(high) >= self.size:
            low, high = high, high * 2
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._rows(middle) >= self.size else (low, middle)
        return [_Page(page * self.size, self.size, high) for page in range(high + 1)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        rows = _tried(self.fetch, partition.offset, partition.size, self.retries, self.wait)
        page, last = partition.offset // partition.size, partition.last
        if page < last and len(rows) < partition.size:
            raise LostPage(f"page {page} has {len(rows)} of {partition.size} rows, and {last - page} pages follow")
        if page == last and len(rows) >= partition.size:
            raise LostPage(f"page {page} was the last one and is full now: the service has grown")
        yield from rows


def paged_source(
    name: str, schema: str, fetch: Callable[[int, int], list[tuple]], count: Callable[[], int] | None = None, size: int = 2000, retries: int = 5, wait: float = 1.0
) -> type[DataSource]:
    """A data source over a paged service: one partition per page, with retries inside the task (A2, A4).

    ``fetch(offset, size)`` returns the rows of a page. Without ``count`` the first page that isn't full is the last; the
    driver finds it with as many fetches as twice the logarithm of the number of pages. A page before it that isn't full,
    when it is read, is an error. Register the class with spark.dataSource.register().
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return _UncountedReader(fetch, size, retries, wait) if count is None else _PagedReader(fetch, count, size, retries, wait)

    return Paged


def grid_cells(spark: SparkSession, x1: float, y1: float, x2: float, y2: float, resolution: int) -> DataFrame:
    """(cell_id, x, y) of all cells of our square grid with a centre in a box."""
    from waylake.functions.geo import square_cell_id

    n = 1 << resolution
    step = 180 / n
    first, last = int((x1 + 180) / step), int((x2 + 180) / step)
    rows = spark.range(int((y1 + 90) / step), int((y2 + 90) / step) + 1).select(((F.col("id") + 0.5) * step - 90).alias("y"))
    both = rows.select("y", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("k")).select(((F.col("k") + 0.5) * step - 180).alias("x"), "y")
    both = both.where(F.col("x").between(x1, x2) & F.col("y").between(y1, y2))
    return both.select(square_cell_id(F.col("x"), F.col("y"), resolution).alias("cell_id"), "x", "y")


@dataclass(frozen=True)
class Layer:
    """How a source becomes features and attributes (2.15): one description in place of a script per layer."""

    id: str
    type: str
    name: str  # expression for the feature's name
    key: str | None  # expression for the source's id; None: a surrogate by geometry and properties
    fields: tuple[str, ...]
    drop_nulls: bool = False
    dedupe_by: tuple[str, ...] = field(default=())  # columns whose largest value wins per geometry, nulls first
    values: Mapping[str, str] = field(default_factory=dict)  # expressions of fields that aren't columns; _key is the feature's number
    named_values: bool = False  # the published scripts give the feature's name as the value of every field


LAYERS = {
    layer.id: layer
    for layer in (
        Layer("LOCALITY", "POLYGON", "name", None, ("name", "state")),
        Layer("ROADS", "LINE", "road_name", "ufi", ("road_name", "class_code", "feature_type_code", "road_type"), drop_nulls=True),
        Layer("DECLARED", "LINE", "name", "number", ("name", "number", "status"), drop_nulls=True, dedupe_by=("name", "number")),
    )
}


def reshape(staged: DataFrame, layer: Layer, own_values: bool = False) -> tuple[DataFrame, DataFrame]:
    """(features, attributes) of a staged source: a ``geometry`` column of text and the layer's fields, all text.
    ``own_values`` gives fields their own values in layers whose published scripts give the feature's name instead.

    features: feature_id, name, geometry, join_key; attributes: feature_id, s_name, s_value, join_key.
    """
    from pyspark.sql import Window as W

    from waylake.functions.exprs import change_key
    from waylake.operators.eav import surrogate_ids, unpivot

    df = staged
    if layer.dedupe_by:
        best = W.partitionBy("geometry").orderBy(*[F.col(c).desc_nulls_first() for c in layer.dedupe_by])
        df = df.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    if layer.key is None:
        df = surrogate_ids(df, ["geometry", *[c for c in layer.fields if c not in layer.values]], "_key")
    else:
        df = df.withColumn("_key", F.expr(layer.key))
    df = df.withColumn("feature_id", F.concat_ws("&&", F.lit(layer.id), F.col("_key").cast("string")))
    df = df.select("feature_id", F.expr(layer.name).alias("_name"), "geometry", *[F.expr(layer.values.get(c, f"`{c}`")).cast("string").alias(c) for c in layer.fields])
    features = df.select("feature_id", F.col("_name").alias("name"), "geometry")
    if layer.named_values and not own_values:
        df = df.select("feature_id", *[F.col("_name").alias(c) for c in layer.fields])
    features = features.withColumn("join_key", change_key(F.col("name"), F.col("feature_id"), F.col("geometry")))
    attributes = unpivot(df, ["feature_id"], list(layer.fields), layer.drop_nulls)
    return features, attributes.withColumn("join_key", change_key(F.col("feature_id"), F.col("s_name"), F.col("s_value")))
