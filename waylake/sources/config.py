"""Descriptions of sources, their order of loading and the reader for each."""

from __future__ import annotations

import http.client
import json
import os
import re
import tempfile
import time
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource

from waylake.sources import readers

try:
    import yaml
except ImportError:  # JSON, which is YAML too, can be read without it
    yaml = None


@dataclass
class SourceConfig:
    """``method`` is how a source is fetched: REST, ARCGIS_REST, S3, OSM or H3_HEX, with that method's ``options``."""

    name: str
    method: str
    file_format: str = "CSV"
    options: dict = field(default_factory=dict)
    prerequisites: tuple[str, ...] = ()


def load_configs(text: str, environment: Mapping[str, str] = os.environ) -> dict[str, SourceConfig]:
    """Sources by upper-case name. A header that is all ``{NAME}`` takes the environment's value, if there is one."""
    given = yaml.safe_load(text) if yaml else json.loads(text)
    found = {}
    for name, entry in given.items():
        options = dict(entry.get("options", {}))
        if "headers" in options:
            options["headers"] = {k: _from_environment(v, environment) for k, v in options["headers"].items()}
        required = tuple(p.upper() for p in entry.get("prerequisites", ()))
        found[name.upper()] = SourceConfig(name.upper(), entry["method"].upper(), entry.get("file_format", "CSV").upper(), options, required)
    return found


def _from_environment(value: str, environment: Mapping[str, str]) -> str:
    named = re.fullmatch(r"\{(.*)\}", value)
    return environment.get(named[1], value) if named else value


def in_order(configs: Mapping[str, SourceConfig], wanted: list[str], done: set[str] = frozenset()) -> list[str]:
    """The wanted sources and all they require, each once and after what it requires, without those done."""
    order: list[str] = []

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError("sources require each other: " + " > ".join([*above, name]))
        if name in done or name in order:
            return
        for required in configs[name].prerequisites:
            visit(required, (*above, name))
        order.append(name)

    for name in wanted:
        visit(name.upper(), ())
    return order


def http_get(url: str, headers: Mapping[str, str], tries: int = 5, wait: float = 60.0, open_url=urllib.request.urlopen) -> Iterator[str]:
    """The lines of a response, once all of it has come: a failed or broken-off try is repeated after a wait, and none of
    its lines are given out. Responses over 64 MB wait in the task's temporary folder."""
    for left in range(tries, 0, -1):
        with tempfile.SpooledTemporaryFile(64 << 20) as whole:
            try:
                with open_url(urllib.request.Request(url, headers=dict(headers))) as response:
                    for block in iter(lambda: response.read(1 << 20), b""):
                        whole.write(block)
            except (OSError, http.client.HTTPException):
                if left == 1:
                    raise
                time.sleep(wait)
                continue
            whole.seek(0)
            for line in whole:
                yield line.decode("utf-8").rstrip("\r\n")
            return


def rest_source(name: str, options: Mapping, get: Callable[..., Iterator[str]] = http_get) -> type[DataSource]:
    """A data source of one column ``value``, a response's lines, fetched by one task as one page (A3): a service without
    pages gives one response. ``get`` does its own retries."""
    url, headers = options["url"], dict(options.get("headers", {}))
    return readers.paged_source(name, "value string", lambda offset, size: ((line,) for line in get(url, headers)), lambda: 1, 1, retries=0)


FORMATS = {"CSV": readers.read_csv, "GEOJSON": readers.read_geojson, "OSM_JSON": readers.read_osm_json}


def read_source(spark: SparkSession, source: SourceConfig) -> DataFrame:
    """The rows of a source by its method (A1).

    S3: the newest file of ``location`` whose name contains ``contains``. OSM: the saved JSON at ``location``. H3_HEX: the cells of
    ``bounding_box`` at ``resolution``. REST: the response's lines. ARCGIS_REST: ``reader`` names a registered paged source.
    """
    o = source.options
    if source.method == "REST":
        reader = f"rest_{source.name.lower()}"
        spark.dataSource.register(rest_source(reader, o))
        return spark.read.format(reader).load()
    if source.method == "ARCGIS_REST":
        return spark.read.format(o["reader"]).load()
    if source.method == "S3":
        newest = readers.newest_file(spark, o["location"], o.get("contains", ""))
        if newest is None:
            raise FileNotFoundError(f"{source.name}: no file in {o['location']}")
        return FORMATS[source.file_format](spark, newest)
    if source.method == "OSM":
        return readers.read_osm_json(spark, o["location"])
    if source.method == "H3_HEX":
        (x1, y1), (x2, y2) = o["bounding_box"]
        return readers.grid_cells(spark, x1, y1, x2, y2, o["resolution"])
    raise ValueError(f"{source.name}: unknown method {source.method}")
