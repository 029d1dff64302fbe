"""Tables with constraints, scripts, sources by method, messages and time zones, on small rows with known results."""

import pytest
from pyspark.sql import functions as F

from waylake.functions import text
from waylake.operators import loads, store
from waylake.operators.store import ColumnSpec
from waylake.sources import config
from waylake.streaming import channels, windows


def test_table_with_constraints(spark):
    columns = [ColumnSpec("id", "long", primary_key=True), ColumnSpec("part", "int", primary_key=True), ColumnSpec("kind", "string", check="kind != 'it''s'"), ColumnSpec("code", "string", unique=True)]
    store.drop_table(spark, "kept_rows")
    store.create_table(spark, "kept_rows", columns)
    store.create_table(spark, "kept_rows", columns[:1])  # exists already
    assert store.specs(spark, "kept_rows") == columns
    frame = lambda *rows: spark.createDataFrame(rows, "id long, part int, kind string, code string")
    store.append(frame((1, 1, "a", "x"), (1, 2, None, None), (2, 1, "b", None)), "kept_rows")
    for bad in ((1, 1, "a", "y"), (3, None, "a", "y"), (3, 1, "it's", "y"), (3, 1, "a", "x")):
        with pytest.raises(ValueError):
            store.append(frame(bad), "kept_rows")
    assert spark.table("kept_rows").count() == 3
    assert {tuple(r) for r in store.violations(frame((1, 1, "a", "x"), (1, 1, "a", "x"), (1, 1, "it's", None)), columns).collect()} == {("key id, part", 2), ("unique code", 1), ("check kind", 1)}
    assert store.violations(frame(), columns).count() == 0 and store.violations(frame((1, 1, "a", "x")), []).count() == 0
    store.drop_table(spark, "kept_rows")
    assert not spark.catalog.tableExists("kept_rows")
    with pytest.raises(ValueError):
        store.describe(spark, "kept_rows")
    with pytest.raises(ValueError):
        store.create_table(spark, "kept_rows", [ColumnSpec("a", "int"), ColumnSpec("A", "int")])


def test_script(spark):
    got = store.run_script(spark, "-- a; b\nSELECT 1 AS x;\nSELECT ';' AS a, \"--;\" AS b, :n AS n -- end;\n;\n-- last", {"n": 3})
    assert [tuple(r) for r in got.collect()] == [(";", "--;", 3)]
    assert store.run_script(spark, " ; -- nothing") is None


def test_view_is_refreshed(spark):
    store.refresh_view(spark.range(3), "seen")
    before = spark.table("seen")
    store.refresh_view(spark.table("seen").where("id > 0"), "seen")
    assert (before.count(), spark.table("seen").count()) == (3, 2)


CONFIG = """{"roads": {"method": "rest", "options": {"url": "u", "headers": {"key": "{ROAD_KEY}", "other": "a {ROAD_KEY}", "none": "{NOT_SET}"}}, "prerequisites": ["names"]},
"names": {"method": "s3", "file_format": "csv"}, "all": {"method": "osm", "prerequisites": ["roads", "names"]}, "a": {"method": "osm", "prerequisites": ["b"]}, "b": {"method": "osm", "prerequisites": ["a"]}}"""


def test_source_configs(spark, tmp_path):
    found = config.load_configs(CONFIG, {"ROAD_KEY": "secret"})
    assert found["ROADS"].options["headers"] == {"key": "secret", "other": "a {ROAD_KEY}", "none": "{NOT_SET}"}
    assert config.in_order(found, ["all", "roads"]) == ["NAMES", "ROADS", "ALL"]
    assert config.in_order(found, ["all"], {"NAMES"}) == ["ROADS", "ALL"]
    with pytest.raises(ValueError):
        config.in_order(found, ["a"])
    for day, value in (("01", "old"), ("02", "new")):
        (tmp_path / f"names_2024{day}.csv").write_text(f"name\n{value}\n")
    found["NAMES"].options = {"location": str(tmp_path), "contains": "names"}
    assert config.read_source(spark, found["NAMES"]).collect()[0]["name"] == "new"
    with pytest.raises(FileNotFoundError):
        config.read_source(spark, config.SourceConfig("N", "S3", options={"location": str(tmp_path), "contains": "none"}))
    with pytest.raises(ValueError):
        config.read_source(spark, config.SourceConfig("N", "FTP"))
    cells = config.SourceConfig("H", "H3_HEX", options={"bounding_box": [[144, -38], [146, -37]], "resolution": 8})
    assert config.read_source(spark, cells).count() > 0


def test_rest_source(spark, tmp_path):
    page = tmp_path / "page.csv"
    page.write_text("a,b\n1,2\n")
    source = config.SourceConfig("PAGE", "REST", options={"url": f"file://{page}"})
    assert [r["value"] for r in config.read_source(spark, source).collect()] == ["a,b", "1,2"]
    tries = []

    def failing(request):
        tries.append(request.full_url)
        raise OSError("down")

    with pytest.raises(OSError):
        list(config.http_get("http://example.invalid/", {}, tries=3, wait=0, open_url=failing))
    assert len(tries) == 3


def test_channels(spark, tmp_path):
    frame = spark.createDataFrame([("a.b", "1"), ("axb", "2"), ("road_1", "3"), (None, "4")], channels.MESSAGE)
    chosen = lambda names: {r["message"] for r in frame.where(channels.on_channels(names)).collect()}
    assert chosen(["a.b"]) == {"1"} and chosen(["a?b", "r*"]) == {"1", "2", "3"} and chosen(["*"]) == {"1", "2", "3"} and chosen([]) == set()
    path = str(tmp_path / "m")
    channels.publish(frame, path)
    failed = []

    def handle(batch, number):
        raise RuntimeError(f"{batch.count()} rows")

    channels.subscribe(windows.file_stream(spark, path, channels.MESSAGE, 100), ["*b"], handle, failed.append, once=True)()
    assert [str(e) for e in failed] == ["2 rows"]
    stop = channels.subscribe(windows.file_stream(spark, path, channels.MESSAGE), ["none"], lambda batch, number: None)
    stop()
    assert not spark.streams.active


def test_metrics_take_ties_and_nulls(spark):
    rows = [("a", 1, 1, 5), ("a", 2, 2, -3), ("a", 2, 3, 7), ("a", 3, 4, None), ("b", 1, 5, None)]
    got = channels.metrics(spark.createDataFrame(rows, "k string, ts long, id long, v long"), ["k"], "v", tie="id")
    # max_by takes the row of the latest event, whose value is null here
    assert {tuple(r) for r in got.collect()} == {("a", 3, 12, None), ("b", 0, 0, None)}


def test_time_zones(spark):
    with text.session_zone(spark, "Asia/Tokyo"):
        shown = spark.range(1).select(F.date_format(text.clock_time(F.lit(1720000000), "Australia/Melbourne"), "HH:mm").alias("t"), F.date_format(F.timestamp_seconds(F.lit(0)), "HH").alias("h")).first()
        assert tuple(shown) == ("19:46", "09")
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    with pytest.raises(ZeroDivisionError), text.session_zone(spark, "Asia/Tokyo"):
        1 / 0
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.range(1).select(text.epoch_now().alias("e")).first()["e"] > 1_700_000_000
    assert len(loads.PROTECTED_NAMES) == len(set(loads.PROTECTED_NAMES)) == 35


def test_clock_text_in_far_years(spark):
    shown = spark.createDataFrame([(0,), (1_700_000_000 + 2_912_811 * 86_413,), (1_700_000_000 + 54_000_000 * 86_413,)], "e long").select(text.clock_text(F.col("e"), "UTC").alias("t"))
    assert [r["t"] for r in shown.collect()] == ["1970-01-01 00:00:00", "10000-01-29 04:42:23", "149893-02-03 22:13:20"]
