"""Text helpers, relationships, export documents."""

import json

from pyspark.sql import functions as F

from waylake.functions import geo, text
from waylake.operators import eav, export, relationships


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_names(spark):
    assert one(spark, text.snake_case(F.col("a")), a="featureTypeCode2X") == "feature_type_code2_x"
    assert one(spark, text.camel_case(F.col("a")), a="feature_type_code") == "featureTypeCode"
    assert list(one(spark, text.options_list(F.col("a")), a="{a, b c}")) == ["a", "b c"]
    kinds = [one(spark, text.number_or_text(F.col("a")), a=v).asDict() for v in ("12", "1.5", "x")]
    assert kinds == [{"i": 12, "d": None, "s": None}, {"i": None, "d": 1.5, "s": None}, {"i": None, "d": None, "s": "x"}]


def test_packed_numbers(spark):
    values = [1, -1, 0, 2**40, -(2**60)]
    df = spark.createDataFrame([(values,), ([],)], "v array<bigint>")
    assert [list(r[0]) for r in df.select(text.unpacked_numbers(text.packed_numbers(F.col("v")))).collect()] == [values, []]


def test_maps(spark):
    df = spark.createDataFrame([({"k": "1", "a": "x"}, {"k": "1", "b": "y"}), ({"k": "1"}, {"k": "2"})], "a map<string,string>, b map<string,string>")
    got = [dict(r[0]) for r in df.select(text.merged_when_equal(F.col("a"), F.col("b"), "k")).collect()]
    assert got == [{"k": "1", "a": "x", "b": "y"}, {"k": "1"}]
    assert dict(df.select(text.without_keys(F.col("a"), "k")).first()[0]) == {"a": "x"}


def test_clip():
    way = [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 0.0)]
    assert relationships.clipped([(0.5, 0.1), (2.4, 0.1)], way) == [(0.5, 0.0), (1.0, 0.0), (2.0, 0.0), (2.4, 0.0)]
    assert relationships.clipped([(2.4, 0.1), (0.5, 0.1)], way) == [(2.4, 0.0), (2.0, 0.0), (1.0, 0.0), (0.5, 0.0)]
    assert len(set(relationships.nearest_ends([(1.0, 0.1), (1.01, 0.1)], way))) == 2


def test_relationship_edits(spark):
    rel = spark.createDataFrame([("a", ["w1"], 1), ("b", ["w2"], 2)], "input_id string, matched array<string>, changeset_id int")
    edits = spark.createDataFrame([("a", ["w3"]), ("b", ["w4"]), ("c", ["w5"])], "input_id string, matched array<string>")
    assert {r["input_id"]: r["action"] for r in relationships.edit_relationships(rel, edits, 2).collect()} == {"a": "NEW_VERSION", "b": "UPDATE", "c": "NEW"}
    gone = relationships.detach_removed(rel, spark.createDataFrame([("a",)], "id string"))
    assert {r["input_id"]: r["matched"] for r in gone.collect()} == {"a": None, "b": ["w2"]}


def test_export(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 144.96, -37.81)], "id long, x double, y double")
    ways = spark.createDataFrame([(2, None, [1, 3], "m", {"a": "b"}), (3, 2, None, None, None)], "id long, parent_id long, nodes array<long>, matched_id string, tags map<string,string>")
    elements = export.node_elements(nodes).unionByName(export.way_elements(ways))
    found = [json.loads(r["element"]) for r in elements.collect()]
    assert found[0] == {"id": 1, "type": "node", "manual_edit": False, "lon": 144.96, "lat": -37.81}
    assert found[1] == {"id": 2, "way_id": 2, "type": "way", "manual_edit": False, "nodes": [1, 3], "source_matched_id": "m", "tags": {"a": "b"}} and len(found) == 2
    export.write_document(elements, str(tmp_path / "doc"), export.header(None, 7, "2024-01-01"))
    assert spark.read.text(str(tmp_path / "doc" / "elements")).count() == 2
    line = spark.createDataFrame([([(144.0, -37.0), (145.0, -38.0)],)], f"line {geo.LINE}")
    feature = json.loads(line.select(export.line_feature(F.lit("x"), F.col("line"), F.struct(F.lit(1).alias("n")))).first()[0])
    assert feature["geometry"] == {"type": "LineString", "coordinates": [[144.0, -37.0], [145.0, -38.0]]}


def test_surrogate_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = {r["k"]: r["n"] for r in eav.surrogate_ids(df, ["k"], "n", after=10).collect()}
    assert got == {k: k + 11 for k in range(1000)}


def test_publish_document(spark, tmp_path):
    base = str(tmp_path / "out")
    for day, ids in (("2024/01/01", ["a"]), ("2024/01/02", ["b", "c"])):
        export.publish_document(spark.createDataFrame([(i,) for i in ids], "element string"), base, day, day)
    read = lambda at: {r[0] for r in spark.read.text(f"{base}/{at}").collect()}
    assert read("latest/elements") == read("2024/01/02/elements") == {"b", "c"}
    assert read("latest/header") == {"2024/01/02"} and read("2024/01/01/elements") == {"a"}
