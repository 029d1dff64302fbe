"""Every layer's description reshapes a staged table; some against known rows."""

import re

import pytest
from pyspark.sql import functions as F

from waylake.functions.exprs import change_key
from waylake.sources.layers import LAYERS
from waylake.sources.readers import reshape


def columns_of(layer):
    """Columns that a staged table of the layer has."""
    words = lambda text: set(re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", "", text)))
    known = {"concat", "md5", "coalesce", "case", "when", "is", "not", "null", "or", "then", "end", "geometry", "_key"}
    found = set(layer.fields) - set(layer.values) | words(layer.name) | words(layer.key or "") | {w for v in layer.values.values() for w in words(v)} | set(layer.dedupe_by)
    return sorted(found - known)


@pytest.mark.parametrize("name", sorted(LAYERS))
def test_layer(spark, name):
    layer = LAYERS[name]
    columns = columns_of(layer)
    staged = spark.range(3).select(F.format_string("g%d", "id").alias("geometry"), *[F.concat(F.lit(f"{c} "), F.col("id").cast("string")).alias(c) for c in columns])
    features, attributes = reshape(staged, layer)
    assert features.count() == 3 == features.select("feature_id").distinct().count()
    assert attributes.count() == 3 * len(layer.fields)
    assert features.where(~F.col("feature_id").startswith(f"{name}&&")).count() == 0
    got = {(r["feature_id"], r["s_name"]): r["s_value"] for r in attributes.collect()}
    names = {r["feature_id"]: r["name"] for r in features.collect()}
    for (feature, field), value in got.items():
        if layer.named_values:
            assert value == names[feature]
        elif field not in layer.values:
            assert value.rsplit(" ", 1)[0] == field
    own = reshape(staged, layer, own_values=True)[1].where(~F.col("s_name").isin(*layer.values) if layer.values else F.lit(True))
    assert own.where(~F.col("s_value").startswith(F.col("s_name"))).count() == 0


def test_seed_file_rows(spark):
    fields = LAYERS["CUSTOM_SEED_FILE"]
    base = {c: None for c in columns_of(fields)} | {"geometry": "line 1"}
    rows = [base | {"DEC_NAME": "Old", "DEC_TYPE": "Road", "CLASSN": "LO", "DTP_REG_NAME": "North"}, base | {"DEC_NAME": "Main", "DEC_TYPE": "Street", "CLASSN": "LO"}, base | {"geometry": "line 2", "DEC_TYPE": "Lane"}]
    schema = ", ".join(f"{c} string" for c in base)
    features, attributes = reshape(spark.createDataFrame([tuple(r.values()) for r in rows], schema), fields)
    found = {r["name"]: r["feature_id"] for r in features.collect()}
    assert set(found) == {"Old Road", None} and all(v.startswith("CUSTOM_SEED_FILE&&_") for v in found.values())
    first = {r["s_name"]: r["s_value"] for r in attributes.where(F.col("feature_id") == found["Old Road"]).collect()}
    assert first == {"DEC_NAME": "Old", "DEC_TYPE": "Road", "CLASSN": "LO", "REGION_NAME": "North", "declared_road": "Old Road"}
    assert {r["s_value"] for r in attributes.where(F.col("feature_id") == found[None]).collect()} == {"Lane", " Lane"}
    key = features.select("join_key", change_key(F.col("name"), F.col("feature_id"), F.col("geometry")).alias("k")).collect()
    assert all(r["join_key"] == r["k"] for r in key)
