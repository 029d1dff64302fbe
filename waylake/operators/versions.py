"""Versioned-table operators: classify, upsert, publish, as-of, invalidate, edit.

Rows carry ``version_start`` (null while pending) and ``version_end`` (inclusive, null while current).
A removal is a row with start = end: a tombstone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def classify(latest: DataFrame, incoming: DataFrame, ids: list[str], key: str, keep_same: bool = False) -> DataFrame:
    """ADDED / MODIFIED / REMOVED (and SAME) by one full outer join on the ids.

    ``key`` is the change key. Rows whose key is null in the latest snapshot count as absent.
    Returns the ids, ``status``, ``old_key`` and ``new_key``.
    """
    old = latest.where(F.col(key).isNotNull()).select(*ids, F.col(key).alias("old_key"))
    new = incoming.select(*ids, F.col(key).alias("new_key"), F.lit(True).alias("_in"))
    joined = old.join(new, ids, "full_outer")
    status = (
        F.when(F.col("old_key").isNull(), "ADDED")
        .when(F.col("_in").isNull(), "REMOVED")
        .when(F.col("old_key") != F.col("new_key"), "MODIFIED")
        .otherwise("SAME")
    )
    out = joined.select(*ids, status.alias("status"), "old_key", "new_key")
    return out if keep_same else out.where("status != 'SAME'")


def roll_up(features: DataFrame, attribute_changes: DataFrame, key: str = "id") -> DataFrame:
    """Features whose attributes changed become MODIFIED unless they have a status of their own (V3)."""
    touched = attribute_changes.select(key).distinct().withColumn("_touched", F.lit(True))
    return features.join(touched, key, "full_outer").select(key, F.coalesce("status", F.lit("MODIFIED")).alias("status"))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: bool = True) -> DataFrame:
    """Merge on the keys: source rows win, or target rows where ``update`` is false."""
    winner, other = (source, target) if update else (target, source)
    return other.join(winner.select(*keys), list(keys), "left_anti").unionByName(winner)


def delete_returning(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted); rows for which the condition is unknown are kept."""
    hit = F.coalesce(condition, F.lit(False))
    return df.where(~hit), df.where(hit)


def version_text(major: Column, minor: Column) -> Column:
    return F.concat_ws(".", major.cast("string"), minor.cast("string"))


def next_version(current: Column, source_update: Column) -> Column:
    """The layer version after ``current`` ('2.3'): a source update raises the major number, an edit the
    minor one; the first version is 1.0 (V4)."""
    major = F.split_part(current, F.lit("."), F.lit(1)).cast("int")
    minor = F.split_part(current, F.lit("."), F.lit(2)).cast("int")
    raised = F.when(source_update, version_text(major + 1, F.lit(0))).otherwise(version_text(major, minor + 1))
    return F.when(current.isNull(), F.lit("1.0")).otherwise(raised)


def newest_version(df: DataFrame, by: Sequence[str], version: str = "version") -> DataFrame:
    """The highest dotted version per group, compared as numbers: '10.0' is above '9.0' (L2)."""
    parts = F.transform(F.split(F.col(version), r"\."), lambda x: x.cast("int"))
    return df.groupBy(*by).agg(F.max_by(version, parts).alias(version))


def publish(rows: DataFrame, changes: DataFrame, version: int, key: str = "id") -> DataFrame:
    """Publish pending changes at a version (V6, V7).

    ``changes`` has the key, ``status`` and the payload columns of ``rows``. Current rows with a changed
    key end at version - 1; added and modified rows start at the version; removed ones become tombstones.
    """
    ids = changes.select(key).distinct().withColumn("_hit", F.lit(True))
    current = F.col("version_start").isNotNull() & F.col("version_end").isNull()
    closed = rows.join(ids, key, "left").withColumn(
        "version_end", F.when(current & F.col("_hit"), F.lit(version - 1)).otherwise(F.col("version_end"))
    )
    opened = changes.withColumn("version_start", F.lit(version)).withColumn(
        "version_end", F.when(F.col("status") == "REMOVED", F.lit(version))
    )
    return closed.select(*rows.columns).unionByName(opened.select(*rows.columns))


def as_of(rows: DataFrame, version: int) -> DataFrame:
    """The rows that hold at a version: inclusive end, no pending rows, no tombstones."""
    start, end = F.col("version_start"), F.col("version_end")
    tombstone = F.coalesce(start == end, F.lit(False)) & (F.col("status") == "REMOVED")
    return rows.where((start <= version) & (end.isNull() | (end >= version)) & ~tombstone)


def invalidate(rows: DataFrame, version: int) -> DataFrame:
    """End all current rows that don't start at the version."""
    stale = (F.col("version_start") != version) & F.col("version_end").isNull()
    return rows.withColumn("version_end", F.when(stale, F.lit(version - 1)).otherwise(F.col("version_end")))


def is_latest() -> Column:
    return F.col("version_start").isNotNull() & F.col("version_end").isNull()


def set_status(changesets: DataFrame, moves: dict[str, str], layer: str | None = None) -> DataFrame:
    """Move changesets of a layer (or all) from one status to the next."""
    status = F.col("status")
    moved = status
    for old, new in moves.items():
        moved = F.when(status == old, F.lit(new)).otherwise(moved)
    if layer is not None:
        moved = F.when(F.col("layer_id") == layer, moved).otherwise(status)
    return changesets.withColumn("status", moved)


def blocked(changesets: DataFrame, layer: str, whole_graph: str = "OSM") -> DataFrame:
    """Open changesets that keep a layer from opening one; the graph layer is blocked by any (V5)."""
    open_ = F.col("status").isin("PROCESSING", "PENDING", "APPROVING", "IN_PROGRESS")
    same = F.lit(True) if layer == whole_graph else F.col("layer_id") == layer
    return changesets.where(open_ & same)


def reject(features: DataFrame, ids: DataFrame, key: str = "id", rejected: bool = True) -> DataFrame:
    """Mark features of a changeset as rejected, or take the mark back (V9)."""
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return (
        features.join(hit, key, "left")
        .withColumn("rejected", F.when(F.col("_hit"), F.lit(rejected)).otherwise(F.col("rejected")))
        .select(*features.columns)
    )


def edit_attributes(attributes: DataFrame, edits: DataFrame, options: DataFrame, changeset: int) -> DataFrame:
    """What each edit (feature_id, s_name, s_value) does to the attributes.

    An edit is INVALID if the name's options exclude the value, UPDATE if the row is already part of the
    changeset, NEW if the attribute never existed, NEW_VERSION if an older version holds it, and NONE if
    the value is the current one.
    """
    keys = ["feature_id", "s_name"]
    mine = attributes.where(F.col("changeset_id") == changeset).select(*keys, F.lit(True).alias("_mine")).distinct()
    current = attributes.where(is_latest()).select(*keys, F.col("s_value").alias("old_value"), F.lit(True).alias("_old"))
    allowed = options.select("s_name", "options")
    wide = edits.join(mine, keys, "left").join(current, keys, "left").join(allowed, "s_name", "left")
    valid = F.col("options").isNull() | F.array_contains("options", F.col("s_value"))
    action = (
        F.when(~valid, "INVALID")
        .when(F.col("_mine"), "UPDATE")
        .when(F.col("_old").isNull(), "NEW")
        .when(F.col("old_value").eqNullSafe(F.col("s_value")), "NONE")
        .otherwise("NEW_VERSION")
    )
    return wide.select(*keys, "s_value", "old_value", action.alias("action"))


def one_per_key(edits: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """The last edit of each key by ``order``; without an order a key with several edits is an error."""
    rest = [c for c in edits.columns if c not in keys]
    if order is not None:
        last = F.max_by(F.struct(*rest), F.struct(order, *[F.col(c).cast("string") for c in rest])).alias("_e")
        return edits.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_e.{c}").alias(c) for c in rest])
    n = F.count("*").over(W.partitionBy(*keys))
    several = F.raise_error(F.concat(F.lit("several edits of one key: "), F.to_json(F.struct(*keys))))
    return edits.withColumn("_n", n).where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(several.cast("boolean"))).drop("_n")


def apply_edits(rows: DataFrame, decided: DataFrame, keys: Sequence[str], values: Sequence[str], changeset: int, order: str | None = None) -> DataFrame:
    """The table after a batch of decided edits (V10, V11); decided: keys, values, action. Of several edits of a key the last
    by ``order`` counts; without an order they are an error.

    UPDATE changes the values of the changeset's own rows; NEW and NEW_VERSION add a pending row each,
    whose other columns are null; INVALID and NONE change nothing.
    """
    decided = one_per_key(decided, keys, order)
    new = F.struct(*values).alias("_new")
    updates = decided.where("action = 'UPDATE'").select(*keys, F.lit(changeset).alias("changeset_id"), new)
    joined = rows.join(updates, [*keys, "changeset_id"], "left")
    changed = joined.withColumns({v: F.when(F.col("_new").isNotNull(), F.col("_new")[v]).otherwise(F.col(v)) for v in values}).select(*rows.columns)
    added = decided.where("action in ('NEW', 'NEW_VERSION')").select(*keys, *values, F.lit(changeset).cast(rows.schema["changeset_id"].dataType).alias("changeset_id"))
    return changed.unionByName(added, allowMissingColumns=True)


def inherit(relationships: DataFrame, attributes: DataFrame, matched: str = "matched", names: Sequence[str] | None = None) -> DataFrame:
    """Attributes of input features on every way that they matched: (feature_id, s_name, s_value)."""
    exploded = relationships.select("input_id", F.explode(matched).alias("feature_id"))
    chosen = attributes if names is None else attributes.where(F.col("s_name").isin(*names))
    joined = exploded.join(chosen.withColumnRenamed("feature_id", "input_id"), "input_id")
    # several inputs may match a way: the largest value wins, whatever the order of rows
    return joined.groupBy("feature_id", "s_name").agg(F.max("s_value").alias("s_value"))


def copy_unsplit(ways: DataFrame, split_ids: DataFrame, key: str = "id") -> DataFrame:
    """Ways that were not split go to the derived layer as they are."""
    return ways.join(split_ids.select(key).distinct(), key, "left_anti").withColumn("parent_id", F.col(key))
