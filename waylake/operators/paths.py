"""Tables of vehicles' paths: steps, segment ids, distances to intersections, corrections, priorities.

Paths are ``path_id`` and ``nodes`` in travel order. A distance table holds the length of a path up to the first node of
an intersection that it reaches; pairs that never meet are left out of the table and count as ``NEVER`` where a minimum
or a difference needs a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from waylake.functions.storage import materialise
from waylake.operators.eav import surrogate_ids

# fixed values: the length that stands for an intersection that a path never reaches, and the priority of a path that
# passes an intersection without a known movement
NEVER = 1.0e8
UNKNOWN_PRIORITY = -9
#: Added to every correction, so that none is zero.
LEAST_CORRECTION = 0.0001


def path_steps(paths: DataFrame) -> DataFrame:
    """(path_id, seq, src, dst) for every step of every path."""
    n = F.size("nodes")
    pair = F.zip_with(F.slice("nodes", F.lit(1), n - 1), F.slice("nodes", F.lit(2), n - 1), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    return paths.where(n > 1).select("path_id", F.posexplode(pair).alias("seq", "e")).select("path_id", "seq", "e.src", "e.dst")


def one_way_per_step(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst): of parallel ways the shortest, then the one with the smallest id."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    best = F.min_by(F.struct(*rest), F.struct("km", "way_id"))
    return edges.groupBy("src", "dst").agg(best.alias("_e")).select("src", "dst", *[F.col(f"_e.{c}").alias(c) for c in rest])


def lanes_ahead() -> Column:
    """Lanes of one direction, of edges with lanes and oneway."""
    two_way = F.greatest(F.lit(1), F.floor(F.floor("lanes") / 2))
    return F.when(F.col("lanes").isNull(), 1).when(F.coalesce("oneway", F.lit(True)), F.floor("lanes")).otherwise(two_way).cast("int")


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, seq, src, dst, way_id, km, speed_ms, lanes): one row per step.

    edges: src, dst, way_id, km, maxspeed (km/h), lanes, oneway. Lanes of two-way roads are halved, one at least; without
    lanes there is one. A step that has no edge keeps its row, with nulls: ``missing_steps`` lists them.
    """
    found = path_steps(paths).join(one_way_per_step(edges), ["src", "dst"], "left")
    lanes = F.when(F.col("way_id").isNotNull(), lanes_ahead())
    return found.select("path_id", "seq", "src", "dst", "way_id", "km", (F.col("maxspeed") / 3.6).alias("speed_ms"), lanes.alias("lanes"))


def missing_steps(path_rows: DataFrame) -> DataFrame:
    """Steps of path_edges() that no edge allows."""
    return path_rows.where("way_id is null").select("path_id", "seq", "src", "dst")


def segment_ids(edges: DataFrame) -> DataFrame:
    """(seg_id, src, dst, lanes): segments are the different (src, dst) in order, numbered from 1."""
    each = one_way_per_step(edges).select("src", "dst", lanes_ahead().alias("lanes"))
    return surrogate_ids(each, ["src", "dst"], "seg_id").select("seg_id", "src", "dst", "lanes")


def distances(path_rows: DataFrame, intersections: DataFrame) -> DataFrame:
    """(path_id, intersection, node_seq, km): the way of each path to the intersections that it reaches.

    path_rows: path_id, seq, dst, km; intersections: node, intersection. The start of a path doesn't count, and of several
    nodes of one intersection the first one does.
    """
    so_far = F.sum("km").over(W.partitionBy("path_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    at = path_rows.select("path_id", (F.col("seq") + 1).alias("node_seq"), F.col("dst").alias("node"), so_far.alias("km")).join(intersections, "node")
    # few bytes, and much is joined to them in the same tasks: as many as the session asks for, not merged by size
    tasks = int(path_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = at.select("path_id", "intersection", "node_seq", "km").repartition(tasks, "path_id", "intersection")
    return dealt.groupBy("path_id", "intersection").agg(F.min("node_seq").alias("node_seq"), F.min_by("km", "node_seq").alias("km"))


def watched(path_rows: DataFrame, distance: DataFrame) -> DataFrame:
    """``path_rows`` with ``watches``: the intersection that the path reaches next; null after the last one."""
    arrivals = distance.groupBy("path_id", (F.col("node_seq") - 1).alias("seq")).agg(F.max("intersection").alias("_here"))
    ahead = W.partitionBy("path_id").orderBy("seq").rowsBetween(0, W.unboundedFollowing)
    rows = path_rows.join(arrivals, ["path_id", "seq"], "left")
    return rows.withColumn("watches", F.first("_here", ignorenulls=True).over(ahead)).drop("_here")


def segment_watches(watched_rows: DataFrame, segments: DataFrame, default: int = 1) -> DataFrame:
    """(seg_id, intersection): what traffic on each segment watches: of paths that differ, the last one's; else ``default``."""
    last = watched_rows.where("watches is not null").groupBy("src", "dst").agg(F.max_by("watches", F.struct("path_id", "seq")).alias("w"))
    return segments.join(last, ["src", "dst"], "left").select("seg_id", F.coalesce("w", F.lit(default)).alias("intersection"))


def corrections(path_rows: DataFrame, segments: DataFrame, watches: DataFrame, distance: DataFrame) -> DataFrame:
    """(path_id, seg_id, correction): how much longer a path's way to the intersection that the segment watches is than
    the shortest of all paths, summed where a path takes a segment more than once.

    The shortest is over all paths, so it is NEVER only for an intersection that no path reaches.
    """
    reach = distance.groupBy("intersection").agg(F.min("km").alias("least"))
    at = path_rows.join(segments.select("src", "dst", "seg_id"), ["src", "dst"]).select("path_id", "seg_id").join(watches, "seg_id")
    own = distance.select("path_id", "intersection", F.col("km").alias("own"))
    # an intersection that all paths but some reach has no NEVER as its minimum, and one that no path reaches only that
    both = at.join(own, ["path_id", "intersection"], "left").join(reach, "intersection", "left")
    x = F.coalesce("own", F.lit(NEVER)) - F.coalesce("least", F.lit(NEVER)) + LEAST_CORRECTION
    return both.groupBy("path_id", "seg_id").agg(F.sum(x).alias("correction"))


def priorities(paths: DataFrame, distance: DataFrame, movements: DataFrame, centroids: DataFrame) -> DataFrame:
    """(path_id, intersection, priority) for every intersection that a path reaches.

    movements: intersection, in_node, out_node, priority; centroids: node, intersection. A path enters at its first node
    that is an in_node, and leaves at the first later node that a movement from there leads to and that isn't a centroid;
    an in_node without such a node is passed over. 0 (ignore) if fewer than three nodes are left where it enters, or if the
    path stands still before (its end); -9 if it never enters.
    """
    nodes = paths.select("path_id", F.size("nodes").alias("n"), F.posexplode("nodes").alias("i", "node"))
    order = W.partitionBy("path_id").orderBy("i")
    stops = nodes.withColumn("_next", F.lead("node").over(order)).where("_next = node and i > 0")
    stops = stops.groupBy("path_id").agg(F.min("i").alias("stop"))
    # both are read more than once; written, they also keep all these joins from standing in one task, each with memory of its own
    # rows per path aren't broadcast either: they are far more than their bytes on disk make Spark expect
    reached = materialise(distance.select("path_id", "intersection"), "reached").hint("merge")
    enters = movements.select("intersection", F.col("in_node").alias("node")).distinct()
    entries = materialise(nodes.where("i < n - 1").hint("merge").join(enters, "node").join(reached, ["path_id", "intersection"]), "entries")
    exits = movements.join(centroids.select("intersection", F.col("node").alias("out_node")).distinct(), ["intersection", "out_node"], "left_anti")
    later = nodes.select("path_id", F.col("i").alias("o"), F.col("node").alias("out_node")).hint("merge")
    # movements lead on from an entry to few nodes; those are looked for on the path
    moves = entries.where("i < n - 3").join(exits.withColumnRenamed("in_node", "node"), ["intersection", "node"])
    left = moves.join(later, ["path_id", "out_node"]).where("o > i").groupBy("path_id", "intersection", "i").agg(F.min_by("priority", "o").alias("priority"))
    ends = entries.where("i >= n - 3").select("path_id", "intersection", "i", F.lit(0).alias("priority"))
    first = left.select("path_id", "intersection", "i", F.col("priority").cast("int")).union(ends).groupBy("path_id", "intersection").agg(F.min_by("priority", "i").alias("p"), F.min("i").alias("i"))
    rows = reached.join(first.hint("merge"), ["path_id", "intersection"], "left").join(stops.hint("merge"), "path_id", "left")
    p = F.when(F.col("stop").isNotNull() & (F.col("i").isNull() | (F.col("stop") <= F.col("i"))), 0).otherwise(F.coalesce("p", F.lit(UNKNOWN_PRIORITY)))
    return rows.select("path_id", "intersection", F.least(F.greatest(p, F.lit(-9)), F.lit(9)).alias("priority"))
