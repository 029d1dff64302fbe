"""Searches around nodes, parts of intersections and points along lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waylake.functions import geo
from waylake.functions.storage import materialise


def directed(edges: DataFrame, direction: str = "any") -> DataFrame:
    """(src, dst, km), the shortest of parallel edges, along the traffic, against it, or both ways."""
    ahead = edges.select("src", "dst", "km")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "km")
    chosen = {"forward": ahead, "backward": back, "any": ahead.unionByName(back)}[direction]
    return chosen.where("src != dst").groupBy("src", "dst").agg(F.min("km").alias("km"))


def nearby(edges: DataFrame, starts: DataFrame, targets: DataFrame, km: float = 0.02, direction: str = "any") -> DataFrame:
    """(start, node, km, path): targets within ``km`` along the graph, each with its shortest path.

    edges: src, dst, km; starts and targets: node. A start isn't its own target. Of equally long paths the
    smallest list of nodes is kept. Every round joins only the nodes whose path became shorter with the
    edges, so the work is bounded by what lies within ``km`` of the starts, and nothing is collected.
    """
    step = materialise(directed(edges, direction), "nearby-edges")
    zero = F.lit(0.0)
    settled = starts.select(F.col("node").alias("start"), "node", zero.alias("km"), F.array("node").alias("path")).distinct()
    front = settled
    while True:
        hop = front.join(step.select(F.col("src").alias("node"), "dst", F.col("km").alias("_hop")), "node")
        longer = hop.select("start", F.col("dst").alias("node"), (F.col("km") + F.col("_hop")).alias("km"), F.concat("path", F.array("dst")).alias("path")).where(F.col("km") <= km)
        best = longer.groupBy("start", "node").agg(F.min(F.struct("km", "path")).alias("new"))
        known = settled.groupBy("start", "node").agg(F.min(F.struct("km", "path")).alias("old"))
        front = materialise(
            best.join(known, ["start", "node"], "left").where("old is null or new < old").select("start", "node", "new.km", "new.path"), "nearby-front"
        )
        if front.isEmpty():
            break
        settled = settled.unionByName(front)  # only the newest paths are written
    best = settled.where("start != node").groupBy("start", "node").agg(F.min(F.struct("km", "path")).alias("b"))
    return best.join(targets.select("node").distinct(), "node", "left_semi").select("start", "node", "b.km", "b.path")


def neighbour_sets(edges: DataFrame) -> DataFrame:
    """(node, incoming, outgoing): the nodes before and after each node, in order."""
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("after"), F.lit(None).cast("long").alias("before")).unionByName(
        edges.select(F.col("dst").alias("node"), F.lit(None).cast("long").alias("after"), F.col("src").alias("before"))
    )
    return ends.groupBy("node").agg(F.array_sort(F.collect_set("before")).alias("incoming"), F.array_sort(F.collect_set("after")).alias("outgoing"))


def internal_ways(ways: DataFrame, members: DataFrame) -> DataFrame:
    """(group_id, way_id): ways whose nodes all belong to a group; ways: id, nodes; members: group_id, node."""
    parts = ways.select(F.col("id").alias("way_id"), F.size(F.array_distinct("nodes")).alias("_size"), F.explode(F.array_distinct("nodes")).alias("node"))
    inside = parts.join(members.select("group_id", "node").distinct(), "node").groupBy("group_id", "way_id", "_size").agg(F.count("*").alias("_n"))
    return inside.where("_n = _size").select("group_id", "way_id")


def way_tags_at(ways: DataFrame, name: str) -> DataFrame:
    """(node, way_id, value) of a tag of the ways through each node; ways: id, nodes, tags."""
    return ways.select(F.explode(F.array_distinct("nodes")).alias("node"), F.col("id").alias("way_id"), F.col("tags")[name].alias("value"))


def roundabout_nodes(ways: DataFrame) -> DataFrame:
    """(node, way_id) of nodes on a way tagged as a roundabout."""
    return way_tags_at(ways, "junction").where("value = 'roundabout'").select("node", "way_id")


def roundabout_groups(ways: DataFrame, centroids: DataFrame) -> DataFrame:
    """(node, cluster) of centroids that share a roundabout with another one, also over several ways."""
    from waylake.operators.graph import connected_components

    on = roundabout_nodes(ways).join(centroids.select("node").distinct(), "node", "left_semi")
    hub = on.groupBy("way_id").agg(F.min("node").alias("hub"))
    return connected_components(on.join(hub, "way_id").select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("component", "cluster")


def has_signal(tags: Column) -> Column:
    """Whether a node's tags name a traffic signal."""
    return F.coalesce((tags["highway"] == "traffic_signals") | F.map_contains_key(tags, "traffic_signals"), F.lit(False))


def nearest_arm(wanted: DataFrame, arms: DataFrame) -> DataFrame:
    """(request, node, arm): the arm whose heading from the centre turns least from the wanted angle.

    wanted: request, node, angle; arms: node (the centre), arm, heading. Ties go to the smallest arm.
    """
    off = geo.turn(F.col("heading"), F.col("angle"))
    best = wanted.join(arms, "node").groupBy("request", "node").agg(F.min(F.struct(off.alias("off"), F.col("arm"))).alias("b"))
    return best.select("request", "node", F.col("b.arm").alias("arm"))


def road_intersections(intersections: DataFrame) -> DataFrame:
    """(road, uids): intersections of each road; those without a name are under UNNAMED; uid, roads."""
    named = F.when(F.size("roads") > 0, F.col("roads")).otherwise(F.array(F.lit("UNNAMED")))
    each = intersections.select("uid", F.explode(F.array_distinct(named)).alias("road"))
    return each.groupBy("road").agg(F.array_sort(F.collect_set("uid")).alias("uids"))


def join_chains(a: Column, b: Column) -> Column:
    """Two chains as one over an end that they share, turned where needed; null if they share none.

    An end of ``a`` that comes first in ``a`` goes before its other end.
    """
    first, last = F.element_at(a, 1), F.element_at(a, -1)
    start, stop = F.element_at(b, 1), F.element_at(b, -1)
    rest = F.slice(b, F.lit(2), F.size(b) - 1)
    turned = F.slice(F.reverse(b), F.lit(2), F.size(b) - 1)
    at_first = F.when(start == first, rest).when(stop == first, turned)
    at_last = F.when(start == last, rest).when(stop == last, turned)
    return F.coalesce(F.concat(F.reverse(a), at_first), F.concat(a, at_last))


def longest_first(lines: Column) -> Column:
    """A list of lines by length in km, longest first; ties keep their order."""
    keyed = F.transform(lines, lambda line, i: F.struct((-geo.length_km(line)).alias("k"), i.alias("i"), line.alias("line")))
    return F.transform(F.array_sort(keyed), lambda s: s["line"])


def along(line: Column, interval: Column | float | None = None, parts: int | None = None, least: float | None = None, end: bool = True) -> Column:
    """Points at even distances along a line, the first point included.

    Every ``interval`` km, or in ``parts`` equal parts that are at least ``least`` km long. The last point of
    the line is added where ``end`` is set; equal parts without ``least`` end there anyway. A line of one
    point gives that point, once.
    """
    exact = parts is not None and least is None
    km = lambda s: geo.haversine_km(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])
    measured = F.filter(F.transform(geo.steps(line), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), km(s).alias("km"))), lambda s: s["km"] > 0)
    none = F.array().cast(geo.LINE)

    def spread(steps: Column, gap: Column) -> Column:
        """Each step adds the multiples of the gap that it reaches."""

        def add(t: Column, s: Column) -> Column:
            low, high = F.floor(t["at"] / gap), F.floor((t["at"] + s["km"]) / gap)

            def place(i: Column) -> Column:
                part = F.least((i * gap - t["at"]) / s["km"], F.lit(1.0))
                return F.struct(geo.lerp(s["a"]["x"], s["b"]["x"], part).alias("x"), geo.lerp(s["a"]["y"], s["b"]["y"], part).alias("y"))

            new = F.when(high > low, F.transform(F.sequence(low + 1, high), place)).otherwise(none)
            return F.struct((t["at"] + s["km"]).alias("at"), F.concat(t["points"], new).alias("points"))

        return F.aggregate(steps, F.struct(F.lit(0.0).alias("at"), none.alias("points")), add)["points"]

    def width(steps: Column) -> Column:
        if parts is None:
            return F.lit(interval) if not isinstance(interval, Column) else interval
        equal = F.aggregate(steps, F.lit(0.0), lambda t, s: t + s["km"]) / parts
        return equal if least is None else F.greatest(equal, F.lit(least))

    # a list of one binds a value to a name, so that it is computed once per line
    inner = F.get(F.transform(F.array(measured), lambda steps: F.get(F.transform(F.array(width(steps)), lambda gap: spread(steps, gap)), 0)), 0)
    tail = F.when(F.size(line) > 1, F.slice(line, -1, 1)).otherwise(none)
    if exact:  # the last of the parts ends at the line's end, whatever the rounding
        found = F.concat(F.slice(line, 1, 1), F.when(F.size(measured) > 0, F.concat(F.slice(inner, 1, parts - 1), tail)).otherwise(none))
    else:
        found = F.concat(F.slice(line, 1, 1), inner, tail if end else none)
    return F.when(F.size(line) > 0, found)
