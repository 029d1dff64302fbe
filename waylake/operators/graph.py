"""Graph operators on edge tables: components, neighbourhoods, path tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from waylake.functions.storage import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label the nodes of an undirected graph with the smallest node of their component.

    Every round hooks each node to its smallest smaller neighbour, follows the hooks to their
    roots by pointer jumping, and contracts the graph to the roots, so the edges shrink from
    round to round; nothing is collected. Null ends and loops are ignored.
    Returns (node, component) for nodes that have an edge.
    """
    e = materialise(_ordered(edges.select(F.col(a).alias("x"), F.col(b).alias("y"))), "cc-edges")
    labels = None
    while not e.isEmpty():
        hook = _flattened(e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent")))
        if labels is None:
            nodes = e.select(F.col("lo").alias("node")).union(e.select(F.col("hi").alias("node"))).distinct()
            labels = nodes.withColumn("component", F.col("node"))
        labels = materialise(
            labels.join(hook.select(F.col("node").alias("component"), "parent"), "component", "left").select(
                "node", F.coalesce("parent", "component").alias("component")
            ),
            "cc-labels",
        )
        lo = hook.select(F.col("node").alias("lo"), F.col("parent").alias("plo"))
        hi = hook.select(F.col("node").alias("hi"), F.col("parent").alias("phi"))
        contracted = (
            e.join(lo, "lo", "left")
            .join(hi, "hi", "left")
            .select(F.coalesce("plo", "lo").alias("x"), F.coalesce("phi", "hi").alias("y"))
        )
        e = materialise(_ordered(contracted), "cc-edges")
    if labels is None:
        return e.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return labels


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct (lo, hi) without loops and nulls, from (x, y)."""
    return pairs.where("x != y").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct()


def _flattened(hook: DataFrame) -> DataFrame:
    """(node, root) from (node, parent), by pointer jumping until no parent is hooked itself."""
    while True:
        up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = materialise(
            hook.join(up, "parent", "left").select(
                "node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")
            ),
            "cc-hook",
        )
        hook = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return hook


def road_edges(ways: DataFrame) -> DataFrame:
    """(src, dst, way_id, seq) in every allowed direction; ways: id, nodes, oneway, reverseway."""
    pair = F.zip_with(
        F.slice("nodes", F.lit(1), F.size("nodes") - 1), F.slice("nodes", F.lit(2), F.size("nodes") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )
    e = ways.where(F.size("nodes") > 1).select(F.col("id").alias("way_id"), "oneway", "reverseway", F.posexplode(pair).alias("seq", "p"))
    ahead = e.where("not (oneway and reverseway) and not reverseway").select(F.col("p.a").alias("src"), F.col("p.b").alias("dst"), "way_id", "seq")
    back = e.where("reverseway or not oneway").select(F.col("p.b").alias("src"), F.col("p.a").alias("dst"), "way_id", "seq")
    return ahead.unionByName(back)


def within_hops(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node, hops): nodes reached in at most so many steps, with the smallest number.

    edges: src, dst; starts: node. Every step joins only the newest ring.
    """
    found = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops")).distinct()
    ring = found
    step = edges.select(F.col("src").alias("node"), F.col("dst")).distinct()
    for k in range(1, hops + 1):
        reached = ring.join(step, "node").select("start", F.col("dst").alias("node")).distinct()
        ring = materialise(reached.join(found, ["start", "node"], "left_anti").withColumn("hops", F.lit(k)), "hops")
        found = found.unionByName(ring)
    return found


def intersection_nodes(edges: DataFrame) -> DataFrame:
    """(node, degree): nodes with three or more different neighbours, in or out."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select(F.col("dst"), F.col("src")))
    return both.where("node != other").groupBy("node").agg(F.count_distinct("other").alias("degree")).where("degree >= 3")


def carriageway_changes(edges: DataFrame, ways: DataFrame) -> DataFrame:
    """(node, name) where one road splits into two carriageways (X39, A10): exactly three ways of one name meet,
    with three different neighbours: one over two ways' worth of directions and two over one."""
    named = edges.join(ways.select(F.col("id").alias("way_id"), "name"), "way_id")
    ends = named.select(F.col("src").alias("node"), F.col("dst").alias("other"), "way_id", "name").union(
        named.select(F.col("dst"), F.col("src"), "way_id", "name")
    )
    per = ends.groupBy("node", "name", "other").agg(F.count("*").alias("n"), F.collect_set("way_id").alias("ways"))
    g = per.groupBy("node", "name").agg(
        F.count("*").alias("others"), F.sum((F.col("n") == 2).cast("int")).alias("twice"), F.sum((F.col("n") == 1).cast("int")).alias("once"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ways")))).alias("n_ways"),
    )
    return g.where("n_ways = 3 and others = 3 and twice = 1 and once = 2").select("node", "name")


def clusters(edges: DataFrame, centroids: DataFrame, hops: int = 1) -> DataFrame:
    """(node, cluster) for centroids that lie within so many steps of another one."""
    near = within_hops(edges, centroids, hops).where("hops > 0")
    linked = near.join(centroids, "node", "left_semi").select(F.col("start").alias("a"), F.col("node").alias("b"))
    return connected_components(linked).withColumnRenamed("component", "cluster")


def assemble_intersections(centroids: DataFrame, changes: DataFrame, roundabouts: DataFrame, complex_: DataFrame) -> DataFrame:
    """(uid, type, nodes): carriageway changes, then roundabouts, then clusters, then single nodes.

    changes: node; roundabouts and complex_: node, cluster. A node belongs to the first kind that claims it.
    """
    kinds = (
        centroids.select("node")
        .join(changes.select("node", F.lit(True).alias("_change")).distinct(), "node", "left")
        .join(roundabouts.select("node", F.col("cluster").alias("_round")), "node", "left")
        .join(complex_.select("node", F.col("cluster").alias("_complex")), "node", "left")
    )
    kind = (
        F.when(F.col("_change"), "carriageway_change").when(F.col("_round").isNotNull(), "roundabout").when(F.col("_complex").isNotNull(), "complex").otherwise("simple")
    )
    own = F.when(kind == "roundabout", F.col("_round")).when(kind == "complex", F.col("_complex")).otherwise(F.col("node"))
    g = kinds.select("node", kind.alias("type"), own.alias("_g")).groupBy("type", "_g").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    return g.select(F.sha2(F.array_join(F.transform("nodes", lambda n: n.cast("string")), ","), 256).alias("uid"), "type", "nodes")


def allocate_signals(signals: DataFrame, intersections: DataFrame, km: float, size: float) -> DataFrame:
    """(signal, node): every traffic light goes to its nearest intersection node within ``km``.

    signals: point_id, x, y; intersections: place_id, px, py.
    """
    from waylake.operators.spatial import nearest_k

    return nearest_k(signals, intersections, 1, size, km).select(F.col("point_id").alias("signal"), F.col("place_id").alias("node"))


def path_to_point(path_points: DataFrame) -> DataFrame:
    """The first point of each path at its smallest distance; path_points: path_id, seq, km."""
    return path_points.groupBy("path_id").agg(F.min_by("seq", F.struct("km", "seq")).alias("seq"), F.min("km").alias("km"))


def direction_tags(paths: DataFrame, ways: DataFrame) -> DataFrame:
    """(path_id, seq, way_id, tag): 'A' for a way entered at its first node, 'B' at its last, 'O' otherwise.

    paths: path_id, ways (ids in travel order); ways: id, nodes. The direction of a way comes from the
    node that it shares with its neighbour on the path.
    """
    steps = paths.select("path_id", F.posexplode("ways").alias("seq", "way_id")).join(
        ways.select(F.col("id").alias("way_id"), F.col("nodes")), "way_id"
    )
    w = W.partitionBy("path_id").orderBy("seq")
    around = steps.withColumn("_next", F.lead("nodes").over(w)).withColumn("_prev", F.lag("nodes").over(w))
    first, last = F.element_at("nodes", 1), F.element_at("nodes", -1)
    to_next = F.when(F.array_contains("_next", last), "A").when(F.array_contains("_next", first), "B")
    from_prev = F.when(F.array_contains("_prev", first), "A").when(F.array_contains("_prev", last), "B")
    return around.select("path_id", "seq", "way_id", F.coalesce(to_next, from_prev, F.lit("O")).alias("tag"))


def intersection_features(intersections: DataFrame, nodes: DataFrame) -> DataFrame:
    """(uid, feature): GeoJSON text of each intersection, its nodes as a MultiPoint, its centre and type beside it.

    intersections: uid, type, nodes; nodes: id, x, y."""
    at = intersections.select("uid", "type", F.posexplode("nodes").alias("k", "id")).join(nodes.select("id", "x", "y"), "id")
    g = at.groupBy("uid", "type").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.array_sort(F.collect_list(F.struct("k", "id", "x", "y"))).alias("n"))
    points = F.transform("n", lambda p: F.array(p["x"], p["y"]))
    properties = F.struct("uid", "type", F.transform("n", lambda p: p["id"]).alias("nodes"), F.array("x", "y").alias("centre"))
    geometry = F.struct(F.lit("MultiPoint").alias("type"), points.alias("coordinates"))
    return g.select("uid", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("feature"))
