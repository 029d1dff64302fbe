"""Map matching as joins: the trellis of all lines at once.

States come from a grid join. The road between the states of two neighbouring steps is looked for from the ends of
their edges, as far as those steps need it, once for all lines that pass there. Transitions are rows with costs. The cheapest way
through a trellis is a product of its steps' cost matrices (the sum for a way through a state, the least over states):
neighbouring stretches merge pairwise, so a line of n steps takes log n rounds, in which all lines move together, and
the states in the middle that won lead back to the path. No row holds a line, its states or its surroundings.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from waylake.functions import geo
from waylake.functions.storage import materialise
from waylake.operators import matching, paths

#: Roads between two states that are nearly one are looked for within this distance.
LEAST_REACH_KM = 0.1


def road_links(segs: DataFrame) -> DataFrame:
    """(src, dst, way_id, km): allowed moves between nodes, of parallel ones the shortest; segs as from matching.segments()."""
    ahead = segs.where("forward").select(F.col("n1").alias("src"), F.col("n2").alias("dst"), "way_id", "km")
    back = segs.where("backward").select(F.col("n2").alias("src"), F.col("n1").alias("dst"), "way_id", "km")
    return paths.one_way_per_step(ahead.union(back))


def bounded_distances(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, km, before): shortest roads from every start (start, reach) to the nodes within its reach, with the
    node before the last one (null at the start). A round joins only the nodes that became nearer; the rounds are as many
    as the longest of these roads has steps."""
    front = materialise(starts.select("start", F.col("start").alias("node"), F.lit(0.0).alias("km"), F.lit(None).cast(starts.schema["start"].dataType).alias("before"), "reach"), "roads")
    found = front.drop("reach")
    step = links.select(F.col("src").alias("node"), "dst", F.col("km").alias("w"))
    while True:
        far = F.col("km") + F.col("w")
        moved = front.join(step, "node").where(far <= F.col("reach"))
        best = moved.groupBy("start", F.col("dst").alias("to")).agg(F.min_by(F.struct(far.alias("km"), F.col("node").alias("before")), F.struct(far, "node")).alias("b"), F.first("reach").alias("reach"))
        known = found.groupBy("start", F.col("node").alias("to")).agg(F.min("km").alias("known"))
        nearer = best.join(known, ["start", "to"], "left").where(F.col("known").isNull() | (F.col("b.km") < F.col("known")))
        front = materialise(nearer.select("start", F.col("to").alias("node"), "b.km", "b.before", "reach"), "roads")
        if front.isEmpty():
            least = F.min_by(F.struct("km", "before"), "km")
            return materialise(found.groupBy("start", "node").agg(least.alias("b")).select("start", "node", "b.km", "b.before"), "roads")
        found = found.union(front.drop("reach"))


def _chord_km(a: str, b: str) -> Column:
    return geo.chord_km(F.col(f"{a}.x"), F.col(f"{a}.y"), F.col(f"{b}.x"), F.col(f"{b}.y"))


def _cost(metres: Column) -> Column:
    return F.round(metres, 3)


def numbered(states: DataFrame) -> DataFrame:
    """States with ``j``, their number in their step by way, ``cost``, and ``p`` with all that a transition needs."""
    order = W.partitionBy("line_id", "step").orderBy("way_id")
    p = F.struct("x", "y", "n1", "n2", "pos")
    emission = _cost(F.pow(F.col("km") * 1000 / matching.SIGMA_M, 2) / 2)
    return states.select("line_id", "step", "way_id", F.row_number().over(order).alias("j"), emission.alias("cost"), p.alias("p"))


def transitions(states: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, roads): the moves (line_id, step, i, j, cost, kind and ends) from states to those of the next step, and
    the bounded distances behind them. ``states`` are numbered(). A move without a road is left out."""
    u = states.select("line_id", "step", F.col("j").alias("i"), F.col("p").alias("u"))
    v = states.select("line_id", (F.col("step") - 1).alias("step"), "j", F.col("p").alias("v"))
    pair = u.join(v, ["line_id", "step"]).withColumn("chord", F.explode(F.array(_chord_km("u", "v"))))
    pair = materialise(pair.withColumn("reach", F.when(F.col("chord") > 1e-9, 2 * F.col("chord")).otherwise(LEAST_REACH_KM)), "pairs")
    allowed = links.select("src", "dst", F.col("km").alias("w"))
    c = F.col
    same_point = (c("u.n1") == c("v.n1")) & (c("u.n2") == c("v.n2")) & (c("u.pos") == c("v.pos"))
    same_way = (c("u.n1") == c("v.n1")) & (c("u.n2") == c("v.n2"))
    turned = (c("u.n1") == c("v.n2")) & (c("u.n2") == c("v.n1"))
    still = pair.where(same_point).select("line_id", "step", "i", "j", "chord", F.lit(0.0).alias("km"), F.lit(0).alias("kind"), *[F.lit(None).cast("long").alias(n) for n in ("s", "e", "f", "g")])
    # both on one edge: straight along it, if that is allowed
    q = F.when(same_way, c("v.pos")).otherwise(1 - c("v.pos"))
    on = pair.where(~same_point & (same_way | turned)).withColumn("_on", c("u.pos") <= q)
    on = on.select("line_id", "step", "i", "j", "chord", F.abs(c("u.pos") - q).alias("share"), F.expr("if(_on, u.n1, u.n2)").alias("src"), F.expr("if(_on, u.n2, u.n1)").alias("dst"))
    on = on.join(allowed, ["src", "dst"]).select("line_id", "step", "i", "j", "chord", (c("share") * c("w")).alias("km"), F.lit(1).alias("kind"), c("src").alias("s"), c("dst").alias("e"), F.lit(None).cast("long").alias("f"), F.lit(None).cast("long").alias("g"))
    # from one edge to another: out of an end of the first, along the roads, in at an end of the second
    other = pair.where(~same_point & ~same_way & ~turned)
    ends = lambda at, share1, share2: F.explode(F.array(F.struct(c(f"{at}.n1").alias("from"), c(f"{at}.n2").alias("to"), share1.alias("share")), F.struct(c(f"{at}.n2").alias("from"), c(f"{at}.n1").alias("to"), share2.alias("share"))))
    keys = ["line_id", "step", "i", "j"]
    out = other.select(*keys, "chord", "reach", "v", ends("u", 1 - c("u.pos"), c("u.pos")).alias("o"))
    out = out.join(allowed, (c("o.from") == c("src")) & (c("o.to") == c("dst")), "left").where("w is not null or o.share = 0")
    out = out.select(*keys, "chord", "reach", "v", F.expr("if(o.share = 0, null, o.from)").alias("s"), c("o.to").alias("e"), F.coalesce(c("o.share") * c("w"), F.lit(0.0)).alias("km_out"))
    out = materialise(out.where("km_out <= reach"), "pairs-out")
    roads = bounded_distances(links, out.groupBy(c("e").alias("start")).agg(F.max(c("reach") - c("km_out")).alias("reach")))
    both = out.select(*keys, "chord", "reach", "s", "e", "km_out", ends("v", c("v.pos"), 1 - c("v.pos")).alias("t"))
    both = both.join(allowed, (c("t.from") == c("src")) & (c("t.to") == c("dst")), "left").where("w is not null or t.share = 0")
    both = both.select(*keys, "chord", "reach", "s", "e", "km_out", c("t.from").alias("f"), F.expr("if(t.share = 0, null, t.to)").alias("g"), F.coalesce(c("t.share") * c("w"), F.lit(0.0)).alias("km_in"))
    met = both.join(roads.select(c("start").alias("e"), c("node").alias("f"), c("km").alias("road")), ["e", "f"])
    met = met.withColumn("km", c("km_out") + c("road") + c("km_in")).where("km <= reach")
    met = met.select(*keys, "chord", "km", F.lit(2).alias("kind"), "s", "e", "f", "g")
    shortest = F.min_by(F.struct("km", "kind", "s", "e", "f", "g"), F.struct("km", "e", "f"))
    moves = met.groupBy(*keys, "chord").agg(shortest.alias("b")).select(*keys, "chord", "b.*")
    every = still.union(on).union(moves)
    off = F.abs(c("chord") - c("km")) * 1000 / matching.BETA_M
    emission = states.select("line_id", (c("step") - 1).alias("step"), "j", c("cost").alias("own"))
    every = every.where(F.exp(-off) > 0).join(emission, ["line_id", "step", "j"])
    return materialise(every.select(*keys, (_cost(off) + c("own")).alias("cost"), "kind", "s", "e", "f", "g"), "moves"), roads


def cheapest(states: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(costs, chosen): (line_id, cost) of the cheapest way through each trellis, and its moves (line_id, step, i, j)."""
    last = states.groupBy("line_id").agg(F.max("step").alias("n"))
    level = moves.select("line_id", (F.col("step") - 1).alias("block"), "i", "j", "cost")
    levels: list[DataFrame] = []
    width = last.agg(F.max("n")).first()[0] or 0  # one number
    blocks = width - 1
    while blocks > 1:
        half = F.shiftright("block", 1)
        left = level.where("block % 2 = 0").select("line_id", half.alias("block"), "i", F.col("j").alias("mid"), F.col("cost").alias("a"))
        right = level.where("block % 2 = 1").select("line_id", half.alias("block"), F.col("i").alias("mid"), "j", F.col("cost").alias("b"))
        joined = left.join(right, ["line_id", "block", "mid"]).groupBy("line_id", "block", "i", "j")
        merged = joined.agg(F.min_by(F.struct((F.col("a") + F.col("b")).alias("cost"), "mid"), F.struct(F.col("a") + F.col("b"), "mid")).alias("m"))
        merged = merged.select("line_id", "block", "i", "j", "m.cost", "m.mid")
        # the last stretch of a line has no partner where its number of stretches is odd
        n_blocks = F.ceil((F.col("n") - 1) / (1 << len(levels)))
        alone = level.join(last, "line_id").where((F.col("block") == n_blocks - 1) & (F.col("block") % 2 == 0))
        alone = alone.select("line_id", half.alias("block"), "i", "j", "cost", F.lit(None).cast("int").alias("mid"))
        merged = materialise(merged.union(alone), "trellis")
        levels.append(merged)
        level, blocks = merged.drop("mid"), -(-blocks // 2)
    first = states.where("step = 1").select("line_id", F.col("j").alias("i"), F.col("cost").alias("own"))
    whole = level.join(first, ["line_id", "i"]).withColumn("cost", F.col("cost") + F.col("own"))
    best = whole.groupBy("line_id").agg(F.min_by(F.struct("i", "j", "cost"), F.struct("cost", "j", "i")).alias("b"))
    best = materialise(best.select("line_id", "b.*"), "trellis-best")
    chosen = best.select("line_id", F.lit(0).alias("block"), "i", "j")
    for merged in reversed(levels):
        at = chosen.join(merged.select("line_id", "block", "i", "j", "mid"), ["line_id", "block", "i", "j"])
        through = F.when(F.col("mid").isNull(), F.array(F.struct((F.col("block") * 2).alias("block"), "i", "j"))).otherwise(
            F.array(F.struct((F.col("block") * 2).alias("block"), "i", F.col("mid").alias("j")), F.struct((F.col("block") * 2 + 1).alias("block"), F.col("mid").alias("i"), "j"))
        )
        chosen = materialise(at.select("line_id", F.explode(through).alias("t")).select("line_id", "t.*"), "trellis-path")
    return best.select("line_id", F.round("cost", 3).alias("cost"), F.col("i").alias("first"), F.col("j").alias("last")), chosen.select("line_id", (F.col("block") + 1).alias("step"), "i", "j")


def road_nodes(chosen: DataFrame, moves: DataFrame, roads: DataFrame) -> DataFrame:
    """(line_id, step, nodes) of the chosen moves: each road is followed back over the nodes before, all at once."""
    m = materialise(chosen.join(moves, ["line_id", "step", "i", "j"]), "chosen")
    ends = m.where("kind = 2").select("e", "f").distinct()
    front = ends.select("e", "f", F.col("f").alias("node"), F.lit(0).alias("k"))
    found = front
    before = roads.select(F.col("start").alias("e"), "node", "before").where("before is not null")
    while True:
        front = materialise(front.join(before, ["e", "node"]).select("e", "f", F.col("before").alias("node"), (F.col("k") + 1).alias("k")), "road-nodes")
        if front.isEmpty():
            break
        found = found.union(front)
    # the nodes of one road between two states
    between = found.groupBy("e", "f").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "node")), asc=False), lambda x: x["node"]).alias("road"))
    rows = m.join(between, ["e", "f"], "left")
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<bigint>"))
    nodes = F.when(F.col("kind") == 0, F.array().cast("array<bigint>")).when(F.col("kind") == 1, F.array("s", "e")).otherwise(F.concat(one("s"), "road", one("g")))
    return rows.select("line_id", "step", nodes.alias("nodes"))


def match_lines(lines: DataFrame, ways: DataFrame, nodes: DataFrame, radius_km: float = 0.02, size: float = 0.02) -> DataFrame:
    """Match lines (id, line) to a road graph: (line_id, nodes, ways, cost, offset_start, offset_end, error), a row per line
    with points; failed ones have an error text. The same result as matching.match_lines()."""
    points = materialise(matching.vertices(lines), "vertices")
    segs = materialise(matching.segments(ways, nodes), "segments")
    links = materialise(road_links(segs), "links")
    states = materialise(numbered(matching.states(points, segs, radius_km, size)), "states")
    steps = points.groupBy("line_id").agg(F.count("*").alias("n"))
    seen = states.groupBy("line_id").agg(F.count_distinct("step").alias("seen"))
    able = materialise(steps.join(seen, "line_id").where("n > 1 and n = seen").select("line_id"), "able")
    states = materialise(states.join(able, "line_id", "left_semi"), "states")
    moves, roads = transitions(states, links)
    costs, chosen = cheapest(states, moves)
    parts = road_nodes(chosen, moves, roads)
    whole = parts.groupBy("line_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("step", "nodes"))), lambda x: x["nodes"])).alias("raw"))

    @F.pandas_udf("array<long>")
    def tidy(raw: pd.Series) -> pd.Series:
        return pd.Series([matching.tidy(list(x)) for x in raw])

    whole = materialise(whole.select("line_id", tidy("raw").alias("nodes")).where(F.size("nodes") > 1), "matched")
    pairs = paths.path_steps(whole.withColumnRenamed("line_id", "path_id")).withColumnRenamed("path_id", "line_id")
    way_of = segs.select(F.col("n1").alias("src"), F.col("n2").alias("dst"), "way_id").union(segs.select("n2", "n1", "way_id")).groupBy("src", "dst").agg(F.min("way_id").alias("way_id"))
    along = W.partitionBy("line_id").orderBy("seq")
    named = pairs.join(way_of, ["src", "dst"]).withColumn("_last", F.lag("way_id").over(along)).where("_last is null or _last != way_id")
    by_line = named.groupBy("line_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "way_id"))), lambda x: x["way_id"]).alias("ways"))
    end = lambda name, which: costs.join(states.select("line_id", "step", F.col("j").alias(which), F.col("p").alias(name)), ["line_id", which])
    first = end("a", "first").where("step = 1").select("line_id", "a")
    final = end("z", "last").join(steps, "line_id").where("step = n").select("line_id", "z")
    offset = lambda at, node: F.when(F.col(f"{at}.n2") == node, 1 - F.col(f"{at}.pos")).otherwise(F.col(f"{at}.pos"))
    done = whole.join(by_line, "line_id", "left").join(costs.select("line_id", "cost"), "line_id").join(first, "line_id").join(final, "line_id").select(
        "line_id", "nodes", F.coalesce("ways", F.array().cast("array<bigint>")).alias("ways"), "cost",
        offset("a", F.element_at("nodes", 1)).alias("offset_start"), offset("z", F.element_at("nodes", -1)).alias("offset_end"),
    )
    error = F.when(F.col("cost").isNull(), matching.FAILED).alias("error")
    return steps.select("line_id").join(done, "line_id", "left").select("*", error)


def match_parts(features: DataFrame, ways: DataFrame, nodes: DataFrame, radius_km: float = 0.02, size: float = 0.02) -> DataFrame:
    """Match features of several lines each (id, parts: array of lines, both_ways).

    Every part is matched alone. A feature that runs both ways (``both_ways``) whose match holds a one-way road is matched
    again from end to start, which finds the other carriageway; what both find counts once. Returns (id, nodes, ways, parts,
    cost, error): ``parts`` are the matched stretches of nodes, in the order of the lines and then of the second pass, where
    parts that go on from each other's end are one stretch. A feature of which no part matches has an error.
    """
    part = features.select("id", "both_ways", F.posexplode("parts").alias("k", "line")).where(F.size("line") > 0)
    forth = part.select(F.struct("id", "k", F.lit(0).alias("pass")).alias("id"), "line")
    found = materialise(match_lines(forth, ways, nodes, radius_km, size), "matched-parts")
    one_way = ways.where("oneway").select(F.col("id").alias("way"))
    hit = found.select("line_id.id", F.explode("ways").alias("way")).join(one_way, "way", "left_semi").select("id").distinct()
    again = part.where("both_ways").join(hit, "id", "left_semi").select(F.struct("id", "k", F.lit(1).alias("pass")).alias("id"), F.reverse("line").alias("line"))
    back = materialise(match_lines(again, ways, nodes, radius_km, size), "matched-back")
    every = found.union(back).where("error is null").select("line_id.id", F.struct("line_id.pass", "line_id.k", "nodes", "ways", "cost").alias("m"))
    g = every.groupBy("id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    distinct = lambda c: F.array_distinct(F.flatten(F.transform("m", lambda m: m[c])))
    empty = F.array().cast("array<array<bigint>>")

    def joined(acc: Column, m: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        goes_on = F.coalesce(F.element_at(last, -1) == F.element_at(m["nodes"], 1), F.lit(False))
        longer = F.concat(last, F.slice(m["nodes"], F.lit(2), F.size(m["nodes"])))
        return F.when(goes_on, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(m["nodes"])))

    g = g.select("id", distinct("nodes").alias("nodes"), distinct("ways").alias("ways"), F.aggregate("m", empty, joined).alias("parts"), F.round(F.aggregate("m", F.lit(0.0), lambda t, m: t + m["cost"]), 3).alias("cost"))
    return features.select("id").join(g, "id", "left").select("*", F.when(F.col("parts").isNull(), matching.FAILED).alias("error"))
