"""Spanning forests, tours of trees and cut vertices of undirected graphs, in rounds of joins.

Every step takes a number of rounds that grows with the logarithm of the graph,
whatever its shape: long chains and large hubs take no more. Nothing holds a
component in one task; rounds are checkpointed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.graphs import connected, running, settled


def links_of(edges: DataFrame) -> DataFrame:
    """u and v, the smaller first, of the pairs of different vertices that edges (src, dst) link."""
    return settled(edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).filter("u <> v").distinct())


def spanning_forest(links: DataFrame) -> DataFrame:
    """child, u and v: the links of a spanning forest of links (u, v); child is a vertex that hooked on there, each once.

    Trees grow from single vertices. In each round a tree hooks on to the
    neighbour that comes first in the round's random order, if that comes before
    itself, so hooks go round nowhere, and at least half of the trees with a
    neighbour are expected to do so. Pointers are then halved until they name
    roots, and of the links between two trees one is kept. A vertex that never
    hooked on is its tree's root.
    """
    between, forest, turn = links.select("u", "v", F.col("u").alias("a"), F.col("v").alias("b")), None, 0
    while True:
        order = lambda c, k=turn: F.struct(F.xxhash64(F.lit(k), F.col(c)), F.col(c))
        ends = between.select("u", "v", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("u", "v", "e.*")
        first = ends.groupBy("x").agg(F.min_by(F.struct("y", "u", "v"), order("y")).alias("to")).select("x", "to.*")
        hooks = settled(first.withColumn("hooked", order("y") < order("x")))
        if hooks.isEmpty():
            return forest
        taken = hooks.filter("hooked").select(F.col("x").alias("child"), "u", "v")
        forest = taken if forest is None else forest.union(taken)
        up = settled(hooks.select(F.col("x").alias("id"), F.when(F.col("hooked"), F.col("y")).otherwise(F.col("x")).alias("root")))
        while True:
            above = up.select(F.col("id").alias("root"), F.col("root").alias("next"))
            further = settled(up.join(above, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            up = further.select("id", "root")
            if further.filter("moved").isEmpty():
                break
        to = lambda c: up.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
        moved = between.join(to("a"), "a").join(to("b"), "b").filter("a_root <> b_root")
        pair = F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")
        between = settled(moved.groupBy(*pair).agg(F.min(F.struct("u", "v")).alias("link")).select("link.*", "a", "b"))
        turn += 1


def tour(forest: DataFrame) -> DataFrame:
    """vertex, parent, tree, low and high of every vertex of a forest that isn't a root.

    The tour of a tree walks each link down and up again. Its steps are numbered
    from the last, 0, upwards; a vertex is entered at `high` and left at `low`,
    so its descendants are those entered in between. tree names the tree's root.

    The step after s -> t goes on to t's neighbour after s, the last one's to
    the first; at a root the walk ends there. Steps are ranked by doubling:
    each knows how many steps lie between it and one further on, and adds what
    that one knows.
    """
    ends = F.explode(F.array(F.struct(F.col("u").alias("s"), F.col("v").alias("t")), F.struct(F.col("v").alias("s"), F.col("u").alias("t")))).alias("e")
    ways = running(forest.select(ends).select("e.*"), "s", ["t"], F.lit(1), "place")
    ways = settled(ways.withColumn("step", F.monotonically_increasing_id()))
    counts = ways.groupBy("s").agg(F.count("*").alias("n")).join(forest.select(F.col("child").alias("s")).withColumn("hooked", F.lit(True)), "s", "left")
    counts = settled(counts.select(F.col("s").alias("t"), "n", F.col("hooked").isNull().alias("root")))
    back = ways.select(F.col("s").alias("t"), F.col("t").alias("s"), F.col("step").alias("back"), F.col("place").alias("at"))
    met = ways.select("step", "s", "t").join(back, ["s", "t"]).join(counts, "t")
    ended = F.col("root") & (F.col("at") + 1 == F.col("n"))
    wanted = met.select("step", "s", "t", "back", F.when(~ended, (F.col("at") + 1) % F.col("n")).alias("place"))
    after = ways.select(F.col("s").alias("t"), "place", F.col("step").alias("next"))
    steps = settled(wanted.join(after, ["t", "place"], "left").select("step", "s", "t", "back", "next"))
    ranked = settled(steps.select("step", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("rank"), F.when(F.col("next").isNull(), F.col("t")).alias("tree")))
    known = 1
    while known < ranked.count():  # a step knows what lies between it and the one so many further on, in each round four times as many
        for _ in range(2):
            on = ranked.select(F.col("step").alias("next"), F.col("next").alias("further"), F.col("rank").alias("more"), F.col("tree").alias("its"))
            ranked = ranked.join(on, "next", "left").select("step", F.col("further").alias("next"), (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank"), F.coalesce("tree", "its").alias("tree"))
        ranked, known = settled(ranked), 4 * known
    down_and_up = steps.select("step", "s", "t", "back").join(ranked.select("step", "rank", "tree"), "step")
    other = ranked.select(F.col("step").alias("back"), F.col("rank").alias("low"))
    down = down_and_up.join(other, "back").filter("rank > low")
    return settled(down.select(F.col("t").alias("vertex"), F.col("s").alias("parent"), "tree", "low", F.col("rank").alias("high")))


def over_ranges(values: DataFrame, asked: DataFrame, best: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The rows of asked (tree, low, high, unique in its tree) with the best of values (tree, place) in each one's range.

    best: an aggregate for each column of values, which must not mind a value
    that comes twice. Places run from 0 without gaps in each tree. Each round
    knows the best of four times as many places from each on as the one before,
    and settles the ranges that up to four such stretches cover.
    """
    names = list(best)
    agg = [f(F.col(c)).alias(c) for c, f in best.items()]
    level, width, found = settled(values.select("tree", "place", *names)), 1, None
    size = F.col("high") - F.col("low") + 1
    longest = asked.agg(F.max(size)).first()[0] or 0
    while width <= longest:
        due = asked.filter((size >= width) & (size < 4 * width)).select("tree", "high", F.explode(F.array_distinct(F.array(*(F.least(F.col("low") + k * width, F.col("high") - width + 1) for k in range(4))))).alias("place"))
        now = settled(due.join(level, ["tree", "place"]).groupBy("tree", "high").agg(*agg))
        found, width = now if found is None else found.union(now), 4 * width
        if width > longest:
            break
        moved = level.select("tree", F.explode(F.array(*(F.col("place") - k * (width // 4) for k in range(4)))).alias("place"), *names)
        level = settled(moved.groupBy("tree", "place").agg(*agg, F.count("*").alias("whole")).filter("whole = 4").drop("whole"))
    return asked.join(found, ["tree", "high"]).select(*asked.columns, *names)


def blocks(edges: DataFrame) -> DataFrame:
    """vertex, parent and block: the links of a spanning forest, and the two-connected part of the graph that each is in.

    Two links of the forest that follow each other downwards are in one block if
    a link leads from below the lower one to beyond the upper one's subtree; two
    side by side are if a link joins what hangs on them. The blocks are the
    components that these pairs make.
    """
    links = links_of(edges)
    forest = spanning_forest(links)
    if forest is None:
        return edges.select(F.col("src").alias("vertex"), F.col("src").alias("parent"), F.col("src").alias("block")).limit(0)
    placed = tour(settled(forest))
    loose = links.join(forest.select("u", "v"), ["u", "v"], "left_anti")
    at = lambda c: placed.select(F.col("vertex").alias(c), F.col("low").alias(f"{c}_low"), F.col("high").alias(f"{c}_high"))
    # A root is entered before everything else.
    loose = settled(loose.join(at("u"), "u", "left").join(at("v"), "v", "left"))
    top = F.lit((1 << 63) - 1)
    high = lambda c: F.coalesce(f"{c}_high", top)
    ends = F.explode(F.array(F.struct(F.col("u").alias("vertex"), high("v").alias("reached")), F.struct(F.col("v").alias("vertex"), high("u").alias("reached")))).alias("e")
    reached = loose.select(ends).groupBy("e.vertex").agg(F.max("e.reached").alias("most"), F.min("e.reached").alias("least"))
    own = placed.join(reached, "vertex", "left").select("tree", F.explode(F.array(
        F.struct(F.col("high").alias("place"), F.greatest("high", "most").alias("most"), F.least("high", "least").alias("least")),
        F.struct(F.col("low").alias("place"), F.lit(None).cast("long").alias("most"), F.lit(None).cast("long").alias("least")),
    )).alias("e")).select("tree", "e.*")
    spans = over_ranges(own, placed, {"most": F.max, "least": F.min})
    above = placed.select(F.col("vertex").alias("parent"), F.col("low").alias("up_low"), F.col("high").alias("up_high"))
    chained = spans.join(above, "parent").filter("most > up_high or least < up_low").select(F.col("vertex").alias("src"), F.col("parent").alias("dst"))
    apart = F.col("u_high").isNotNull() & F.col("v_high").isNotNull() & ((F.col("u_high") < F.col("v_low")) | (F.col("v_high") < F.col("u_low")))
    beside = loose.filter(apart).select(F.col("u").alias("src"), F.col("v").alias("dst"))
    found = connected(placed.select(F.col("vertex").alias("id")), chained.union(beside))
    return placed.join(found.withColumnRenamed("id", "vertex"), "vertex").select("vertex", "parent", F.col("component").alias("block"))


def articulation_points(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id of the vertices whose removal splits their component: those whose links are in several blocks."""
    found = settled(blocks(edges))
    ends = F.explode(F.array("vertex", "parent")).alias("id")
    return found.select(ends, "block").groupBy("id").agg(F.min("block").alias("a"), F.max("block").alias("b")).filter("a <> b").select("id")
