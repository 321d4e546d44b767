"""Graph operators over vertices (id) and edges (src, dst).

Loops run until nothing changes; each round is checkpointed, so lineage stays
short and a lost executor costs one round.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.workers import ship_code


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session without one a temporary folder, then set."""
    context = spark.sparkContext
    at = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (at.get() if at.isDefined() else None)
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='codeloom-')}"
    if not at.isDefined():
        context.setCheckpointDir(folder)
    return folder


T = TypeVar("T")

_kept: list[tuple[SparkSession, str]] = []


def _clear() -> None:
    for spark, path in _kept:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended; what is left is the folder's owner's to clear
            return


def settled(df: DataFrame) -> DataFrame:
    """df, computed once, as a table in the checkpoint folder that goes when Python ends.

    What reads it starts from columns of known size. A checkpointed plan would
    hand on the planner's conditions and its guess of the size, which is a
    product over all joins of all rounds before: planning would soon take longer
    than the rounds.
    """
    spark = df.sparkSession
    if not _kept:
        atexit.register(_clear)
    path = f"{checkpoint_folder(spark)}/codeloom-graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _kept.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def together(*parts: Callable[[], T]) -> list[T]:
    """What parts return, called at the same time: loops of small jobs that don't need each other share the cluster."""
    with ThreadPoolExecutor(max(len(parts), 1)) as pool:
        return [f.result() for f in [pool.submit(p) for p in parts]]


def _fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], differs: Column, most: int | None = None) -> DataFrame:
    """Applies step, which gives the new columns beside old_*, until differs holds for no row."""
    rounds = 0
    while most is None or rounds < most:
        following = settled(step(state))
        changed = not following.filter(differs).isEmpty()
        state = following.select(*state.columns)
        rounds += 1
        if not changed:
            break
    return state


#: Steps of a spread that one job takes.
STEPS = 3


def _spread(state: DataFrame, ways: DataFrame, message: Column, best: Callable[[Column], Column], pick: Callable[..., Column], acyclic: bool = False) -> DataFrame:
    """id and value when messages along ways change nothing more; only vertices that changed send any.

    state: id, value; ways: tail, head and what message needs beside the tail's
    value; best aggregates the messages to a head, pick takes the better of its
    value and theirs. acyclic: values only settle if ways go round nowhere, so
    as many rounds as vertices are an error.
    """
    state = settled(state.withColumn("changed", F.col("value").isNotNull()))
    most, rounds = state.count() if acyclic else None, 0
    while True:
        if most is not None and rounds > most:
            raise ValueError("the graph has a cycle; take its back edges out first")
        for _ in range(STEPS):
            live = state.filter("changed").select(F.col("id").alias("tail"), "value")
            sent = ways.join(live, "tail").groupBy(F.col("head").alias("id")).agg(best(message).alias("sent"))
            new = pick("value", "sent")
            state = state.join(sent, "id", "left").select("id", new.alias("value"), (~new.eqNullSafe(F.col("value"))).alias("changed"))
        state, rounds = settled(state), rounds + STEPS
        if state.filter("changed").isEmpty():
            return state.drop("changed")


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out of distinct edges, 0 for those without."""
    ends = edges.select("src", "dst").distinct().select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    sums = ends.groupBy("e.id").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    return vertices.select("id").join(sums, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def reach_least(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """id and label, where a label is the least of a vertex and of those from which edges lead to it; rounds grow with the longest way."""
    ways = edges.select(F.col("src").alias("tail"), F.col("dst").alias("head"))
    return _spread(labels.select("id", F.col("label").alias("value")), ways, F.col("value"), F.min, F.least).withColumnRenamed("value", "label")


def connected(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component (its least id) of an undirected graph.

    Stars are contracted: every vertex's neighbours above it, then it and those
    below it, are linked with the least neighbour, until nothing changes. The
    rounds grow with the logarithm of the longest way.
    """
    links = settled(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct())
    stamp = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = settled(small.union(lower.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == stamp:
            break
        stamp = now
    found = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def strongly_connected(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component (its least id) of the strongly connected components of two vertices or more.

    Each round colours every vertex with the least one that reaches it; those of
    a colour that reach the colour's own vertex are its component and leave. A
    vertex without edges in and out left is alone and leaves before.
    """
    left = settled(edges.select("src", "dst").filter("src <> dst").distinct())
    found, n = None, left.count()
    while n:
        while n:  # trim
            kept = settled(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            before, n, left = n, kept.count(), kept
            if n == before:
                break
        if not n:
            break
        ids = left.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        colour = settled(reach_least(ids.select("id", F.col("id").alias("label")), left))
        a, b = colour.select(F.col("id").alias("src"), F.col("label").alias("a")), colour.select(F.col("id").alias("dst"), F.col("label").alias("b"))
        same = settled(left.join(a, "src").join(b, "dst").filter("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        back = reach_least(colour.select("id", F.when(F.col("id") == F.col("label"), F.col("label")).alias("label")), same)
        done = settled(back.filter("label is not null").join(colour.withColumnRenamed("label", "own"), "id").filter("label = own").select("id", F.col("own").alias("component")))
        found = done if found is None else found.union(done)
        gone = done.select("id")
        left = settled(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
        n = left.count()
    if found is None:
        return vertices.select("id", F.col("id").alias("component")).limit(0)
    several = found.groupBy("component").count().filter("count > 1").select("component")
    return found.join(several, "component", "left_semi").select("id", "component")


def label_propagation(vertices: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """id and label (its least id) of the communities of an undirected graph; rounds: sweeps at most.

    In a sweep every vertex in turn takes the label that most neighbours have,
    the least of several. Turns go by a digest of the id, and a vertex sees new
    labels of the neighbours before it and old ones of those after it, as if
    they were visited one after the other: the new labels of a sweep are
    computed for all vertices at once, and again from these until none differs,
    which is when nothing that a vertex sees before its turn moves any more.
    Every step makes more neighbours agree, or as many on a lesser label, so
    sweeps settle and don't oscillate. At the end a community whose members
    don't hang together is split into its connected parts.
    """
    turn = lambda c: F.struct(F.md5(F.col(c).cast("string")), F.col(c))
    both = edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct()
    both = settled(both.withColumn("earlier", turn("src") < turn("dst")))
    state = settled(vertices.select("id", F.col("id").alias("label"), F.col("id").alias("new")))
    for _ in range(rounds):
        while True:
            seen = both.join(state.select(F.col("id").alias("src"), "label", "new"), "src")
            votes = seen.groupBy("dst", F.when(F.col("earlier"), F.col("new")).otherwise(F.col("label")).alias("vote")).count()
            best = votes.groupBy(F.col("dst").alias("id")).agg(F.min_by("vote", F.struct(-F.col("count"), F.col("vote"))).alias("best"))
            took = F.coalesce("best", "label")
            state = settled(state.join(best, "id", "left").select("id", "label", took.alias("new"), (took != F.col("new")).alias("moved")))
            if state.filter("moved").isEmpty():
                break
        if state.filter("new <> label").isEmpty():
            break
        state = state.select("id", F.col("new").alias("label"), "new")
    labels = state.select("id", F.col("new").alias("label"))
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("a")), labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    within_one = both.filter("earlier").join(a, "src").join(b, "dst").filter("a = b").select("src", "dst")
    return connected(vertices, within_one).withColumnRenamed("component", "label")


def layers(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id and layer of an acyclic graph: 0 without edges out, else one above the highest vertex that it leads to; a cycle is an error."""
    ways = edges.select(F.col("dst").alias("tail"), F.col("src").alias("head")).distinct()
    return _spread(vertices.select("id", F.lit(0).alias("value")), ways, F.col("value") + 1, F.max, F.greatest, acyclic=True).withColumnRenamed("value", "layer")


def step_cost(fan_in: Column) -> Column:
    return 1 + F.log2(F.greatest(fan_in, F.lit(1)).cast("double"))


def weighted_depth(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, weight and next of an acyclic graph: the dearest path out, each step costing 1 + log2 of its target's distinct importers.

    next is the vertex that the path goes on to, the least of several; null where it ends. A cycle is an error.
    """
    costs = settled(degrees(vertices, edges).select(F.col("id").alias("dst"), step_cost(F.col("fan_in")).alias("cost")))
    ways = settled(edges.join(costs, "dst").select(F.col("dst").alias("tail"), F.col("src").alias("head"), "cost"))
    weights = _spread(vertices.select("id", F.lit(0.0).alias("value")), ways, F.col("value") + F.col("cost"), F.max, F.greatest, acyclic=True)
    on = ways.join(weights.select(F.col("id").alias("tail"), "value"), "tail").groupBy(F.col("head").alias("id"))
    best = on.agg(F.min_by("tail", F.struct(-F.round(F.col("cost") + F.col("value"), 9), F.col("tail"))).alias("next"))
    return weights.join(best, "id", "left").select("id", F.col("value").alias("weight"), "next")


def traces(weighted: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """id, place and step of every vertex on the dearest paths of the asked vertices (id), themselves at place 0; weighted: id, next.

    A table of jumps knows the vertex that lies 1, 2, 4, ... steps on, and each
    round makes the paths found so far twice as long by one jump. So only asked
    vertices have rows, and the rounds grow with the logarithm of the longest
    path. Without asked all vertices are, whose paths together may be as many
    as the square of the vertices.
    """
    jumps = settled(weighted.filter("next is not null").select("id", "next"))
    found = (weighted if asked is None else asked).select("id", F.lit(0).alias("place"), F.col("id").alias("step")).distinct()
    reach = 1
    while True:
        further = settled(found.join(jumps.withColumnRenamed("id", "step"), "step").select("id", (F.col("place") + reach).alias("place"), F.col("next").alias("step")))
        if further.isEmpty():
            return found
        found, reach = settled(found.union(further)), 2 * reach
        jumps = settled(jumps.join(jumps.select(F.col("id").alias("next"), F.col("next").alias("far")), "next").select("id", F.col("far").alias("next")))


def below(parents: DataFrame, top: DataFrame) -> DataFrame:
    """id of top (id) and of all that lies under it, at any depth; parents: id, parent. Only what is found is walked, a level in each round."""
    found = frontier = settled(top.select("id").distinct())
    while True:
        frontier = settled(parents.join(frontier.select(F.col("id").alias("parent")), "parent", "left_semi").select("id").join(found, "id", "left_anti"))
        if frontier.isEmpty():
            return found
        found = settled(found.union(frontier).distinct())


def outermost(parents: DataFrame, marked: DataFrame) -> DataFrame:
    """id and to, the outermost of the marked (id) among its ancestors, of those that have any; parents: id, parent.

    Every vertex knows an ancestor and the outermost marked one up to there;
    each round it goes on from that ancestor by what that one knows, so the
    rounds grow with the logarithm of the depth and no pairs of all ancestors
    are made. In a circle of parents it is one of those in it.
    """
    mark = marked.select(F.col("id").alias("parent"), F.col("id").alias("to")).distinct()
    state = settled(parents.filter("parent is not null").join(mark, "parent", "left").select("id", F.col("parent").alias("up"), "to"))
    reach, most = 1, state.count()
    while reach < 2 * most:
        above = state.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("to").alias("beyond"))
        following = settled(state.join(above, "up", "left").select("id", F.col("further").alias("up"), F.coalesce("beyond", "to").alias("to")))
        state, reach = following, 2 * reach
        if state.filter("up is not null").isEmpty():
            break
    return state.filter("to is not null").select("id", "to")


def within(edges: DataFrame, start: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """id and depth of what some steps from start (id) reach, start included at 0; edges count both ways unless directed."""
    steps = edges.select("src", "dst") if directed else edges.select("src", "dst").union(edges.select("dst", "src"))
    steps = settled(steps.distinct())
    seen = settled(start.select("id", F.lit(0).alias("depth")).distinct())
    for k in range(1, depth + 1):
        edge = seen.filter(F.col("depth") == k - 1).select(F.col("id").alias("src"))
        new = steps.join(edge, "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        following = settled(seen.union(new.withColumn("depth", F.lit(k))))
        if following.filter(F.col("depth") == k).isEmpty():
            return following
        seen = following
    return seen


def ancestors(parents: DataFrame, most: int | None = None) -> DataFrame:
    """id, ancestor and distance for every vertex and each folder above it; parents: id, parent.

    most: steps, if only so many count, each way of walking them for itself.
    Without it each ancestor comes once, with the shortest distance; where
    parents go round in a circle, a folder is an ancestor of itself. Then the
    steps that pairs know are doubled each round by pairs of exactly so many
    steps, so the rounds grow with the logarithm of the depth.
    """
    pairs = settled(parents.filter("parent is not null").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    if most is not None:
        out, frontier = pairs, pairs
        up = parents.filter("parent is not null").select(F.col("id").alias("ancestor"), F.col("parent").alias("next"))
        for _ in range(1, most):
            frontier = settled(frontier.join(up, "ancestor").select("id", F.col("next").alias("ancestor"), (F.col("distance") + 1).alias("distance")))
            if frontier.isEmpty():
                break
            out = out.union(frontier)
        return out
    out, jumps, n = settled(pairs.distinct()), settled(pairs.select("id", F.col("ancestor").alias("to")).distinct()), 0
    reach = 1
    while (now := out.count()) > n:
        n = now
        onward = out.select(F.col("id").alias("to"), "ancestor", (F.col("distance") + reach).alias("distance"))
        further = jumps.join(onward, "to").select("id", "ancestor", "distance")
        out = settled(out.union(further).groupBy("id", "ancestor").agg(F.min("distance").alias("distance")))
        jumps = settled(jumps.join(jumps.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to")).distinct())
        reach *= 2
    return out


#: Edge kinds and their priorities, the highest most telling.
PRIORITY = {"contains": 5, "uses": 5, "extends": 4, "implements": 3, "dependency": 2, "import": 1, "devDependency": 0, "peerDependency": 0, "export": 0}


def kind_priority(kind: Column) -> Column:
    """0 for no kind or an unknown one."""
    return F.coalesce(*(F.when(kind == k, p) for k, p in PRIORITY.items()), F.lit(0))


def coerced_kind(kind: Column) -> Column:
    """A known edge kind as it is; any other, or none, is dependency."""
    return F.when(kind.isin(*PRIORITY), kind).otherwise("dependency")


def bundle(edges: DataFrame, at_least: int = 50) -> DataFrame:
    """src, dst, kind, kinds and n: edges of one pair made one, if there are so many edges at all.

    edges: src, dst, kind, hidden and, if told, seq, the order in which they came. The
    kind is that of a visible edge, then of the highest priority, then of the
    first. The number of edges is a scalar that the plan computes itself.
    """
    many = edges.agg((F.count("*") >= at_least).alias("many"))
    alone = F.monotonically_increasing_id()
    keyed = edges.withColumn("_row", alone).join(F.broadcast(many)).withColumn("_row", F.when(F.col("many"), F.lit(0)).otherwise(F.col("_row")))
    came = F.col("seq") if "seq" in edges.columns else F.lit(0)
    order = F.struct(F.coalesce("hidden", F.lit(False)), -kind_priority(F.col("kind")), came, F.col("kind"))
    return keyed.groupBy("src", "dst", "_row").agg(F.min_by("kind", order).alias("kind"), F.sort_array(F.collect_set("kind")).alias("kinds"), F.count("*").alias("n")).drop("_row")


def lift(edges: DataFrame, folders: DataFrame) -> DataFrame:
    """src, dst, kind, role and n: edges between folders become trunks with counts, and stubs at both ends.

    folders: id, folder (null for none). Edges inside a folder, or between
    vertices without one, stay as they are.
    """
    a, b = folders.select(F.col("id").alias("src"), F.col("folder").alias("f")), folders.select(F.col("id").alias("dst"), F.col("folder").alias("t"))
    placed = edges.join(a, "src", "left").join(b, "dst", "left")
    crosses = F.coalesce(F.col("f") != F.col("t"), F.col("f").isNotNull() | F.col("t").isNotNull())
    crossing, inside = placed.filter(crosses), placed.filter(~crosses)
    text = lambda c: F.col(c).cast("string")
    name = lambda c: F.concat(F.lit("folder:"), text(c))
    trunk = crossing.groupBy(F.coalesce(name("f"), text("src")).alias("src"), F.coalesce(name("t"), text("dst")).alias("dst"), "kind").agg(F.count("*").alias("n")).withColumn("role", F.lit("trunk"))
    out = crossing.filter("f is not null").select(text("src").alias("src"), name("f").alias("dst"), "kind").groupBy("src", "dst", "kind").agg(F.count("*").alias("n")).withColumn("role", F.lit("source_stub"))
    into = crossing.filter("t is not null").select(name("t").alias("src"), text("dst").alias("dst"), "kind").groupBy("src", "dst", "kind").agg(F.count("*").alias("n")).withColumn("role", F.lit("target_stub"))
    same = inside.groupBy(text("src").alias("src"), text("dst").alias("dst"), "kind").agg(F.count("*").alias("n")).withColumn("role", F.lit("edge"))
    return trunk.unionByName(out).unionByName(into).unionByName(same)


def collapse(edges: DataFrame, parents: DataFrame, collapsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with the ends moved to their outermost collapsed folder, each once, and the number of those at each such folder."""
    moved = settled(outermost(parents, collapsed))
    a, b = moved.select(F.col("id").alias("src"), F.col("to").alias("a")), moved.select(F.col("id").alias("dst"), F.col("to").alias("b"))
    mapped = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"), "kind", (F.col("a").isNotNull() | F.col("b").isNotNull()).alias("lifted"))
    once = settled(mapped.filter("src <> dst").groupBy("src", "dst", "kind").agg(F.max("lifted").alias("lifted")))
    counts = once.filter("lifted").select(F.explode(F.array("src", "dst")).alias("id")).join(collapsed.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("n"))
    return once.select("src", "dst", "kind"), counts


def _walk(group: pd.DataFrame) -> pd.DataFrame:
    """Back edges of a depth-first walk in order of ids: those to a vertex on the walk's stack."""
    out_of: dict = {}
    for a, b in sorted(set(zip(group["src"], group["dst"], strict=True))):
        out_of.setdefault(a, []).append(b)
    state: dict = {}
    back = []
    for start in sorted(set(group["src"]) | set(group["dst"])):
        if start in state:
            continue
        state[start] = 1
        stack = [(start, iter(out_of.get(start, ())))]
        while stack:
            v, rest = stack[-1]
            w = next(rest, None)
            if w is None:
                state[v] = 2
                stack.pop()
            elif state.get(w) == 1:
                back.append((v, w))
            elif w not in state:
                state[w] = 1
                stack.append((w, iter(out_of.get(w, ()))))
    return pd.DataFrame(back, columns=["src", "dst"]).astype({"src": group["src"].dtype, "dst": group["dst"].dtype})


def back_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """src and dst of edges without which the graph is acyclic.

    A walk in order runs over one strongly connected component at a time, as no
    cycle leaves one; a component must fit in a task.
    """
    ship_code(edges.sparkSession)
    where = settled(strongly_connected(vertices, edges))
    a = where.select(F.col("id").alias("src"), F.col("component").alias("a"))
    b = where.select(F.col("id").alias("dst"), F.col("component").alias("b"))
    kind = edges.schema["src"].dataType.simpleString()
    return edges.join(a, "src").join(b, "dst").filter("a = b").groupBy("a").applyInPandas(_walk, f"src {kind}, dst {kind}")


#: Rows of one layer that a single task may rank.
LAYER_ROWS = 1_000_000


def largest_group(df: DataFrame, group: str) -> int:
    return df.groupBy(group).count().agg(F.max("count")).first()[0] or 0


def running(df: DataFrame, group: str, order: list[str], amount: Column, name: str, most: int = LAYER_ROWS, largest: int | None = None) -> DataFrame:
    """df with the sum of amount over the rows before each, in its group's order; order tells all rows of a group apart.

    largest: rows of the largest group, counted unless given.

    A group of more than `most` rows is ranked in parts: rows are dealt by ranges
    of group and order, summed within each part, and each part begins with the
    sum of the parts before it.
    """
    before = Window.unboundedPreceding, -1
    df = df.withColumn("_amount", amount)
    if (largest_group(df, group) if largest is None else largest) <= most:
        summed = F.sum("_amount").over(Window.partitionBy(group).orderBy(*order).rowsBetween(*before))
        return df.withColumn(name, F.coalesce(summed, F.lit(0).cast(df.schema["_amount"].dataType))).drop("_amount")
    dealt = settled(df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    own = F.sum("_amount").over(Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(*before))
    sums = dealt.groupBy(group, "_part").agg(F.sum("_amount").alias("_sum"))
    begun = F.sum("_sum").over(Window.partitionBy(group).orderBy("_part").rowsBetween(*before))
    begins = sums.select(group, "_part", F.coalesce(begun, F.lit(0)).alias("_begin"))
    kind = df.schema["_amount"].dataType
    return dealt.withColumn("_own", F.coalesce(own, F.lit(0))).join(begins, [group, "_part"]).withColumn(name, (F.col("_own") + F.col("_begin")).cast(kind)).drop("_amount", "_part", "_own", "_begin")


#: A layer whose largest degree is so many times its mean is ordered from its middle outwards.
CENTRAL = 2


def order_layers(placed: DataFrame, edges: DataFrame, passes: int = 2) -> DataFrame:
    """id, layer and place: vertices of a layer ordered by the mean place of their neighbours in other layers, nearer ones weighing more.

    A pass sweeps once with the neighbours in lower layers and once with those
    in higher ones; a sweep takes all places as the one before has left them, so
    it is one step for all layers. A vertex without such neighbours counts as
    where it is; ties go by id. Then layers of three vertices or more with a
    clear centre are ordered anew: the vertex of most neighbours in the middle,
    the others by turns behind and before it. placed: id, layer.
    """
    both = settled(edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct())
    one = F.lit(1).cast("int")
    placed = settled(placed.select("id", "layer"))
    largest = largest_group(placed, "layer")  # no sweep changes a layer
    state = settled(running(placed, "layer", ["id"], one, "before", largest=largest).select("id", "layer", (F.col("before") + 1).cast("int").alias("place")))
    for side in ("layer > to", "layer < to") * passes:
        other = state.select(F.col("id").alias("dst"), F.col("layer").alias("to"), F.col("place").alias("at"))
        near = both.join(other, "dst").join(state.select(F.col("id").alias("src"), "layer"), "src").filter(side).withColumn("w", 1 / F.abs(F.col("layer") - F.col("to")))
        mean = near.groupBy(F.col("src").alias("id")).agg(F.round(F.sum(F.col("w") * F.col("at")) / F.sum("w"), 9).alias("mean"))
        means = state.join(mean, "id", "left").withColumn("mean", F.coalesce("mean", F.col("place").cast("double"))).select("id", "layer", "mean")
        state = settled(running(means, "layer", ["mean", "id"], one, "before", largest=largest).select("id", "layer", (F.col("before") + 1).cast("int").alias("place")))
    return _from_the_middle(state, both, largest)


def _from_the_middle(state: DataFrame, both: DataFrame, largest: int) -> DataFrame:
    """state with the places of layers with a clear centre dealt from their middle outwards."""
    degree = both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    known = state.join(degree, "id", "left").withColumn("fewer", -F.coalesce("degree", F.lit(0)))
    clear = known.groupBy("layer").agg(F.count("*").alias("n"), F.min("fewer").alias("most"), F.sum("fewer").alias("all"))
    clear = clear.filter((F.col("n") > 2) & (F.col("all") < 0) & (F.col("most") * F.col("n") <= CENTRAL * F.col("all"))).select("layer", "n")
    ranked = running(known.select("id", "layer", "place", "fewer"), "layer", ["fewer", "place"], F.lit(1).cast("int"), "rank", largest=largest)
    middle, offset = F.floor((F.col("n") - 1) / 2), F.ceil(F.col("rank") / 2)
    dealt = middle + F.when(F.col("rank") % 2 == 1, offset).otherwise(-offset) + 1
    return ranked.join(clear, "layer", "left").select("id", "layer", F.coalesce(dealt, F.col("place")).cast("int").alias("place"))


def coordinates(placed: DataFrame, width: float = 300.0, gap: float = 20.0) -> DataFrame:
    """id, x and y: a column for each layer, the highest first, and within it one under the other by place; placed: id, layer, place, height."""
    top = placed.agg(F.max("layer").alias("top"))
    summed = running(placed, "layer", ["place"], (F.col("height") + gap).cast("double"), "y")
    return summed.join(F.broadcast(top)).select("id", ((F.col("top") - F.col("layer")) * width).alias("x"), "y")


def topological(order: list[str], depends: dict[str, list[str]]) -> list[str]:
    """Names so that each follows what it depends on; unknown ones are ignored, a cycle's members come last as declared."""
    done: list[str] = []
    left = list(order)
    while ready := [n for n in left if all(d in done or d not in order for d in depends.get(n, []))]:
        done.append(ready[0])
        left.remove(ready[0])
    return done + left
