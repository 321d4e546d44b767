"""The dependency graph of a code model: its nodes, its edges of nine kinds, and views around one node."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators import graphs

#: Kinds of nodes, with the kind of what holds them.
HOLDERS = {"package": None, "module": "package", "class": "module", "interface": "module", "method": None, "property": None, "externalPackage": None}


def node_id(kind: Column | str, key: str) -> Column:
    return F.concat(kind if isinstance(kind, Column) else F.lit(kind), F.lit(":"), F.col(key).cast("string"))


def nodes(model: dict[str, DataFrame]) -> DataFrame:
    """id, kind and parent of every node of a model.

    model: packages (id), modules (id, package_id), classes and interfaces (id,
    module_id), members (id, kind, parent_id, parent_type) and externals (name);
    what is missing has no nodes. Ids begin with the node's kind.
    """
    parts = []
    for name, kind, holder, key in (("packages", "package", None, None), ("modules", "module", "package", "package_id"), ("classes", "class", "module", "module_id"), ("interfaces", "interface", "module", "module_id")):
        if name in model:
            parent = F.lit(None).cast("string") if holder is None else node_id(holder, key)
            parts.append(model[name].select(node_id(kind, "id").alias("id"), F.lit(kind).alias("kind"), parent.alias("parent")))
    if "members" in model:
        parts.append(model["members"].select(node_id(F.col("kind"), "id").alias("id"), "kind", node_id(F.col("parent_type"), "parent_id").alias("parent")))
    if "externals" in model:
        parts.append(model["externals"].select(node_id("externalPackage", "name").alias("id"), F.lit("externalPackage").alias("kind"), F.lit(None).cast("string").alias("parent")).distinct())
    return reduce(DataFrame.union, parts)


def edges(model: dict[str, DataFrame], existing: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """src, dst and kind of the model's edges, each once, whose ends are both among existing (id).

    model, beside what nodes() takes: package_dependencies (src, dst, kind),
    imports (src, dst), exports (src, dst: the module exported from),
    external_imports (src, name), scopes (name, kind: what package.json says of
    an external package, else an import), class_extends, interface_extends and
    implements (src, dst), references (src, src_kind, dst, dst_kind).
    kinds: those asked for; all unless given.
    """
    parts: list[DataFrame] = []

    def add(name: str, source: str, target: str, kind: Column | str) -> None:
        if name in model:
            parts.append(model[name].select(node_id(source, "src").alias("src"), node_id(target, "dst").alias("dst"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind")))

    add("package_dependencies", "package", "package", F.col("kind"))
    add("imports", "module", "module", "import")
    add("exports", "module", "module", "export")
    add("class_extends", "class", "class", "extends")
    add("interface_extends", "interface", "interface", "extends")
    add("implements", "class", "interface", "implements")
    if "external_imports" in model:
        told = model["external_imports"].join(model["scopes"], "name", "left") if "scopes" in model else model["external_imports"].withColumn("kind", F.lit(None).cast("string"))
        parts.append(told.select(node_id("module", "src").alias("src"), node_id("externalPackage", "name").alias("dst"), F.coalesce("kind", F.lit("import")).alias("kind")))
    if "references" in model:
        parts.append(model["references"].select(node_id(F.col("src_kind"), "src").alias("src"), node_id(F.col("dst_kind"), "dst").alias("dst"), F.lit("uses").alias("kind")))
    own = {k: model[k] for k in ("classes", "interfaces", "members") if k in model}
    if own:
        parts.append(nodes(own).select(F.col("parent").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind")))
    every = reduce(DataFrame.union, parts).distinct()
    if kinds is not None:
        every = every.filter(F.col("kind").isin(*kinds))
    ids = existing.select("id")
    there = every.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return there.filter((F.col("kind") != "import") | (F.col("src") != F.col("dst"))).select("src", "dst", "kind")


def shown(kind: Column, kinds: tuple[str, ...] = ()) -> Column:
    """Whether a walk takes an edge: of the kinds given, or, without any, of all but contains and uses; no kind is taken only then."""
    return F.coalesce(kind.isin(*kinds), F.lit(False)) if kinds else F.coalesce(~kind.isin("contains", "uses"), F.lit(True))


def traversal(edges: DataFrame, start: DataFrame, depth: int, folders: DataFrame, kinds: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """What some steps from a node reach: nodes (id, depth, inbound, outbound, folder) and the edges (src, dst, kind) among them.

    inbound and outbound tell the start's own neighbours; folders: id, folder.
    """
    taken = graphs.settled(edges.filter(shown(F.col("kind"), kinds)))
    reached = graphs.within(taken, start, depth)
    ways = taken.join(start.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"), F.lit(True).alias("out"))
    ways = ways.union(taken.join(start.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), F.lit(False).alias("out")))
    sides = ways.groupBy("id").agg(F.max(~F.col("out")).alias("inbound"), F.max("out").alias("outbound"))
    flagged = reached.join(sides, "id", "left").join(folders, "id", "left")
    found = flagged.select("id", "depth", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("inbound", "outbound")), "folder")
    ids = reached.select("id")
    return found, taken.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "kind")


def sides(found: DataFrame) -> DataFrame:
    """id and side of a start's neighbours; those on both sides go, in order of ids, to the side that has fewer, inbound if none has.

    found: what traversal() gives with one step. The counts are one row.
    """
    near = found.filter("inbound or outbound")
    counts = near.agg((F.count_if(F.col("outbound") & ~F.col("inbound")) - F.count_if(F.col("inbound") & ~F.col("outbound"))).alias("more_out"))
    both = F.col("both")
    lead, at = F.abs("more_out"), F.col("place")
    dealt = F.when(at < lead, F.when(F.col("more_out") >= 0, "inbound").otherwise("outbound")).when((at - lead) % 2 == 0, "inbound").otherwise("outbound")
    numbered = graphs.running(near.withColumn("both", F.col("inbound") & F.col("outbound")), "both", ["id"], F.lit(1), "place").join(F.broadcast(counts))
    return numbered.select("id", F.when(both, dealt).when(F.col("inbound"), "inbound").otherwise("outbound").alias("side"))


def drilldown(edges: DataFrame, parents: DataFrame, focus: str) -> DataFrame:
    """src, dst and kind of the contains and uses edges of a module's symbols, or of one class or interface.

    parents: id, parent. A module shows all that it holds, at any depth; a
    symbol itself and its members, with what uses or is used by these.
    """
    inside = graphs.below(parents, parents.filter(F.col("id") == focus))
    held = edges.filter("kind = 'contains'").join(inside.select(F.col("id").alias("dst")), "dst", "left_semi")
    held = held if focus.startswith("module:") else held.filter((F.col("src") == focus) | (F.col("dst") == focus))
    uses = edges.filter("kind = 'uses'")
    ends = [uses.join(inside.select(F.col("id").alias(c)), c, "left_semi").select("src", "dst", "kind") for c in ("src", "dst")]
    return held.select("src", "dst", "kind").union(ends[0].union(ends[1]).distinct())


def overview_edges(nodes: DataFrame, edges: DataFrame, collapsed: DataFrame, enabled: tuple[str, ...], at_least: int = 50) -> DataFrame:
    """src, dst, kind, kinds, n and hidden of what the overview draws.

    nodes: id, folder (or null), test; edges: src, dst, kind; collapsed: folder.
    Tests and their edges go; edges between folders become trunks with stubs;
    what lies in a collapsed folder goes to it; contains, uses and the enabled
    kinds are visible; edges of one pair are bundled, if there are so many.
    """
    left = nodes.filter(~F.coalesce("test", F.lit(False)))
    ends = left.select("id")
    kept = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "kind")
    lifted = graphs.lift(kept, left.select("id", "folder"))
    folder = F.concat(F.lit("folder:"), F.col("folder").cast("string"))
    parents = left.select(F.col("id").cast("string").alias("id"), folder.alias("parent"))
    drawn = graphs.collapse(lifted.select("src", "dst", "kind"), parents, collapsed.select(folder.alias("id")))[0]
    seen = F.col("kind").isNull() | F.col("kind").isin("contains", "uses", *enabled)
    told = drawn.withColumn("hidden", ~seen)
    bundled = graphs.bundle(told, at_least)
    visible = told.groupBy("src", "dst").agg(F.min("hidden").alias("all_hidden"))
    own = ~(F.col("kind").isNull() | F.col("kind").isin("contains", "uses", *enabled))
    return bundled.join(visible, ["src", "dst"]).withColumn("hidden", F.when(F.size("kinds") > 1, F.col("all_hidden")).otherwise(own)).drop("all_hidden")


def overview_nodes(nodes: DataFrame, edges: DataFrame, drawn: DataFrame, collapsed: DataFrame) -> DataFrame:
    """id, weight, layer, place, hidden and orphan of the overview's nodes and folders; nodes and edges as for overview_edges.

    Layers, weights and places are those of the graph without back edges. A
    folder has its nodes' greatest weight and mean place, and its layer among the
    folders. Nodes of collapsed folders are hidden; orphan tells that no drawn
    edge ends there.
    """
    left = graphs.settled(nodes.filter(~F.coalesce("test", F.lit(False))).select("id", "folder"))
    ends = left.select("id")
    kept = graphs.settled(edges.select("src", "dst").distinct().join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
    name = F.concat(F.lit("folder:"), F.col("folder").cast("string"))
    end = lambda c, to: left.select(F.col("id").alias(c), F.col("folder").alias(to))
    folders = left.filter("folder is not null").select(F.col("folder").alias("id")).distinct()

    def folder_layers() -> DataFrame:
        trunks = graphs.settled(kept.join(end("src", "a"), "src").join(end("dst", "z"), "dst").filter("a <> z").select(F.col("a").alias("src"), F.col("z").alias("dst")).distinct())
        order = trunks.join(graphs.back_edges(folders, trunks), ["src", "dst"], "left_anti")
        return graphs.layers(folders, graphs.settled(order)).select(F.col("id").alias("folder"), F.col("layer").cast("long").alias("layer"))

    def straight_edges() -> DataFrame:
        return graphs.settled(kept.join(graphs.back_edges(left, kept), ["src", "dst"], "left_anti"))

    straight, above = graphs.together(straight_edges, folder_layers)
    ordered, weights = graphs.together(lambda: graphs.order_layers(graphs.layers(left, straight), straight), lambda: graphs.weighted_depth(left, straight).select("id", "weight"))
    placed = ordered.join(weights, "id").join(left, "id")
    rolled = placed.filter("folder is not null").groupBy("folder").agg(F.max("weight").alias("weight"), F.avg("place").alias("place")).join(above, "folder")
    shut = left.join(collapsed.select("folder"), "folder", "left_semi").select("id").withColumn("shut", F.lit(True))
    own = placed.join(shut, "id", "left").select(F.col("id").cast("string").alias("id"), "weight", F.col("layer").cast("long").alias("layer"), F.col("place").cast("double").alias("place"), F.col("shut").isNotNull().alias("hidden"))
    every = own.union(rolled.select(name, "weight", "layer", "place", F.lit(False)))
    ended = drawn.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("ended", F.lit(True))
    return every.join(ended, "id", "left").select("id", "weight", "layer", "place", "hidden", F.col("ended").isNull().alias("orphan"))
