"""Name and path resolution by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators import entities, graphs, sources_text


def target_path(from_path: Column, source: Column) -> Column:
    """The normal path that an internal import means; aliases start at src/, all else at the importer's folder."""
    aliased = F.regexp_replace(source, "^@/", "src/")
    rooted = aliased.startswith("src/")
    return paths.without_extension(F.when(rooted, paths.normalize(aliased)).otherwise(paths.join_path(paths.dirname(from_path), aliased)))


def import_edges(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Distinct (src, dst) of internal imports that name another module.

    imports: module_id, from_path, source; modules: id, relative_path, seq. Of
    modules with one normal path the last by seq counts.
    """
    keyed = modules.groupBy(paths.without_extension(paths.normalize(F.col("relative_path"))).alias("key")).agg(F.max_by("id", "seq").alias("dst"))
    wanted = imports.filter(paths.is_internal(F.col("source"))).select(F.col("module_id").alias("src"), target_path(F.col("from_path"), F.col("source")).alias("key")).distinct()
    return wanted.join(keyed, "key").filter("src <> dst").select("src", "dst").distinct()


def ranked_candidates(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """id and dst of relative imports: the first existing file of the exact path, the extensions, the index files."""
    relative = imports.filter(F.col("source").startswith("."))
    tries = relative.select("id", F.posexplode(paths.candidates(paths.join_path(paths.dirname(F.col("from_path")), F.col("source")))).alias("rank", "relative_path"))
    found = tries.join(modules.select(F.col("id").alias("dst"), "relative_path"), "relative_path")
    return found.groupBy("id").agg(F.min_by("dst", F.struct("rank", "dst")).alias("dst"))


def package_then_global(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """id and dst of internal imports: for each candidate the importer's package first, then all packages if one module fits.

    Each package's paths are tried once, whoever imports them, and one lookup
    serves both: by package and path, and by path alone under no package's name.
    """
    own = modules.select(F.col("id").alias("dst"), "package_id", F.explode(paths.variants(F.col("relative_path"))).alias("path"))
    local = own.groupBy("package_id", "path").agg(F.min("dst").alias("dst"), F.count_distinct("dst").alias("n"))
    everywhere = local.groupBy("path").agg(F.min("dst").alias("dst"), F.sum("n").alias("n")).filter("n = 1")
    found = local.select(F.struct("package_id").alias("scope"), "path", "dst").union(everywhere.select(F.lit(None).cast("struct<package_id:string>"), "path", "dst"))
    wanted = imports.filter(paths.is_internal(F.col("source"))).select("id", "package_id", target_path(F.col("from_path"), F.col("source")).alias("target"))
    tries = wanted.select("package_id", "target").distinct().select("package_id", "target", F.posexplode(paths.candidates(F.col("target"))).alias("rank", "path"))
    both = F.posexplode(F.array(F.struct("package_id"), F.lit(None).cast("struct<package_id:string>"))).alias("wide", "scope")
    each = tries.select("package_id", "target", "path", "rank", both)
    hits = each.join(found, each["path"].eqNullSafe(found["path"]) & each["scope"].eqNullSafe(found["scope"]))
    best = hits.groupBy("package_id", "target").agg(F.min_by("dst", 2 * F.col("rank") + F.col("wide")).alias("dst"))
    return wanted.join(best, ["package_id", "target"]).select("id", "dst")


def unique_name(references: DataFrame, entities: DataFrame) -> DataFrame:
    """references with status and target_id: resolved if one entity has the name, ambiguous if several, else unresolved."""
    named = entities.groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("one"))
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return references.join(named, "name", "left").select(*references.columns, status.alias("status"), F.when(F.col("n") == 1, F.col("one")).alias("target_id"))


def member(usages: DataFrame, members: DataFrame) -> DataFrame:
    """usages (id, owner_id, qualifier_id, name) with target_id: the qualifier's member of that name, 'this' being the owner, else the only member so called."""
    direct = members.groupBy("parent_id", "name").agg(F.min("id").alias("direct"))
    alone = members.groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("alone")).filter("n = 1").drop("n")
    placed = usages.withColumn("parent_id", F.coalesce("qualifier_id", "owner_id"))
    return placed.join(direct, ["parent_id", "name"], "left").join(alone, "name", "left").select("id", F.coalesce("direct", "alone").alias("target_id"))


def call_targets(calls: DataFrame, functions: DataFrame, methods: DataFrame) -> DataFrame:
    """id, status and target_id of calls (id, name, qualified): methods first for qualified calls, else functions first."""
    return _targeted(calls, functions, methods).select("id", "status", "target_id")


def _targeted(calls: DataFrame, functions: DataFrame, methods: DataFrame) -> DataFrame:
    """calls (name, qualified and more) with status and target_id."""

    def counted(entities: DataFrame, as_: str) -> DataFrame:
        return entities.groupBy("name").agg(F.count_distinct("id").alias(f"{as_}_n"), F.min("id").alias(f"{as_}_id"))

    both = calls.join(counted(functions, "f"), "name", "left").join(counted(methods, "m"), "name", "left")
    prefer = F.col("qualified") & F.col("m_n").isNotNull() | F.col("f_n").isNull()
    n, one = F.when(prefer, F.col("m_n")).otherwise(F.col("f_n")), F.when(prefer, F.col("m_id")).otherwise(F.col("f_id"))
    status = F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved")
    return both.select(*calls.columns, status.alias("status"), F.when(n == 1, one).alias("target_id"))


def _outside(modules: DataFrame) -> DataFrame:
    """module_id and name of what each module imports from packages."""
    return sources_text.imports(modules).filter(~paths.is_internal(F.col("source"))).select("module_id", F.col("local").alias("name")).distinct().withColumn("outside", F.lit(True))


def call_graph(modules: DataFrame, functions: DataFrame, methods: DataFrame) -> DataFrame:
    """module_id, name, qualified, status and target_id of every module's calls: resolved, ambiguous, unresolved, or external.

    modules: id, text; functions, methods: id, name. A name that the module
    imports from a package is external, whatever else is called so.
    """
    calls = entities.calls(modules)
    found = _targeted(calls, functions, methods).join(_outside(modules), ["module_id", "name"], "left")
    mine = F.col("outside").isNull() | F.col("qualified")
    return found.select("module_id", "name", "qualified", F.when(mine, F.col("status")).otherwise("external").alias("status"), F.when(mine, F.col("target_id")).alias("target_id"))


def call_edges(modules: DataFrame, functions: DataFrame, methods: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """A row for each call that stands in a known function: who calls, what, where, and what it means.

    module_id, source_id, source_type, name, qualifier, line, is_awaited,
    is_async, status and target_id. functions and methods: id, module_id, name.
    scanned: the modules' shapes, if they are made already.
    The caller is the innermost function around the call, if that has a name and
    its module has one such method, or one such function and else one such
    method; other calls are left out, and of several calls of a name in one line
    by one caller the first stays. is_async: awaited, or called in an async
    function.
    """
    sites = entities.call_sites(modules if scanned is None else scanned).filter("in_name is not null")
    one = lambda df, kind: df.groupBy("module_id", F.col("name").alias("in_name")).agg(F.min("id").alias(f"{kind}_id"), F.count_distinct("id").alias("n")).filter("n = 1").drop("n")
    known = sites.join(one(methods, "method"), ["module_id", "in_name"], "left").join(one(functions, "function"), ["module_id", "in_name"], "left")
    own = F.when(F.col("in_kind") != "method", F.col("function_id"))
    named = known.withColumn("source_id", F.coalesce(own, "method_id")).filter("source_id is not null").withColumn("source_type", F.when(own.isNotNull(), "function").otherwise("method"))
    first = named.groupBy("module_id", "source_id", "source_type", "name", "line").agg(
        F.min_by(F.struct("qualifier", "is_awaited", (F.col("is_awaited") | F.col("in_async")).alias("is_async")), F.struct(F.coalesce("qualifier", F.lit("")), "is_awaited")).alias("call")
    )
    # The calls are asked for their names and joined with what these mean, but placed once.
    each = graphs.settled(first.select("module_id", "source_id", "source_type", "name", "line", "call.*").withColumn("qualified", F.col("qualifier").isNotNull()))
    targets = _targeted(each.select("name", "qualified").distinct(), functions.select("id", "name"), methods.select("id", "name"))
    found = each.join(targets, ["name", "qualified"]).join(_outside(modules), ["module_id", "name"], "left")
    mine = F.col("outside").isNull() | F.col("qualified")
    return found.select(
        "module_id", "source_id", "source_type", "name", "qualifier", "line", "is_awaited", "is_async", F.when(mine, F.col("status")).otherwise("external").alias("status"), F.when(mine, F.col("target_id")).alias("target_id")
    )


def suffixes(path: Column) -> Column:
    """A path and what follows each of its slashes: the keys under which a report may name it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def by_suffix(reported: DataFrame, modules: DataFrame) -> DataFrame:
    """reported paths with the module whose path ends in them, or in which they end; the longest agreement, then the first id, wins.

    Both sides are cut at their slashes, so this is an equi join on suffixes and not a comparison of all pairs.
    """
    one = modules.select(F.col("id").alias("module_id"), "relative_path")
    longer = one.select("module_id", F.explode(suffixes(F.col("relative_path"))).alias("key"))
    hits = reported.withColumn("key", F.col("path")).join(longer, "key").select("path", "module_id", F.length("key").alias("n"))
    shorter = reported.select("path", F.explode(suffixes(F.col("path"))).alias("relative_path")).join(one, "relative_path")
    hits = hits.union(shorter.select("path", "module_id", F.length("relative_path").alias("n")))
    return hits.groupBy("path").agg(F.min_by("module_id", F.struct(-F.col("n"), F.col("module_id"))).alias("module_id"))


def tiered(reported: DataFrame, modules: DataFrame) -> DataFrame:
    """reported paths with a module: by the path as it is, without leading ./ or /, below src/, or by its file name if one module has it."""
    own = modules.select(F.col("id").alias("module_id"), F.col("relative_path").alias("key"))
    bare = F.regexp_replace(F.col("path"), r"^(\./|/)+", "")
    tries = reported.select("path", F.posexplode(F.array(F.col("path"), bare, F.concat(F.lit("src/"), bare))).alias("rank", "key"))
    exact = tries.join(own, "key").select("path", "rank", "module_id")
    name = F.substring_index("key", "/", -1)
    alone = own.groupBy(name.alias("key")).agg(F.count("*").alias("n"), F.min("module_id").alias("module_id")).filter("n = 1").drop("n")
    last = reported.select("path", F.substring_index("path", "/", -1).alias("key")).join(alone, "key").select("path", F.lit(9).alias("rank"), "module_id")
    return exact.union(last).groupBy("path").agg(F.min_by("module_id", F.struct("rank", "module_id")).alias("module_id"))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the order."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_at", at).filter("_at = 1").drop("_at")
