"""Entities of source text: classes, interfaces, members, functions, types, enums and calls, with where each stands.

A scan (`shapes`) tells the stretches of declarations, functions and calls; what
belongs to what is the innermost stretch around it. Every function here takes
modules (id, text), or what `scanned` made of them once for several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators import shapes


#: The kinds that functions, methods, calls and what stands around them are made of.
CALLING = ("class", "interface", "method", "function", "closure", "call")


def scanned(modules: DataFrame, *kinds: str) -> DataFrame:
    """The shapes of modules, of these kinds if any are given; shapes stay as they are."""
    return modules if "kind" in modules.columns else shapes.shapes(modules, *kinds)


def calling(modules: DataFrame) -> DataFrame:
    """The shapes of functions, methods and the calls in them; a text that can hold no function is left out."""
    return scanned(modules.filter(shapes.may_hold(F.col("text"), "function", "method", "closure")), *CALLING)


def _of(modules: DataFrame, *kinds: str) -> DataFrame:
    return scanned(modules, *kinds).filter(F.col("kind").isin(*kinds))


def _has(word: str) -> Column:
    return F.array_contains("mods", word)


def classes(modules: DataFrame) -> DataFrame:
    return _of(modules, "class").select("module_id", "name", "extends", F.col("others").alias("implements"))


def interfaces(modules: DataFrame) -> DataFrame:
    return _of(modules, "interface").select("module_id", "name", F.col("others").alias("extends"))


def members(modules: DataFrame, *kinds: str) -> DataFrame:
    """Shapes of members with parent and parent_type, the class or interface in whose body they stand."""
    found = scanned(modules, "class", "interface", *kinds)
    held = [c for c in found.columns if c != "module_id"]
    placed = shapes.within(found, F.col("kind").isin(*kinds), held, F.col("kind").isin("class", "interface"), ["name", "kind"])
    return placed.withColumnRenamed("in_name", "parent").withColumnRenamed("in_kind", "parent_type")


def visibility() -> Column:
    """What is written, public if nothing is."""
    return F.when(_has("private"), "private").when(_has("protected"), "protected").otherwise("public").alias("visibility")


def methods(modules: DataFrame) -> DataFrame:
    """Members with a body or a signature, and those whose value or type is a function."""
    made = members(modules, "method")
    return made.select(
        "module_id", "parent", "parent_type", "name", visibility(), _has("async").alias("is_async"), _has("static").alias("is_static"),
        "params", "n_params", F.col("type").alias("return_type"), "line", "last_line", "documented",
    )


def properties(modules: DataFrame) -> DataFrame:
    """Members that are no functions; place counts them within their parent."""
    made = members(modules, "property")
    by = ("module_id", "parent", "parent_type")
    listed = made.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("begin", "name", visibility(), "type"))).alias("listed"))
    return listed.select(*by, F.posexplode("listed").alias("place", "p")).select(*by, "place", "p.name", "p.visibility", "p.type")


def implicit_any(modules: DataFrame) -> DataFrame:
    """module_id, parent, method and parameter of what classes' methods take without a type, a default or a rest that would tell one.

    Constructors, accessors, functions in properties and patterns don't count;
    of methods of one name in a class the parameters are put together.
    """
    own = members(modules, "method").filter((F.col("parent_type") == "class") & (F.col("name") != "constructor") & ~F.arrays_overlap("mods", F.array(F.lit("get"), F.lit("set"), F.lit("value"))))
    each = own.select("module_id", "parent", F.col("name").alias("method"), F.explode("params").alias("p"))
    return each.filter("p.type is null and not p.has_default and not p.is_rest").select("module_id", "parent", "method", F.col("p.name").alias("parameter")).distinct()


def functions(modules: DataFrame) -> DataFrame:
    """Exported functions, each name once for a module."""
    made = _of(modules, "function").filter(_has("export"))
    first = made.groupBy("module_id", "name").agg(F.min_by(F.struct(_has("async").alias("is_async"), "params", "n_params", F.col("type").alias("return_type"), "line", "last_line", "documented"), "begin").alias("f"))
    return first.select("module_id", "name", "f.*")


def type_aliases(modules: DataFrame) -> DataFrame:
    """Exported types: their body in one line and their parameters as JSON."""
    made = _of(modules, "type").filter(_has("export"))
    return made.select("module_id", "name", "body", F.to_json("others").alias("type_parameters_json"))


def enums(modules: DataFrame) -> DataFrame:
    """Exported enums with their members and values as JSON."""
    made = _of(modules, "enum").filter(_has("export"))
    members = F.transform("others", lambda e: F.struct(F.regexp_extract(e, r"^['\"]?([\w$-]+)", 1).alias("name"), F.nullif(F.trim(F.regexp_extract(e, r"=(.*)$", 1)), F.lit("")).alias("value")))
    return made.select("module_id", "name", F.to_json(members).alias("members_json"))


def calls(modules: DataFrame) -> DataFrame:
    """id, module_id, name and qualified (called as a member) of the calls of each module, each once; constructors are left out."""
    made = _of(modules, "call").select("module_id", "name", F.col("type").isNotNull().alias("qualified")).distinct()
    return made.select(F.concat_ws(":", "module_id", F.col("qualified").cast("string"), "name").alias("id"), "module_id", "name", "qualified")


def call_sites(modules: DataFrame) -> DataFrame:
    """module_id, line, name, qualifier, is_awaited and the innermost function around each call: in_kind, in_name, in_async; null outside all functions."""
    surrounding = ("function", "method", "closure")
    found = scanned(modules, *surrounding, "call").select("module_id", "kind", "name", "begin", "stop", "line", F.col("type").alias("qualifier"), _has("await").alias("is_awaited"), _has("async").alias("async"))
    return shapes.within(found, F.col("kind") == "call", ["line", "name", "qualifier", "is_awaited"], F.col("kind").isin(*surrounding), ["kind", "name", "async"])
