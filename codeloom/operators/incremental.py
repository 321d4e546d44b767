"""The import graph kept up to date: what an edit does not touch is neither parsed nor resolved again.

A store holds, for each module, a digest of its text and the path that imports
know it by; the paths that each module's imports mean; and the edges with the
path that made them. A refresh compares digests, parses the modules that are new
or differ, finds the paths that have gained, lost or changed the module behind
them, and resolves again only what the parsed modules mean and what others mean
by those paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators import resolve, sources_text
from codeloom.operators.graphs import settled
from codeloom.sources.versions import VersionedTables

MODULE = "id string, relative_path string, seq long, digest string, key string"
MEANT, EDGE = "src string, key string", "src string, key string, dst string"


@dataclass
class Refresh:
    """A refresh's edges (src, dst), the modules that it parsed (id), and the meant paths that it resolved (src, key)."""

    version: int
    edges: DataFrame
    parsed: DataFrame
    resolved: DataFrame


def _module_key(path: Column) -> Column:
    return paths.without_extension(paths.normalize(path))


def _meant(modules: DataFrame) -> DataFrame:
    """src and key of the paths that the internal imports of modules (id, relative_path, text) mean."""
    found = sources_text.imports(modules.select("id", "text")).select(F.col("module_id").alias("src"), "source").filter(paths.is_internal(F.col("source")))
    placed = found.join(modules.select(F.col("id").alias("src"), F.col("relative_path").alias("from_path")), "src")
    return placed.select("src", resolve.target_path(F.col("from_path"), F.col("source")).alias("key")).distinct()


def _owners(modules: DataFrame) -> DataFrame:
    """key and dst, the module that a path means: of several the last by seq, then by id."""
    return modules.groupBy("key").agg(F.max_by("id", F.struct("seq", "id")).alias("dst"))


def refresh(store: VersionedTables, modules: DataFrame) -> Refresh:
    """Brings the store to modules (id, relative_path, seq, text) and commits it; the first time everything is new.

    A null text imports nothing. ids are unique. Another writer's commit in the
    meantime is a versions.Conflict, and nothing changes.
    """
    spark, base = modules.sparkSession, store.version()
    read = lambda name, schema: store.read(name, base) if base else spark.createDataFrame([], schema)
    old, meant, edges = read("modules", MODULE), read("meant", MEANT), read("edges", EDGE)
    given = modules.select(F.col("id").cast("string").alias("id"), "relative_path", F.col("seq").cast("long").alias("seq"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), _module_key(F.col("relative_path")).alias("key"))
    given = settled(given)
    was = old.select("id", *(F.col(c).alias(f"old_{c}") for c in ("relative_path", "seq", "digest", "key")))
    both = given.join(was, "id", "full_outer")
    other = lambda c: ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    changed = settled(both.filter(other("relative_path") | other("digest") | other("seq")))
    stays = F.col("digest").isNotNull()
    again = settled(changed.filter(stays & (other("digest") | other("relative_path"))).select("id"))
    touched = settled(again.union(changed.filter(~stays).select("id")))

    text = modules.select(F.col("id").cast("string").alias("id"), "relative_path", "text").join(again, "id", "left_semi")
    fresh = settled(_meant(text))
    source = touched.withColumnRenamed("id", "src")
    kept = meant.join(source, "src", "left_anti").select("src", "key")

    placed = changed.filter(other("key") | other("seq"))
    names = placed.select(F.explode(F.array("key", "old_key")).alias("key")).filter("key is not null").distinct()
    before = _owners(old.join(names, "key", "left_semi")).withColumnRenamed("dst", "was")
    moved = settled(names.join(before, "key", "left").join(_owners(given.join(names, "key", "left_semi")), "key", "left").filter(~F.col("was").eqNullSafe(F.col("dst"))).select("key"))
    due = settled(fresh.union(kept.join(moved, "key", "left_semi").select("src", "key")))
    owners = _owners(given.join(due.select("key").distinct(), "key", "left_semi"))
    found = due.join(owners, "key").filter("src <> dst").select("src", "key", "dst")
    left = edges.join(source, "src", "left_anti").join(moved, "key", "left_anti").select("src", "key", "dst")
    version = store.commit({"modules": given, "meant": kept.union(fresh), "edges": left.union(found)}, base)
    return Refresh(version, store.read("edges", version).select("src", "dst").distinct(), again, due)
