"""Analyzers in order of what they need, each alone in its failures."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import scalars
from codeloom.operators import complexity, entities, graphs, resolve, rules, sources_text
from codeloom.operators.graphs import topological

#: What analyzers give, by name: metrics (entity_id, metric_key, metric_value) and rows of other kinds.
BUCKETS = ("metrics", "findings", "callEdges", "cycles", "duplications", "architecturalViolations", "moduleStats", "entityStats")
#: From modules (doc_id, text, and relative_path where paths count) to metrics, or to frames by bucket.
Analyzer = Callable[[DataFrame], "DataFrame | dict[str, DataFrame]"]


def _long(df: DataFrame, id_column: str, values: dict) -> DataFrame:
    """One row for each entity and metric; the values are columns before they become rows, so that what they share is found once."""
    beside = df.select(F.col(id_column).cast("string").alias("entity_id"), *(v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values())))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("metric_key"), F.col(f"v{i}").alias("metric_value")) for i, k in enumerate(values)))).alias("m")
    return beside.select("entity_id", pairs).select("entity_id", "m.*")


def _counted(modules: DataFrame, bare: Column, values: Callable[[Column, Column], dict[str, Column]], derived: dict[str, Column], prefix: str) -> DataFrame:
    """Metrics of texts and of what is left of each (bare), which is made once; derived: values that follow from the others by name."""
    counts = values(F.col("text"), F.col("bare"))
    each = modules.select("doc_id", "text", bare.alias("bare")).select("doc_id", *(v.alias(k) for k, v in counts.items() if k not in derived))
    return _long(each, "doc_id", {f"{prefix}.{k}": derived.get(k, F.col(k)) for k in counts})


def _size(modules: DataFrame) -> DataFrame:
    derived = {"comment_lines": F.col("physical_lines") - F.col("logical_lines") - F.col("blank_lines")}
    return _counted(modules, sources_text.without_comments(F.col("text")), sources_text.sizes, derived, "size")


def _named(modules: DataFrame) -> DataFrame:
    return modules.select(F.col("doc_id").cast("string").alias("id"), "text")


def _complexity(modules: DataFrame) -> DataFrame:
    found = complexity.functions(_named(modules))
    entity = F.concat_ws(":", "module_id", "parent", "name")
    return _long(found.withColumn("entity", entity), "entity", {f"complexity.{k}": F.col(k) for k in ("cyclomatic", "cognitive", "nesting", "lines", "params")})


def _duplication(modules: DataFrame) -> dict[str, DataFrame]:
    found = graphs.settled(sources_text.clone_pairs(_named(modules)))
    return {"metrics": _long(sources_text.duplicated_lines(found), "module_id", {"duplication.duplicatedLineCount": F.col("lines")}), "duplications": found}


def _type_safety(modules: DataFrame) -> dict[str, DataFrame]:
    """Counts of loose types, and patches of the parameters that are any without saying so."""
    loose = entities.implicit_any(_named(modules))
    patches = loose.select(F.concat_ws(":", "module_id", "parent", "method", "parameter").alias("entity_id"), F.lit("parameter").alias("entity_type"), F.lit(True).alias("is_implicit_any"))
    derived = {"any_density": F.col("any_count") / F.greatest("identifiers", F.lit(1))}
    bare = sources_text.without_comments(sources_text.without_strings(F.col("text")))
    return {"metrics": _counted(modules, bare, sources_text.type_safety, derived, "typeSafety"), "entityStats": patches}


def _rules(modules: DataFrame) -> dict[str, DataFrame]:
    return {"findings": rules.run_rules({"properties": entities.properties(_named(modules))})}


def _calls(modules: DataFrame) -> dict[str, DataFrame]:
    named = _named(modules)
    shapes = graphs.settled(entities.calling(named))
    functions = entities.functions(shapes).select(F.concat_ws(":", "module_id", "name").alias("id"), "module_id", "name")
    methods = entities.methods(shapes).filter("parent_type = 'class'").select(F.concat_ws(":", "module_id", "parent", "name").alias("id"), "module_id", "name")
    return {"callEdges": resolve.call_edges(named, functions, methods, shapes)}


def _imports(modules: DataFrame) -> DataFrame:
    """The import graph of modules by their relative paths."""
    placed = modules.select(F.col("doc_id").cast("string").alias("id"), "relative_path", F.col("doc_id").cast("string").alias("seq"))
    imports = sources_text.imports(_named(modules)).select("module_id", "source").distinct()
    return resolve.import_edges(imports.join(placed.select(F.col("id").alias("module_id"), F.col("relative_path").alias("from_path")), "module_id"), placed)


def _coupling(modules: DataFrame) -> DataFrame:
    found = graphs.degrees(modules.select(F.col("doc_id").cast("string").alias("id")), _imports(modules))
    instability = scalars.ratio(F.col("fan_out"), F.col("fan_in") + F.col("fan_out"))
    return _long(found, "id", {"coupling.afferent": F.col("fan_in"), "coupling.efferent": F.col("fan_out"), "coupling.instability": instability})


def _cycles(modules: DataFrame) -> dict[str, DataFrame]:
    return {"cycles": graphs.strongly_connected(modules.select(F.col("doc_id").cast("string").alias("id")), graphs.settled(_imports(modules)))}


#: Analyzers by name: what they depend on, and how they turn modules into facts. Linters run elsewhere; rules.unused_code reads their reports.
ANALYZERS: dict[str, tuple[list[str], Analyzer]] = {
    "maintainability": (["size"], lambda d: _long(d, "doc_id", {"maintainability.index": sources_text.maintainability(F.col("text"))})),
    "size": ([], _size),
    "type-safety": ([], _type_safety),
    "documentation": ([], lambda d: _long(d, "doc_id", {f"documentation.{k}": v for k, v in sources_text.doc_coverage(F.col("text")).items()})),
    "complexity": ([], _complexity),
    "duplication": ([], _duplication),
    "legacy-rules": ([], _rules),
    "call-graph": ([], _calls),
    "coupling": ([], _coupling),
    "dep-cruiser": (["coupling"], _cycles),
}


def run_pipeline(
    spark: SparkSession, docs: DataFrame, disabled: tuple[str, ...] = (), allowed: tuple[str, ...] = (), analyzers: dict[str, tuple[list[str], Analyzer]] | None = None
) -> tuple[DataFrame | None, DataFrame]:
    """The metrics of run_buckets, and the analyzers' status."""
    buckets, status = run_buckets(spark, docs, disabled, allowed, analyzers)
    return buckets.get("metrics"), status


def run_buckets(
    spark: SparkSession, docs: DataFrame, disabled: tuple[str, ...] = (), allowed: tuple[str, ...] = (), analyzers: dict[str, tuple[list[str], Analyzer]] | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """All rows by bucket, with the analyzer that gave them, and the status of each analyzer's buckets.

    Status: place, analyzer, bucket, status (ok, skipped or error) and seconds.
    Each bucket is computed and kept here, within its own try and with its own
    time: one that fails, when it is planned or when its rows are made, leaves
    all others alone. An analyzer that is skipped, or fails before it names its
    buckets, has one row without a bucket.
    """
    analyzers = ANALYZERS if analyzers is None else analyzers
    order = topological(list(analyzers), {n: d for n, (d, _) in analyzers.items()})
    parts: dict[str, list[DataFrame]] = {}
    status = []
    for place, name in enumerate(order):
        if name in disabled or (allowed and name not in allowed):
            status.append((place, name, None, "skipped", 0.0))
            continue
        began = time.monotonic()
        try:
            made = analyzers[name][1](docs)
            made = made if isinstance(made, dict) else {"metrics": made}
            if unknown := set(made) - set(BUCKETS):
                raise ValueError(f"unknown buckets {sorted(unknown)}")
        except Exception as error:  # noqa: BLE001  one analyzer's failure is its own
            status.append((place, name, None, f"error: {type(error).__name__}", time.monotonic() - began))
            continue
        for bucket, frame in made.items():
            try:
                parts.setdefault(bucket, []).append(graphs.settled(frame.withColumn("analyzer", F.lit(name))))
                status.append((place, name, bucket, "ok", time.monotonic() - began))
            except Exception as error:  # noqa: BLE001  and one bucket's too
                status.append((place, name, bucket, f"error: {type(error).__name__}", time.monotonic() - began))
            began = time.monotonic()
    joined = {bucket: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) for bucket, frames in parts.items() if frames}
    return joined, spark.createDataFrame(status, "place int, analyzer string, bucket string, status string, seconds double")
