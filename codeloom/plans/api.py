"""The named requests that a user of the reference can make, as queries."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators import metrics
from codeloom.plans import insights
from codeloom.plans.bindings import Bound
from codeloom.plans.registry import query
from codeloom.sources.cache import FetchCache


@query("api_packages", "SELECT DISTINCT package_id AS id FROM modules")
def packages(b: Bound) -> DataFrame:
    """Packages without their modules."""
    return b("modules").select(F.col("package_id").alias("id")).distinct()


@query("api_graph_summary", "SELECT m.package_id, m.id, m.name, (SELECT count(*) FROM imports i WHERE i.module_id = m.id) AS imports, (SELECT count(*) FROM exports e WHERE e.module_id = m.id) AS exports FROM modules m")
def graph_summary(b: Bound) -> DataFrame:
    """Slim modules with the sizes of what they hold."""
    counted = lambda name: b(name).groupBy(F.col("module_id").alias("id")).agg(F.count("*").alias(name))
    joined = b("modules").select("package_id", "id", "name").join(counted("imports"), "id", "left").join(counted("exports"), "id", "left")
    return joined.na.fill(0, ["imports", "exports"]).select("package_id", "id", "name", "imports", "exports")


def _children(b: Bound) -> DataFrame:
    """Modules with their imports, exports and findings, nested and in order."""
    lists = {
        "imports": b("imports").select(F.col("module_id").alias("id"), F.struct(F.col("seq").alias("at"), F.col("id").alias("child"), "source").alias("s")),
        "exports": b("exports").select(F.col("module_id").alias("id"), F.struct("name", F.col("id").alias("child"), "is_default").alias("s")),
        "issues": b("issues").select(F.col("module_id").alias("id"), F.struct(F.col("id").alias("at"), "rule_code", "severity").alias("s")),
    }
    whole = b("modules").select("id", "package_id", "name", "relative_path", "line_count")
    for name, rows in lists.items():
        whole = whole.join(rows.groupBy("id").agg(F.sort_array(F.collect_list("s")).alias(name)), "id", "left")
    return whole


def _told(name: str, field: str) -> Column:
    return F.coalesce(F.array_join(F.transform(name, lambda s: s[field].cast("string")), ","), F.lit("")).alias(name)


_LISTED = """coalesce((SELECT string_agg(source, ',' ORDER BY seq, i.id) FROM imports i WHERE i.module_id = m.id), '') AS imports,
    coalesce((SELECT string_agg(name, ',' ORDER BY name, e.id) FROM exports e WHERE e.module_id = m.id), '') AS exports,
    coalesce((SELECT string_agg(rule_code, ',' ORDER BY s.id) FROM issues s WHERE s.module_id = m.id), '') AS issues"""


@query("api_graph", f"SELECT m.id, package_id, m.name, relative_path, line_count, {_LISTED} FROM modules m")
def graph(b: Bound) -> DataFrame:
    """Whole modules with all that they hold; lists are told with commas."""
    return _children(b).select("id", "package_id", "name", "relative_path", "line_count", _told("imports", "source"), _told("exports", "name"), _told("issues", "rule_code"))


@query("api_modules_of_package", f"SELECT m.id, m.name, relative_path, {_LISTED} FROM modules m WHERE package_id = 'fr'")
def modules(b: Bound) -> DataFrame:
    return _children(b).filter("package_id = 'fr'").select("id", "name", "relative_path", _told("imports", "source"), _told("exports", "name"), _told("issues", "rule_code"))


@query("api_module_details", f"SELECT m.id, m.name, relative_path, line_count, {_LISTED} FROM modules m WHERE m.id = 'm17'")
def module_details(b: Bound) -> DataFrame:
    return _children(b).filter("id = 'm17'").select("id", "name", "relative_path", "line_count", _told("imports", "source"), _told("exports", "name"), _told("issues", "rule_code"))


@query("api_issues", "SELECT id, module_id, rule_code, severity FROM issues")
def issues(b: Bound) -> DataFrame:
    return b("issues").select("id", "module_id", "rule_code", "severity")


_OF_PACKAGE = re.sub(r"(?<![-\w])(modules|imports)\b", r"own_\1", insights.report_sql())


@query("api_insights_of_package", f"WITH own_modules AS (SELECT * FROM modules WHERE package_id = 'en'), own_imports AS (SELECT * FROM imports WHERE package_id = 'en') {_OF_PACKAGE}")
def package_insights(b: Bound) -> DataFrame:
    """All insights, with the modules and imports of one package only."""
    own = Bound(b.spark, b.sf_dir)
    own._made["modules"], own._made["imports"] = (b(name).filter("package_id = 'en'") for name in ("modules", "imports"))
    return insights.insights(own)


@query("api_metrics_latest", "SELECT entity_id, metric_key, metric_value FROM facts WHERE snapshot = (SELECT max(snapshot) FROM facts)")
def metrics_latest(b: Bound) -> DataFrame:
    newest = metrics.latest(b("facts").select(F.col("snapshot").alias("id"), F.col("snapshot").alias("created_at")).distinct()).select(F.col("id").alias("snapshot"))
    return b("facts").join(F.broadcast(newest), "snapshot", "left_semi").select("entity_id", "metric_key", "metric_value")


@query("api_metrics_snapshot", "SELECT entity_id, metric_key, metric_value FROM facts WHERE snapshot = 1997")
def metrics_snapshot(b: Bound) -> DataFrame:
    return b("facts").filter("snapshot = 1997").select("entity_id", "metric_key", "metric_value")


@query("api_metrics_diff", "SELECT snapshot, count(*) AS facts, sum(metric_value) AS total FROM facts WHERE snapshot IN (1996, 1997) GROUP BY 1")
def metrics_diff(b: Bound) -> DataFrame:
    """Both bundles; their difference is jn17."""
    return b("facts").filter(F.col("snapshot").isin(1996, 1997)).groupBy("snapshot").agg(F.count("*").alias("facts"), F.sum("metric_value").alias("total"))


@query("src13_cached_fetch", "SELECT package_id, count(*) AS modules FROM modules GROUP BY 1")
def cached(b: Bound) -> DataFrame:
    """The summary's route is gone, so the whole graph's serves; what it gave is kept for five minutes."""
    held = FetchCache()
    return held.fetch("graph", lambda: b("summary"), lambda: b("modules").groupBy("package_id").agg(F.count("*").alias("modules")))


@query("snk08_transaction", "SELECT n_nationkey AS id, n_regionkey AS region, count(*) OVER (PARTITION BY n_regionkey) AS nations, 2 AS version FROM nation WHERE n_regionkey <> 2")
def transaction(b: Bound) -> DataFrame:
    """Two tables, written as one version and changed as another; a writer that began at the first is turned away."""
    from codeloom.operators.graphs import checkpoint_folder
    from codeloom.sources.versions import Conflict, VersionedTables

    store = VersionedTables(b.spark, f"{checkpoint_folder(b.spark)}/codeloom-nation-{uuid.uuid4().hex}")
    rows = b("nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region"))
    counts = lambda df: df.groupBy("region").agg(F.count("*").alias("nations"))
    first = store.commit({"nations": rows, "regions": counts(rows)}, store.version())
    kept = store.read("nations").filter("region <> 2")
    store.commit({"nations": kept, "regions": counts(kept)}, first)
    try:
        store.commit({"nations": rows}, first)
    except Conflict:
        pass
    return store.read("nations").join(store.read("regions"), "region").withColumn("version", F.lit(store.version()))


@query("snk11_json_export", "SELECT 'r' || i AS kind, (SELECT count(*) FROM issues WHERE rule_code = 'r' || i) AS n FROM range(12) t(i) WHERE n > 0")
def json_export(b: Bound) -> DataFrame:
    """Insights written as JSON lines and read again."""
    from codeloom.operators.graphs import checkpoint_folder

    path = f"{checkpoint_folder(b.spark)}/codeloom-insights-{uuid.uuid4().hex}"
    b("issues").groupBy(F.col("rule_code").alias("kind")).agg(F.count("*").alias("n")).write.mode("overwrite").json(path)
    return b.spark.read.schema("kind string, n long").json(path)
