"""Sorts, limits, set operations and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import scalars
from codeloom.operators import metrics, resolve
from codeloom.plans.bindings import Bound
from codeloom.plans.registry import query


@query("srt01_multi_key", "SELECT id, severity, rule_code FROM issues ORDER BY severity, rule_code, id")
def multi_key(b: Bound) -> DataFrame:
    return b("issues").select("id", "severity", "rule_code").orderBy("severity", "rule_code", "id")


@query("srt02_descending", "SELECT id, line_count FROM modules WHERE line_count > 200 ORDER BY line_count DESC")
def descending(b: Bound) -> DataFrame:
    return b("modules").filter("line_count > 200").select("id", "line_count").orderBy(F.desc("line_count"), "id")


@query("srt03_latest_row", "SELECT * FROM (SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderkey <> 5 ORDER BY 2 DESC, 1 DESC LIMIT 1)")
def latest(b: Bound) -> DataFrame:
    return metrics.latest(b("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")), other_than=5)


_LABEL = "concat(CASE WHEN seq % 2 = 0 THEN 'Item' ELSE 'item' END, seq % 7, CASE WHEN seq % 5 = 0 THEN '' ELSE concat('part', seq % 40, CASE WHEN seq % 40 < 3 THEN concat(repeat('0', 12), seq % 9) ELSE 'b' END) END)"


@query("srt04_natural_order", f"""WITH n AS (SELECT id, package_id, {_LABEL} AS name FROM modules),
    k AS (SELECT *, array_to_string(list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN lpad(t, 40, '0') ELSE t END), '') AS key FROM n)
    SELECT id, row_number() OVER (PARTITION BY package_id ORDER BY key, name <> lower(name), id) AS place FROM k""")
def natural(b: Bound) -> DataFrame:
    """Names in their letters' order whatever the case and accents, all numbers in them by value; then small letters first."""
    named = b("modules").select("id", "package_id", F.expr(_LABEL).alias("name"))
    order = Window.partitionBy("package_id").orderBy(*scalars.natural_order(F.col("name")), "id")
    return named.select("id", F.row_number().over(order).cast("long").alias("place"))


@query("srt05_stable_multi_key", "SELECT id, row_number() OVER (PARTITION BY package_id ORDER BY relative_path, id) AS place FROM modules")
def stable(b: Bound) -> DataFrame:
    return b("modules").select("id", F.row_number().over(Window.partitionBy("package_id").orderBy("relative_path", "id")).cast("long").alias("place"))


_DIFF = """a AS (SELECT * FROM facts WHERE snapshot = 1998), z AS (SELECT * FROM facts WHERE snapshot = 1996),
    d AS (SELECT entity_id, metric_key, coalesce(a.metric_value, 0) - coalesce(z.metric_value, 0) AS delta FROM a FULL JOIN z USING (entity_id, metric_key))"""


def _top(b: Bound, n: int) -> DataFrame:
    found = metrics.diff(b("facts").filter("snapshot = 1998"), b("facts").filter("snapshot = 1996")).select("entity_id", "metric_key", "delta")
    return metrics.top_by(found.withColumn("size", F.abs("delta")), "size", n, "entity_id", "metric_key").drop("size")


@query("top01_top10_delta", f"WITH {_DIFF} SELECT * FROM d WHERE delta <> 0 ORDER BY abs(delta) DESC, entity_id, metric_key LIMIT 10")
def top10(b: Bound) -> DataFrame:
    return _top(b, 10)


@query("top02_top50_delta", f"WITH {_DIFF} SELECT * FROM d WHERE delta <> 0 ORDER BY abs(delta) DESC, entity_id, metric_key LIMIT 50")
def top50(b: Bound) -> DataFrame:
    return _top(b, 50)


@query("top03_top30_complexity", "SELECT id, line_count FROM modules ORDER BY line_count DESC, id LIMIT 30")
def top30(b: Bound) -> DataFrame:
    return metrics.top_by(b("modules").select("id", "line_count"), "line_count", 30, "id")


@query("top04_top20_offenders", "SELECT module_id, count(*) AS n FROM imports GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top20(b: Bound) -> DataFrame:
    return metrics.top_by(b("imports").groupBy("module_id").agg(F.count("*").alias("n")), "n", 20, "module_id")


@query("top05_top_insights", "SELECT id, severity, (SELECT count(*) FROM issues) - 10 AS remaining FROM issues ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, id LIMIT 10")
def top_insights(b: Bound) -> DataFrame:
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    count = b("issues").agg((F.count("*") - 10).alias("remaining"))
    return b("issues").orderBy(rank, "id").limit(10).select("id", "severity").crossJoin(F.broadcast(count))


@query("top06_per_group_truncation", "SELECT rule_code, id FROM (SELECT rule_code, id, row_number() OVER (PARTITION BY rule_code ORDER BY id) AS r FROM issues) WHERE r <= 5")
def per_group(b: Bound) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("rule_code").orderBy("id"))
    return b("issues").select("rule_code", "id", place.alias("place")).filter("place <= 5").drop("place")


@query("set01_union_all", "SELECT id FROM classes UNION ALL SELECT id FROM members")
def union(b: Bound) -> DataFrame:
    return b("classes").select("id").union(b("members").select("id"))


@query("set02_first_wins", "SELECT arg_min(id, seq) AS id, module_id, source FROM imports GROUP BY module_id, source")
def first_wins(b: Bound) -> DataFrame:
    return resolve.first_by(b("imports"), ["module_id", "source"], [F.col("seq")]).select("id", "module_id", "source")


@query("set03_last_wins", "SELECT arg_max(id, seq) AS id, module_id, source FROM imports GROUP BY module_id, source")
def last_wins(b: Bound) -> DataFrame:
    return b("imports").groupBy("module_id", "source").agg(F.max_by("id", "seq").alias("id"))


@query("set04_symmetric_difference", "(SELECT src AS id FROM edges EXCEPT SELECT dst FROM acyclic) UNION (SELECT dst FROM acyclic EXCEPT SELECT src FROM edges)")
def symmetric(b: Bound) -> DataFrame:
    a, z = b("edges").select(F.col("src").alias("id")).distinct(), b("acyclic").select(F.col("dst").alias("id")).distinct()
    return a.exceptAll(z).union(z.exceptAll(a))


@query("set06_snapshot_row_diff", """WITH a AS (SELECT seq AS id, (seq % 10)::DOUBLE AS x, 0.0::DOUBLE AS y, directory AS parent, line_count::DOUBLE AS size FROM modules WHERE seq % 9 <> 0),
    z AS (SELECT seq AS id, (seq % 10 + CASE WHEN seq % 5 = 0 THEN 2 ELSE 0.5 END)::DOUBLE AS x, 0.0::DOUBLE AS y, CASE WHEN seq % 7 = 0 THEN 'else' ELSE directory END AS parent, (line_count + CASE WHEN seq % 4 = 0 THEN 3 ELSE 0 END)::DOUBLE AS size FROM modules),
    c AS (SELECT z.id, CASE WHEN a.id IS NULL THEN 'added' WHEN a.parent <> z.parent THEN 'reparented' WHEN abs(z.x - a.x) > 1 THEN 'moved' WHEN abs(z.size - a.size) > 1 THEN 'resized' END AS change FROM z LEFT JOIN a USING (id)) SELECT * FROM c WHERE change IS NOT NULL""")
def row_diff(b: Bound) -> DataFrame:
    s, m = F.col("seq"), b("modules")
    before = m.filter(s % 9 != 0).select(s.alias("id"), (s % 10).cast("double").alias("x"), F.lit(0.0).alias("y"), F.col("directory").alias("parent"), F.col("line_count").cast("double").alias("size"))
    after = m.select(
        s.alias("id"), (s % 10 + F.when(s % 5 == 0, 2.0).otherwise(0.5)).alias("x"), F.lit(0.0).alias("y"), F.when(s % 7 == 0, "else").otherwise(F.col("directory")).alias("parent"),
        (F.col("line_count") + F.when(s % 4 == 0, 3).otherwise(0)).cast("double").alias("size"),
    )
    return metrics.changed(before, after)
