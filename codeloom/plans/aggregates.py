"""Aggregations, pivots and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths, scalars
from codeloom.operators import graphs, metrics
from codeloom.plans.bindings import Bound
from codeloom.plans.registry import query


@query("agg01_group_having", "SELECT method_id AS id, count(*) AS n FROM parameters GROUP BY 1 HAVING count(*) >= 4")
def having(b: Bound) -> DataFrame:
    return b("parameters").groupBy(F.col("method_id").alias("id")).agg(F.count("*").alias("n")).filter("n >= 4")


@query("agg02_conditional_ratio", "SELECT parent_id AS id, sum(CASE WHEN visibility = 'public' THEN 1 ELSE 0 END)::BIGINT AS public, count(*) AS total FROM members GROUP BY 1 HAVING public * 1.0 / total > 0.8 AND total >= 5")
def conditional_ratio(b: Bound) -> DataFrame:
    return b("members").groupBy(F.col("parent_id").alias("id")).agg(F.count_if(F.col("visibility") == "public").alias("public"), F.count("*").alias("total")).filter("public / total > 0.8 and total >= 5")


@query("agg03_conditional_count", "SELECT module_id AS id, count(*) FILTER (is_type_only) AS types, count(*) AS total FROM imports GROUP BY 1 HAVING types > 0")
def conditional_count(b: Bound) -> DataFrame:
    return b("imports").groupBy(F.col("module_id").alias("id")).agg(F.count_if("is_type_only").alias("types"), F.count("*").alias("total")).filter("types > 0")


@query("agg04_max_depth", "WITH RECURSIVE a AS (SELECT class_id AS id, parent_id AS up, 1 AS d FROM extends UNION ALL SELECT a.id, e.parent_id, a.d + 1 FROM a JOIN extends e ON e.class_id = a.up) SELECT id, max(d)::INT AS depth FROM a GROUP BY id")
def max_depth(b: Bound) -> DataFrame:
    up = graphs.ancestors(b("extends").select(F.col("class_id").alias("id"), F.col("parent_id").alias("parent")))
    return up.groupBy("id").agg(F.max("distance").alias("depth"))


@query("agg05_count_distinct", "SELECT module_id AS id, count(DISTINCT source) AS n FROM imports WHERE source LIKE 'pkg%' OR source LIKE '@scope%' GROUP BY 1 HAVING n >= 8")
def distinct(b: Bound) -> DataFrame:
    outside = b("imports").filter(F.col("source").startswith("pkg") | F.col("source").startswith("@scope"))
    return outside.groupBy(F.col("module_id").alias("id")).agg(F.count_distinct("source").alias("n")).filter("n >= 8")


@query("agg06_health_score", "SELECT entity_id, count(*) FILTER (severity = 'error') AS critical, count(*) FILTER (severity = 'warn') AS warning, greatest(0, 100 - 5 * count(*) FILTER (severity = 'error') - 2 * count(*) FILTER (severity = 'warn'))::BIGINT AS health FROM issues GROUP BY ROLLUP (entity_id)")
def health(b: Bound) -> DataFrame:
    """Of all findings, with no entity, and of each entity's."""
    counts = b("issues").rollup("entity_id").agg(F.count_if(F.col("severity") == "error").alias("critical"), F.count_if(F.col("severity") == "warn").alias("warning"))
    return counts.withColumn("health", F.greatest(F.lit(0), 100 - 5 * F.col("critical") - 2 * F.col("warning")).cast("long"))


@query("agg07_by_category", "SELECT coalesce(nullif(CASE WHEN rule_code = 'r3' THEN '' WHEN rule_code = 'r4' THEN NULL ELSE rule_code END, ''), 'uncategorized') AS category, count(*) AS n FROM issues GROUP BY 1")
def by_category(b: Bound) -> DataFrame:
    raw = F.when(F.col("rule_code") == "r3", "").when(F.col("rule_code") != "r4", F.col("rule_code"))
    return b("issues").groupBy(F.coalesce(F.nullif(raw, F.lit("")), F.lit("uncategorized")).alias("category")).agg(F.count("*").alias("n"))


@query("agg08_multi_key_counts", "SELECT node, count(*) AS n FROM (SELECT module_id AS node FROM issues UNION ALL SELECT entity_id FROM issues UNION ALL SELECT parent_id FROM issues) WHERE node IS NOT NULL GROUP BY node")
def multi_key(b: Bound) -> DataFrame:
    return b("issues").select(F.explode(F.array("module_id", "entity_id", "parent_id")).alias("node")).filter("node is not null").groupBy("node").agg(F.count("*").alias("n"))


@query("agg09_group_collect", "SELECT coalesce(parent_id, entity_id) AS node, string_agg(id::VARCHAR, ',' ORDER BY id) AS issues FROM issues GROUP BY 1")
def collect(b: Bound) -> DataFrame:
    ids = F.transform(F.sort_array(F.collect_list("id")), lambda i: i.cast("string"))
    return b("issues").groupBy(F.coalesce("parent_id", "entity_id").alias("node")).agg(F.array_join(ids, ",").alias("issues"))


@query("agg10_insights_per_node", "SELECT entity_id AS node, count(DISTINCT rule_code) FILTER (severity = 'error') AS errors, count(DISTINCT rule_code) FILTER (severity = 'warn') AS warnings FROM issues GROUP BY 1")
def per_node(b: Bound) -> DataFrame:
    once = b("issues").select(F.col("entity_id").alias("node"), "rule_code", "severity").distinct()
    return once.groupBy("node").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))


@query("agg11_sum_merge", "SELECT node, sum(n)::BIGINT AS n FROM (SELECT entity_id AS node, count(*) AS n FROM issues GROUP BY 1 UNION ALL SELECT parent_id, count(*) FROM issues WHERE parent_id IS NOT NULL GROUP BY 1) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def merge(b: Bound) -> DataFrame:
    both = b("issues").select(F.explode(F.array("entity_id", "parent_id")).alias("node")).filter("node is not null")
    return metrics.top_by(both.groupBy("node").agg(F.count("*").alias("n")), "n", 20, "node")


@query("agg12_global_statistics", "SELECT avg(line_count) AS mean, max(line_count) AS largest, count(*) AS n, count(*) FILTER (line_count > 150) AS above FROM modules")
def statistics(b: Bound) -> DataFrame:
    return b("modules").agg(F.avg("line_count").alias("mean"), F.max("line_count").alias("largest"), F.count("*").alias("n"), F.count_if(F.col("line_count") > 150).alias("above"))


@query("agg13_pivot_metrics", "SELECT entity_id, sum(metric_value) FILTER (metric_key = '1-URGENT') AS urgent, max(metric_value) FILTER (metric_key = '5-LOW') AS low FROM facts GROUP BY 1")
def pivot(b: Bound) -> DataFrame:
    pivoted = b("facts").groupBy("entity_id").pivot("metric_key", ["1-URGENT", "5-LOW"]).agg(F.sum("metric_value").alias("sum"), F.max("metric_value").alias("max"))
    return pivoted.select("entity_id", F.col("1-URGENT_sum").alias("urgent"), F.col("5-LOW_max").alias("low"))


@query("agg14_dead_code_rollup", "WITH d AS (SELECT module_id FROM issues WHERE rule_code = 'r1' GROUP BY 1), u AS (SELECT module_id, count(*) AS n FROM exports GROUP BY 1) SELECT coalesce(d.module_id, u.module_id) AS module_id, d.module_id IS NOT NULL AS dead, coalesce(n, 0) AS unused FROM d FULL JOIN u USING (module_id)")
def dead_code(b: Bound) -> DataFrame:
    dead = b("issues").filter("rule_code = 'r1'").select("module_id").distinct().withColumn("dead", F.lit(True))
    unused = b("exports").groupBy("module_id").agg(F.count("*").alias("unused"))
    return dead.join(unused, "module_id", "full_outer").select("module_id", F.coalesce("dead", F.lit(False)).alias("dead"), F.coalesce("unused", F.lit(0)).alias("unused"))


@query("agg15_summary_kpis", "SELECT (SELECT count(*) FROM facts) AS metrics, (SELECT count(*) FROM issues) AS findings, (SELECT count(*) FROM edges WHERE EXISTS (SELECT 1 FROM edges z WHERE z.src = edges.dst AND z.dst = edges.src)) AS cycles")
def kpis(b: Bound) -> DataFrame:
    back = b("edges").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(b("facts"), "metrics").crossJoin(one(b("issues"), "findings")).crossJoin(one(b("edges").join(back, ["src", "dst"], "left_semi"), "cycles"))


@query("agg16_trend_kpis", "SELECT count(*) FILTER (snapshot = 1998) AS now, count(*) FILTER (snapshot = 1997) AS before, count(*) FILTER (snapshot = 1998) - count(*) FILTER (snapshot = 1997) AS delta FROM facts")
def trend(b: Bound) -> DataFrame:
    return b("facts").agg(F.count_if(F.col("snapshot") == 1998).alias("now"), F.count_if(F.col("snapshot") == 1997).alias("before")).withColumn("delta", F.col("now") - F.col("before"))


@query("agg17_overlay_values", "SELECT entity_id AS id, max(metric_value) AS most, sum(metric_value) AS total, arg_min(metric_value, {'s': snapshot, 'k': metric_key}) AS first FROM facts GROUP BY 1")
def overlay(b: Bound) -> DataFrame:
    return b("facts").groupBy(F.col("entity_id").alias("id")).agg(F.max("metric_value").alias("most"), F.sum("metric_value").alias("total"), F.min_by("metric_value", F.struct("snapshot", "metric_key")).alias("first"))


@query("agg18_counts_by_type", "SELECT kind, count(*) AS n FROM (SELECT DISTINCT src, dst, kind FROM view_edges) GROUP BY kind ORDER BY n DESC, kind")
def by_type(b: Bound) -> DataFrame:
    bundles = b("view_edges").groupBy("src", "dst").agg(F.collect_list("kind").alias("kinds"))
    return bundles.select(F.explode(F.array_distinct("kinds")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


@query("agg19_degree_map", "SELECT n.id, (SELECT count(*) FROM view_edges e WHERE e.src = n.id) + (SELECT count(*) FROM view_edges e WHERE e.dst = n.id) AS degree FROM nodes n")
def degree(b: Bound) -> DataFrame:
    ends = b("view_edges").select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return b("nodes").select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


_PACKAGE = "CASE WHEN source LIKE '@%' THEN CASE WHEN split_part(source, '/', 2) <> '' THEN split_part(source, '/', 1) || '/' || split_part(source, '/', 2) END ELSE split_part(source, '/', 1) END"
_OUTSIDE = "source NOT LIKE '.%' AND source NOT LIKE '/%' AND source NOT LIKE '@/%' AND source NOT LIKE 'src/%'"


@query("agg20_external_symbols", f"""WITH x AS (SELECT DISTINCT module_id, {_PACKAGE} AS package, CASE WHEN specifiers_json = 'not json' THEN '(side-effect)' ELSE imported || ' as l' || (seq % 9) END AS symbol FROM imports WHERE {_OUTSIDE})
    SELECT module_id, package, string_agg(symbol, ', ' ORDER BY symbol) AS symbols FROM x WHERE package IS NOT NULL GROUP BY ALL""")
def external_symbols(b: Bound) -> DataFrame:
    named = F.transform(scalars.specifiers(F.col("specifiers_json")), scalars.specifier_name)
    symbol = F.explode(F.when(F.size(named) == 0, F.array(F.lit("(side-effect)"))).otherwise(named)).alias("symbol")
    found = b("imports").select("module_id", paths.external_package(F.col("source")).alias("package"), symbol).filter("package is not null")
    return found.groupBy("module_id", "package").agg(F.array_join(F.sort_array(F.collect_set("symbol")), ", ").alias("symbols"))


@query("agg21_package_rollup", f"SELECT {_PACKAGE} AS package, count(*) AS symbols FROM imports WHERE {_OUTSIDE} GROUP BY 1 HAVING package IS NOT NULL")
def package_rollup(b: Bound) -> DataFrame:
    return b("imports").select(paths.external_package(F.col("source")).alias("package")).filter("package is not null").groupBy("package").agg(F.count("*").alias("symbols"))


@query("agg22_folder_rollup", "SELECT directory AS folder, max(line_count) AS weight, floor(avg(seq % 7) + 0.5)::BIGINT AS layer, avg(seq % 13) AS sort_order FROM modules GROUP BY 1")
def folder_rollup(b: Bound) -> DataFrame:
    return b("modules").groupBy(F.col("directory").alias("folder")).agg(F.max("line_count").alias("weight"), scalars.round_half_up(F.avg(F.col("seq") % 7)).alias("layer"), F.avg(F.col("seq") % 13).alias("sort_order"))


@query("agg23_duplicated_lines", "SELECT module, sum(n)::BIGINT AS lines FROM (SELECT src AS module, n FROM view_edges UNION ALL SELECT dst, n FROM view_edges WHERE src <> dst) GROUP BY module")
def duplicated_lines(b: Bound) -> DataFrame:
    """Lines of a clone count for both its modules, once if they are one."""
    sides = F.explode(F.array_distinct(F.array("src", "dst"))).alias("module")
    return b("view_edges").select(sides, "n").groupBy("module").agg(F.sum("n").alias("lines"))


@query("agg24_unused_exports", "SELECT module_id, count(*) AS unused, bool_or(is_default) AS dead FROM exports GROUP BY 1")
def unused(b: Bound) -> DataFrame:
    return b("exports").groupBy("module_id").agg(F.count("*").alias("unused"), F.max("is_default").alias("dead"))


@query("agg25_resolution_statistics", """WITH n AS (SELECT name, count(DISTINCT id) AS n FROM symbols GROUP BY name), s AS (SELECT relation, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM calls c LEFT JOIN n ON n.name = c.name)
    SELECT relation, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'unresolved') AS unresolved FROM s GROUP BY 1""")
def resolution_statistics(b: Bound) -> DataFrame:
    from codeloom.operators.resolve import unique_name

    found = unique_name(b("calls").select("id", "name", "relation"), b("symbols"))
    return found.groupBy("relation").pivot("status", ["resolved", "ambiguous", "unresolved"]).count().na.fill(0)


@query("agg26_doc_coverage", "SELECT package_id, CASE WHEN count(*) FILTER (line_count > 100) = 0 THEN 0.0 ELSE count(*) FILTER (line_count > 100 AND is_barrel) * 1.0 / count(*) FILTER (line_count > 100) END::DOUBLE AS coverage FROM modules GROUP BY 1")
def coverage(b: Bound) -> DataFrame:
    exported, documented = F.count_if(F.col("line_count") > 100), F.count_if((F.col("line_count") > 100) & F.col("is_barrel"))
    return b("modules").groupBy("package_id").agg(scalars.ratio(documented, exported).alias("coverage"))


@query("agg27_subnode_counts", "SELECT parent_id AS id, count(*) AS total, count(*) FILTER (visibility = 'public') AS visible, count(*) FILTER (visibility <> 'public') AS hidden FROM members GROUP BY 1")
def subnodes(b: Bound) -> DataFrame:
    return b("members").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("total"), F.count_if(F.col("visibility") == "public").alias("visible"), F.count_if(F.col("visibility") != "public").alias("hidden"))


@query("agg28_cycle_participants", "SELECT DISTINCT unnest([src, dst]) AS id FROM edges")
def participants(b: Bound) -> DataFrame:
    """Members of all cycles, whose lists come as JSON."""
    stored = b("edges").select(F.to_json(F.array("src", "dst")).alias("participants_json"))
    return stored.select(F.explode(F.from_json("participants_json", "array<int>")).alias("id")).distinct()


@query("agg29_analyzer_status", """SELECT analyzer, bucket, status, timed FROM (VALUES ('size', 'metrics', 'ok', true), ('maintainability', 'metrics', 'ok', true), ('type-safety', 'metrics', 'ok', true), ('type-safety', 'entityStats', 'ok', true), ('documentation', 'metrics', 'ok', true),
    ('complexity', 'metrics', 'ok', true), ('duplication', 'metrics', 'ok', true), ('duplication', 'duplications', 'ok', true), ('legacy-rules', 'findings', 'ok', true), ('call-graph', 'callEdges', 'ok', true),
    ('coupling', 'metrics', 'ok', true), ('dep-cruiser', 'cycles', 'ok', true)) t(analyzer, bucket, status, timed)""")
def analyzer_status(b: Bound) -> DataFrame:
    """Each analyzer's buckets, computed and kept one by one: whether that went well and took time."""
    from codeloom.operators.pipeline import run_pipeline

    modules = b("documents").withColumn("relative_path", F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit(".ts")))
    return run_pipeline(b.spark, modules)[1].select("analyzer", "bucket", "status", (F.col("seconds") > 0).alias("timed"))
