"""Joins, resolution and hydration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import graphs, metrics, resolve
from codeloom.plans.bindings import Bound
from codeloom.plans.insights import IMPORT_GRAPH, import_graph
from codeloom.plans.registry import query


@query("jn01_inner_equi", "SELECT i.id, m.package_id FROM imports i JOIN modules m ON m.id = i.module_id WHERE i.source NOT LIKE '.%'")
def inner(b: Bound) -> DataFrame:
    return b("imports").filter(~F.col("source").startswith(".")).select("id", F.col("module_id")).join(b("modules").select(F.col("id").alias("module_id"), "package_id"), "module_id").select("id", "package_id")


@query("jn02_join_and_group", "SELECT m.parent_id AS id, count(*) AS parameters FROM members m JOIN parameters p ON p.method_id = m.id GROUP BY 1")
def grouped(b: Bound) -> DataFrame:
    """Parameters are counted by method first, so the join moves a row for each method."""
    counts = b("parameters").groupBy(F.col("method_id").alias("id")).agg(F.count("*").alias("n"))
    return counts.join(b("members"), "id").groupBy(F.col("parent_id").alias("id")).agg(F.sum("n").alias("parameters"))


@query("jn03_junction", "SELECT c.id AS class_id, p.p_brand AS interface FROM classes c JOIN members m ON m.parent_id = c.id JOIN part p ON p.p_partkey = m.id % 200 GROUP BY ALL")
def junction(b: Bound) -> DataFrame:
    bridge = b("members").select(F.col("parent_id").alias("class_id"), (F.col("id") % 200).alias("p_partkey"))
    named = bridge.join(b("part"), "p_partkey").select("class_id", F.col("p_brand").alias("interface")).distinct()
    return named.join(b("classes").select(F.col("id").alias("class_id")), "class_id", "left_semi")


@query("jn04_bridge_self_join", "SELECT r.id, s.name AS source, t.name AS target FROM symbol_references r JOIN members s ON s.id = r.source_id JOIN members t ON t.id = r.target_id")
def bridge(b: Bound) -> DataFrame:
    named = lambda key, name: b("members").select(F.col("id").alias(key), F.col("name").alias(name))
    return b("symbol_references").join(named("source_id", "source"), "source_id").join(named("target_id", "target"), "target_id").select("id", "source", "target")


@query("jn05_anti_join", "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')")
def anti(b: Bound) -> DataFrame:
    urgent = b("orders").filter("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return b("customer").join(urgent, "c_custkey", "left_anti").select(F.col("c_custkey").alias("id"))


@query("jn06_anti_by_name", "SELECT DISTINCT name FROM exports WHERE name NOT IN (SELECT imported FROM imports)")
def anti_name(b: Bound) -> DataFrame:
    return b("exports").select("name").join(b("imports").select(F.col("imported").alias("name")), "name", "left_anti").distinct()


@query("jn07_semi_both_ends", "SELECT src, dst FROM edges WHERE src IN (SELECT id FROM nodes WHERE folder < 3) AND dst IN (SELECT id FROM nodes WHERE folder < 3)")
def semi(b: Bound) -> DataFrame:
    kept = b("nodes").filter("folder < 3").select("id")
    return b("edges").join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


@query("jn08_scalar_subquery", "SELECT c.id, (SELECT count(*) FROM members m WHERE m.parent_id = c.id AND m.visibility = 'private') AS hidden FROM classes c")
def scalar(b: Bound) -> DataFrame:
    counts = b("members").filter("visibility = 'private'").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("hidden"))
    return b("classes").select("id").join(counts, "id", "left").select("id", F.coalesce("hidden", F.lit(0)).cast("long").alias("hidden"))


@query("jn09_lookup_default", "SELECT r.id, coalesce(m.name, 'member ' || r.target_id) AS name FROM symbol_references r LEFT JOIN members m ON m.id = r.target_id")
def lookup(b: Bound) -> DataFrame:
    named = b("members").select(F.col("id").alias("target_id"), "name")
    return b("symbol_references").join(named, "target_id", "left").select("id", F.coalesce("name", F.concat(F.lit("member "), F.col("target_id").cast("string"))).alias("name"))


@query("jn10_unique_name", """WITH n AS (SELECT name, count(DISTINCT id) AS n, min(id) AS one FROM symbols GROUP BY name)
    SELECT c.id, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN n = 1 THEN one END AS target_id FROM calls c LEFT JOIN n ON n.name = c.name""")
def unique_name(b: Bound) -> DataFrame:
    return resolve.unique_name(b("calls").select("id", "name"), b("symbols")).select("id", "status", "target_id")


@query("jn11_member_resolution", """WITH d AS (SELECT parent_id, name, min(id) AS direct FROM members GROUP BY ALL), a AS (SELECT name, min(id) AS alone FROM members GROUP BY name HAVING count(DISTINCT id) = 1)
    SELECT m.id, coalesce(direct, alone) AS target_id FROM members m LEFT JOIN d ON d.parent_id = CASE WHEN m.id % 2 = 0 THEN m.parent_id ELSE m.parent_id + 1 END AND d.name = m.name LEFT JOIN a ON a.name = m.name""")
def member(b: Bound) -> DataFrame:
    usages = b("members").select("id", F.col("parent_id").alias("owner_id"), F.when(F.col("id") % 2 == 1, F.col("parent_id") + 1).alias("qualifier_id"), "name")
    return resolve.member(usages, b("members"))


@query("jn12_import_resolution", f"WITH {IMPORT_GRAPH} SELECT src, dst FROM graph")
def resolution_a(b: Bound) -> DataFrame:
    return import_graph(b)


_ENDINGS = "['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.vue', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs', '/index.vue']"
_JOINED = r"regexp_replace(regexp_replace(regexp_extract(from_path, '^(.+)/[^/]*$', 1) || '/' || source, '/\./', '/', 'g'), '[^/]+/\.\./', '')"


@query("jn13_ranked_resolution", f"""WITH t AS (SELECT id, unnest(generate_series(1, 15)) AS rank, {_JOINED} AS p FROM imports WHERE source LIKE '.%'),
    h AS (SELECT t.id, t.rank, m.id AS dst FROM t JOIN modules m ON m.relative_path = p || {_ENDINGS}[rank]) SELECT id, arg_min(dst, rank) AS dst FROM h GROUP BY id""")
def resolution_b(b: Bound) -> DataFrame:
    return resolve.ranked_candidates(b("imports"), b("modules"))


@query("jn14_package_then_global", rf"""
    WITH o AS (SELECT id AS dst, package_id, unnest(list_distinct([relative_path, regexp_replace(relative_path, '\.(tsx?|jsx?|mjs|cjs|vue)$', ''), regexp_replace(regexp_replace(relative_path, '\.(tsx?|jsx?|mjs|cjs|vue)$', ''), '/index$', '')])) AS path FROM modules),
    w AS (SELECT id, package_id, regexp_replace(regexp_replace(CASE WHEN source LIKE '@/%' THEN 'src/' || source[3:] WHEN source LIKE 'src/%' THEN source ELSE {_JOINED} END, '\.(tsx?|jsx?|mjs|cjs)$', ''), '/index$', '') AS p
          FROM imports WHERE source LIKE '.%' OR source LIKE '/%' OR source LIKE '@/%' OR source LIKE 'src/%'),
    t AS (SELECT id, package_id, r - 1 AS rank, p || {_ENDINGS}[r] AS path FROM (SELECT *, unnest(generate_series(1, 15)) AS r FROM w)),
    l AS (SELECT package_id, path, min(dst) AS dst FROM o GROUP BY ALL), g AS (SELECT path, min(dst) AS dst FROM o GROUP BY path HAVING count(DISTINCT dst) = 1),
    h AS (SELECT t.id, 2 * rank AS rank, dst FROM t JOIN l USING (package_id, path) UNION ALL SELECT t.id, 2 * rank + 1, dst FROM t JOIN g USING (path))
    SELECT id, arg_min(dst, rank) AS dst FROM h GROUP BY id""")
def resolution_c(b: Bound) -> DataFrame:
    return resolve.package_then_global(b("imports"), b("modules"))


@query("jn15_suffix_join", """WITH r AS (SELECT DISTINCT name || CASE WHEN seq % 3 = 0 THEN '.tsx' ELSE '.ts' END AS path FROM modules),
    h AS (SELECT path, m.id, length(path) AS n FROM r JOIN modules m ON m.relative_path = path OR ends_with(m.relative_path, '/' || path)) SELECT path, arg_min(id, {'n': -n, 'id': id}) AS module_id FROM h GROUP BY path""")
def suffix(b: Bound) -> DataFrame:
    reported = b("modules").select(F.concat("name", F.when(F.col("seq") % 3 == 0, ".tsx").otherwise(".ts")).alias("path")).distinct()
    return resolve.by_suffix(reported, b("modules"))


@query("jn16_tiered_join", """WITH r AS (SELECT DISTINCT CASE seq % 3 WHEN 0 THEN './' || relative_path WHEN 1 THEN substr(relative_path, 5) ELSE 'other/' || name || '.ts' END AS path FROM modules),
    o AS (SELECT id, relative_path AS key FROM modules), k AS (SELECT path, regexp_replace(path, '^(\\./|/)+', '') AS bare FROM r),
    a AS (SELECT split_part(key, '/', -1) AS f, min(id) AS id FROM o GROUP BY 1 HAVING count(*) = 1),
    h AS (SELECT path, 0 AS rank, id FROM k JOIN o ON key = path UNION ALL SELECT path, 1, id FROM k JOIN o ON key = bare UNION ALL SELECT path, 2, id FROM k JOIN o ON key = 'src/' || bare UNION ALL SELECT path, 9, id FROM k JOIN a ON f = split_part(path, '/', -1))
    SELECT path, arg_min(id, {'r': rank, 'i': id}) AS module_id FROM h GROUP BY path""".replace("\\\\", "\\"))
def tiered(b: Bound) -> DataFrame:
    path = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("./"), "relative_path")).when(F.col("seq") % 3 == 1, F.substring("relative_path", 5, 999)).otherwise(F.concat(F.lit("other/"), "name", F.lit(".ts")))
    return resolve.tiered(b("modules").select(path.alias("path")).distinct(), b("modules"))


@query("jn17_snapshot_diff", """WITH a AS (SELECT * FROM facts WHERE snapshot = 1998), z AS (SELECT * FROM facts WHERE snapshot = 1997)
    SELECT entity_id, metric_key, coalesce(a.metric_value, 0) AS current_value, coalesce(z.metric_value, 0) AS baseline_value, coalesce(a.metric_value, 0) - coalesce(z.metric_value, 0) AS delta
    FROM a FULL JOIN z USING (entity_id, metric_key) WHERE coalesce(a.metric_value, 0) <> coalesce(z.metric_value, 0)""")
def diff(b: Bound) -> DataFrame:
    facts = b("facts")
    return metrics.diff(facts.filter("snapshot = 1998"), facts.filter("snapshot = 1997"))


@query("jn18_call_resolution", """WITH f AS (SELECT name, count(DISTINCT id) AS n, min(id) AS one FROM symbols WHERE kind = 'property' GROUP BY name), m AS (SELECT name, count(DISTINCT id) AS n, min(id) AS one FROM symbols WHERE kind = 'method' GROUP BY name),
    x AS (SELECT c.id, CASE WHEN (c.qualified AND m.n IS NOT NULL) OR f.n IS NULL THEN m.n ELSE f.n END AS n, CASE WHEN (c.qualified AND m.n IS NOT NULL) OR f.n IS NULL THEN m.one ELSE f.one END AS one FROM calls c LEFT JOIN f ON f.name = c.name LEFT JOIN m ON m.name = c.name)
    SELECT id, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN n = 1 THEN one END AS target_id FROM x""")
def calls(b: Bound) -> DataFrame:
    return resolve.call_targets(b("calls").select("id", "name", "qualified"), b("symbols").filter("kind = 'property'"), b("symbols").filter("kind = 'method'"))


@query("jn19_reclassification", "WITH s AS (SELECT 'pkg' || i AS package, CASE WHEN i % 2 = 0 THEN 'devDependency' ELSE 'dependency' END AS scope FROM range(10) t(i)) SELECT i.id, coalesce(scope, 'import') AS kind FROM imports i LEFT JOIN s ON s.package = split_part(i.source, '/', 1)")
def reclassify(b: Bound) -> DataFrame:
    scopes = b.spark.range(10).select(F.concat(F.lit("pkg"), F.col("id").cast("string")).alias("package"), F.when(F.col("id") % 2 == 0, "devDependency").otherwise("dependency").alias("scope"))
    return b("imports").withColumn("package", F.split_part("source", F.lit("/"), F.lit(1))).join(scopes, "package", "left").select("id", F.coalesce("scope", F.lit("import")).alias("kind"))


def hydrate(classes: DataFrame, members: DataFrame, parameters: DataFrame) -> DataFrame:
    """Classes with their members, and members with their parameters, nested and in order, built from the bottom up."""
    inner = parameters.groupBy(F.col("method_id").alias("id")).agg(F.sort_array(F.collect_list("place")).alias("parameters"))
    own = members.join(inner, "id", "left").groupBy(F.col("parent_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("id", "kind", "name", "parameters"))).alias("members"))
    return classes.join(own, "id", "left")


@query("jn20_hydration", "SELECT m.parent_id AS id, m.id AS member_id, m.name, count(p.place) AS parameters, coalesce(sum(p.place), 0)::BIGINT AS places FROM members m LEFT JOIN parameters p ON p.method_id = m.id GROUP BY ALL")
def hydrated(b: Bound) -> DataFrame:
    nested = hydrate(b("classes"), b("members"), b("parameters")).select("id", F.explode("members").alias("m"))
    places = F.coalesce(F.col("m.parameters"), F.array().cast("array<int>"))
    return nested.select("id", F.col("m.id").alias("member_id"), F.col("m.name").alias("name"), F.size(places).cast("long").alias("parameters"), F.aggregate(places, F.lit(0).cast("long"), lambda n, p: n + p).alias("places"))


@query("gr08_lift_symbol_edges", "SELECT DISTINCT s.parent_id AS src, t.parent_id AS dst, r.access_kind AS kind FROM symbol_references r JOIN members s ON s.id = r.source_id JOIN members t ON t.id = r.target_id WHERE s.parent_id <> t.parent_id")
def lift_symbols(b: Bound) -> DataFrame:
    """Edges between symbols as edges between what holds them."""
    holder = lambda key, name: b("members").select(F.col("id").alias(key), F.col("parent_id").alias(name))
    return b("symbol_references").join(holder("source_id", "src"), "source_id").join(holder("target_id", "dst"), "target_id").filter("src <> dst").select("src", "dst", F.col("access_kind").alias("kind")).distinct()


@query("gr12_ancestors", """WITH RECURSIVE a AS (SELECT class_id AS id, parent_id AS ancestor, 1 AS distance FROM extends UNION ALL SELECT a.id, e.parent_id, a.distance + 1 FROM a JOIN extends e ON e.class_id = a.ancestor)
    SELECT id, ancestor, distance FROM a""")
def ancestors(b: Bound) -> DataFrame:
    return graphs.ancestors(b("extends").select(F.col("class_id").alias("id"), F.col("parent_id").alias("parent")))
