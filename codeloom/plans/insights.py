"""The twenty structural-health queries and their report."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths, scalars
from codeloom.operators import blocks, graphs, resolve
from codeloom.plans.bindings import Bound
from codeloom.plans.registry import given_sql, query

#: Thresholds of the queries.
FAN, EXTERNAL, GOD, GOD_CRITICAL, PARAMETERS, PARAMETERS_CRITICAL = 10, 8, 15, 20, 4, 6
LINES, LINES_CRITICAL, CHAIN, CHAIN_CRITICAL, CHAIN_GUARD = 300, 500, 3, 5, 10
LEAKY_MEMBERS, LEAKY_RATIO, HUB, WIDE_INTERFACE, CLUSTER_NODES = 5, 0.8, 15, 7, 3

#: The import graph in SQL, for the twins: internal sources made normal, one parent step resolved.
IMPORT_GRAPH = r"""
    keyed AS (SELECT arg_max(id, seq) AS dst, regexp_replace(regexp_replace(relative_path, '\.(tsx?|jsx?|mjs|cjs)$', ''), '/index$', '') AS key FROM modules GROUP BY 2),
    wanted AS (
      SELECT DISTINCT module_id AS src, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
               CASE WHEN source LIKE '@/%' THEN 'src/' || substr(source, 3) WHEN source LIKE 'src/%' THEN source
                    ELSE regexp_extract(from_path, '^(.+)/[^/]*$', 1) || '/' || source END,
               '/\./', '/', 'g'), '[^/]+/\.\./', ''), '\.(tsx?|jsx?|mjs|cjs)$', ''), '/index$', '') AS key
      FROM imports WHERE source LIKE '.%' OR source LIKE '/%' OR source LIKE '@/%' OR source LIKE 'src/%'),
    graph AS (SELECT DISTINCT src, dst FROM wanted JOIN keyed USING (key) WHERE src <> dst)"""


def communities_sql(edges: str) -> str:
    """community (id, label) of the vertices with edges, for the twins.

    One vertex after the other, in the order of digests, in place, in a list of
    labels; then the least vertex that a way within one label leads to.
    """
    return f"""
    ways AS (SELECT src, dst FROM {edges} WHERE src <> dst UNION SELECT dst, src FROM {edges} WHERE src <> dst),
    turns AS (SELECT id, row_number() OVER (ORDER BY md5(id::VARCHAR), id) AS turn FROM (SELECT DISTINCT src AS id FROM ways)),
    near AS (SELECT a.turn, list(z.turn) AS near FROM ways JOIN turns a ON a.id = src JOIN turns z ON z.id = dst GROUP BY a.turn),
    whole AS (SELECT list(id ORDER BY turn) AS ids, list(near ORDER BY turn) AS near, count(*) AS n FROM turns JOIN near USING (turn)),
    visits AS (
      SELECT 0::BIGINT AS k, 0::BIGINT AS quiet, ids AS labels FROM whole WHERE n > 0
      UNION ALL
      SELECT k + 1, CASE WHEN best = labels[spot] THEN quiet + 1 ELSE 0 END, list_concat(list_concat(labels[1:spot - 1], [best]), labels[spot + 1:n])
      FROM (SELECT k, quiet, labels, n, k % n + 1 AS spot, (SELECT u.label FROM (SELECT unnest(list_transform(near[k % n + 1], lambda p: labels[p])) AS label) u GROUP BY u.label ORDER BY count(*) DESC, u.label LIMIT 1) AS best
            FROM visits, whole WHERE k < 10 * n AND quiet < n)),
    settled AS (SELECT unnest(ids) AS id, unnest(arg_max(labels, k)) AS label FROM visits, whole GROUP BY ids),
    hang AS (SELECT id, id AS other, label FROM settled UNION SELECT h.id, w.dst, h.label FROM hang h JOIN ways w ON w.src = h.other JOIN settled s ON s.id = w.dst AND s.label = h.label),
    community AS (SELECT id, min(other) AS label FROM hang GROUP BY id)"""


def _degrees(b: Bound) -> DataFrame:
    """id, fan_in and fan_out of every module."""
    return graphs.degrees(b("modules"), import_graph(b)) if b.degrees is None else b.degrees


def import_graph(b: Bound) -> DataFrame:
    if b.import_graph is not None:
        return b.import_graph
    return resolve.import_edges(b("imports"), b("modules"))


@query("ins01_circular_imports", f"""
    WITH RECURSIVE {IMPORT_GRAPH}, reach AS (SELECT src, dst FROM graph UNION SELECT r.src, e.dst FROM reach r JOIN graph e ON e.src = r.dst),
    mutual AS (SELECT a.src AS id, least(a.src, min(a.dst)) AS component FROM reach a JOIN reach z ON z.src = a.dst AND z.dst = a.src WHERE a.src <> a.dst GROUP BY a.src)
    SELECT component, count(*) AS value, 'critical' AS severity FROM mutual GROUP BY component""")
def circular_imports(b: Bound) -> DataFrame:
    """A strongly connected component of two modules or more is an insight of its own; its size is the value."""
    scc = graphs.strongly_connected(b("modules"), import_graph(b))
    return scc.groupBy("component").agg(F.count("*").alias("value"), F.lit("critical").alias("severity"))


@query("ins02_import_fan_in", f"WITH {IMPORT_GRAPH} SELECT dst AS id, count(*) AS value, 'warning' AS severity FROM graph GROUP BY dst HAVING count(*) >= 10")
def fan_in(b: Bound) -> DataFrame:
    return _degrees(b).select("id", F.col("fan_in").alias("value"), F.lit("warning").alias("severity")).filter(F.col("value") >= FAN)


@query("ins03_import_fan_out", f"WITH {IMPORT_GRAPH} SELECT src AS id, count(*) AS value, 'warning' AS severity FROM graph GROUP BY src HAVING count(*) >= 10")
def fan_out(b: Bound) -> DataFrame:
    return _degrees(b).select("id", F.col("fan_out").alias("value"), F.lit("warning").alias("severity")).filter(F.col("value") >= FAN)


_EXTERNAL = """CASE WHEN source LIKE '.%' OR source LIKE '/%' OR source LIKE '@/%' OR source LIKE 'src/%' OR source = '' THEN NULL
    WHEN source LIKE '@%' THEN CASE WHEN split_part(source, '/', 2) <> '' THEN split_part(source, '/', 1) || '/' || split_part(source, '/', 2) END
    ELSE split_part(source, '/', 1) END"""


@query("ins04_heavy_external_dependency", f"SELECT module_id AS id, count(DISTINCT {_EXTERNAL}) AS value, 'warning' AS severity FROM imports GROUP BY module_id HAVING value >= 8")
def heavy_external(b: Bound) -> DataFrame:
    found = b("imports").select("module_id", paths.external_package(F.col("source")).alias("package")).filter("package is not null").distinct()
    return found.groupBy(F.col("module_id").alias("id")).agg(F.count("*").alias("value"), F.lit("warning").alias("severity")).filter(F.col("value") >= EXTERNAL)


@query("ins05_god_class", """
    WITH n AS (SELECT c.id, c.name, (SELECT count(*) FROM members m WHERE m.parent_id = c.id AND m.kind = 'method') AS methods,
                      (SELECT count(*) FROM members m WHERE m.parent_id = c.id AND m.kind = 'property') AS properties FROM classes c)
    SELECT *, CASE WHEN methods + properties >= 20 THEN 'critical' ELSE 'warning' END AS severity FROM n WHERE methods + properties >= 15""")
def god_class(b: Bound) -> DataFrame:
    """Members are counted before the join, so each class meets one row."""
    counts = b("members").groupBy(F.col("parent_id").alias("id")).agg(F.count_if(F.col("kind") == "method").alias("methods"), F.count_if(F.col("kind") == "property").alias("properties"))
    n = F.col("methods") + F.col("properties")
    return counts.filter(n >= GOD).join(b("classes"), "id").select("id", "name", "methods", "properties", F.when(n >= GOD_CRITICAL, "critical").otherwise("warning").alias("severity"))


@query("ins06_long_parameter_lists", "SELECT m.id, count(*) AS value, CASE WHEN count(*) >= 6 THEN 'critical' ELSE 'warning' END AS severity FROM members m JOIN parameters p ON p.method_id = m.id GROUP BY m.id HAVING count(*) >= 4")
def long_parameter_lists(b: Bound) -> DataFrame:
    counts = b("parameters").groupBy(F.col("method_id").alias("id")).agg(F.count("*").alias("value")).filter(F.col("value") >= PARAMETERS)
    return counts.join(b("members"), "id").select("id", "value", F.when(F.col("value") >= PARAMETERS_CRITICAL, "critical").otherwise("warning").alias("severity"))


@query("ins07_module_size", "SELECT id, line_count AS value, CASE WHEN line_count > 500 THEN 'critical' ELSE 'warning' END AS severity FROM modules WHERE line_count > 300")
def module_size(b: Bound) -> DataFrame:
    large = b("modules").filter(F.col("line_count") > LINES)
    return large.select("id", F.col("line_count").alias("value"), F.when(F.col("line_count") > LINES_CRITICAL, "critical").otherwise("warning").alias("severity")).orderBy(F.desc("value"), "id")


@query("ins08_deep_inheritance", """
    WITH RECURSIVE chain AS (SELECT class_id, parent_id, 1 AS depth FROM extends
      UNION ALL SELECT c.class_id, e.parent_id, c.depth + 1 FROM chain c JOIN extends e ON e.class_id = c.parent_id WHERE c.depth < 10)
    SELECT class_id AS id, max(depth)::BIGINT AS value, CASE WHEN max(depth) >= 5 THEN 'critical' ELSE 'warning' END AS severity FROM chain GROUP BY class_id HAVING max(depth) >= 3""")
def deep_inheritance(b: Bound) -> DataFrame:
    """The chain is walked by a frontier that loses the classes whose chain has ended."""
    extends = graphs.settled(b("extends"))
    frontier, reached = extends, extends.select("class_id", F.lit(1).cast("long").alias("depth"))
    up = extends.select(F.col("class_id").alias("parent_id"), F.col("parent_id").alias("next"))
    for depth in range(2, CHAIN_GUARD + 1):
        frontier = graphs.settled(frontier.join(up, "parent_id").select("class_id", F.col("next").alias("parent_id")))
        if frontier.isEmpty():
            break
        reached = reached.union(frontier.select("class_id", F.lit(depth).cast("long").alias("depth")))
    deepest = reached.groupBy(F.col("class_id").alias("id")).agg(F.max("depth").alias("value")).filter(F.col("value") >= CHAIN)
    return deepest.withColumn("severity", F.when(F.col("value") >= CHAIN_CRITICAL, "critical").otherwise("warning"))


@query("ins09_leaky_encapsulation", """
    SELECT parent_id AS id, count(*) AS members, floor(100.0 * count(*) FILTER (visibility = 'public') / count(*) + 0.5)::BIGINT AS percent, 'warning' AS severity
    FROM members GROUP BY parent_id HAVING count(*) >= 5 AND count(*) FILTER (visibility = 'public') * 1.0 / count(*) > 0.8""")
def leaky_encapsulation(b: Bound) -> DataFrame:
    public = F.count_if(F.col("visibility") == "public")
    counts = b("members").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("members"), public.alias("public"))
    leaky = counts.filter((F.col("members") >= LEAKY_MEMBERS) & (F.col("public") / F.col("members") > LEAKY_RATIO))
    return leaky.select("id", "members", scalars.round_half_up(100.0 * F.col("public") / F.col("members")).alias("percent"), F.lit("warning").alias("severity"))


@query("ins10_barrel_file_depth", f"""WITH {IMPORT_GRAPH} SELECT src AS id, count(*) AS value, 'info' AS severity FROM graph
    WHERE src IN (SELECT id FROM modules WHERE is_barrel) AND dst IN (SELECT id FROM modules WHERE is_barrel) GROUP BY src""")
def barrel_depth(b: Bound) -> DataFrame:
    barrels = b("modules").filter("is_barrel").select("id")
    chains = import_graph(b).join(barrels.withColumnRenamed("id", "src"), "src", "left_semi").join(barrels.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return chains.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("value"), F.lit("info").alias("severity"))


@query("ins11_unexported_entities", """
    SELECT 'class' AS kind, seq AS id FROM modules m WHERE NOT EXISTS (SELECT 1 FROM exports e WHERE e.module_id = m.id AND e.name = 's' || (m.seq % 80))
    UNION ALL SELECT 'class', id FROM members WHERE kind = 'method' AND is_async AND NOT EXISTS (SELECT 1 FROM exports e WHERE e.name = members.name)""")
def unexported(b: Bound) -> DataFrame:
    """Classes, and functions that aren't exported, without an export of their name; the kind reported is always class."""
    classes = b("modules").select(F.col("seq").alias("id"), F.col("id").alias("module_id"), F.concat(F.lit("s"), F.col("seq") % 80).alias("name"))
    functions = b("members").filter("kind = 'method' and is_async").select("id", "name")
    found = classes.join(b("exports"), ["module_id", "name"], "left_anti").select("id").union(functions.join(b("exports"), "name", "left_anti").select("id"))
    return found.select(F.lit("class").alias("kind"), "id")


@query("ins12_type_only_dependencies", "SELECT module_id AS id, count(*) FILTER (is_type_only) AS type_only, count(*) AS total, 'info' AS severity FROM imports GROUP BY module_id HAVING count(*) FILTER (is_type_only) > 0")
def type_only(b: Bound) -> DataFrame:
    counts = b("imports").groupBy(F.col("module_id").alias("id")).agg(F.count_if("is_type_only").alias("type_only"), F.count("*").alias("total"))
    return counts.filter("type_only > 0").withColumn("severity", F.lit("info"))


@query("ins13_orphaned_modules", f"WITH {IMPORT_GRAPH} SELECT id, 'warning' AS severity FROM modules WHERE id NOT IN (SELECT src FROM graph) AND id NOT IN (SELECT dst FROM graph)")
def orphans(b: Bound) -> DataFrame:
    return _degrees(b).filter("fan_in = 0 and fan_out = 0").select("id", F.lit("warning").alias("severity"))


@query("ins14_hub_modules", f"""WITH {IMPORT_GRAPH}, ends AS (SELECT src AS id FROM graph UNION ALL SELECT dst FROM graph)
    SELECT id, count(*) AS value, 'info' AS severity FROM ends GROUP BY id HAVING count(*) >= 15""")
def hubs(b: Bound) -> DataFrame:
    return _degrees(b).select("id", (F.col("fan_in") + F.col("fan_out")).alias("value"), F.lit("info").alias("severity")).filter(F.col("value") >= HUB)


@query("ins15_bridge_modules", f"""
    WITH RECURSIVE {IMPORT_GRAPH}, b AS (SELECT src AS x, dst AS y FROM graph UNION SELECT dst, src FROM graph), start AS (SELECT x AS gone, min(y) AS y FROM b GROUP BY x),
    reach AS (SELECT gone, y FROM start UNION SELECT r.gone, b.y FROM reach r JOIN b ON b.x = r.y WHERE b.y <> r.gone)
    SELECT DISTINCT b.x AS id, 'warning' AS severity FROM b WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.gone = b.x AND r.y = b.y)""")
def bridges(b: Bound) -> DataFrame:
    return blocks.articulation_points(b("modules"), import_graph(b)).withColumn("severity", F.lit("warning"))


@query("ins16_cluster_detection", f"WITH RECURSIVE {IMPORT_GRAPH}, {communities_sql('graph')} SELECT label, count(*) AS value, 'info' AS severity FROM community WHERE (SELECT count(*) FROM modules) >= 3 GROUP BY label HAVING count(*) > 1")
def clusters(b: Bound) -> DataFrame:
    """Groups of two or more that label propagation makes, in graphs of three nodes or more; the rule is pinned, so reruns agree."""
    labels = graphs.label_propagation(b("modules"), import_graph(b))
    enough = b("modules").agg((F.count("*") >= CLUSTER_NODES).alias("enough"))
    return labels.join(F.broadcast(enough)).filter("enough").groupBy("label").agg(F.count("*").alias("value")).filter("value > 1").withColumn("severity", F.lit("info"))


@query("ins17_unused_exports", """
    SELECT id, module_id, name, 'warning' AS severity FROM exports WHERE name NOT IN (SELECT imported FROM imports WHERE specifiers_json <> 'not json')""")
def unused_exports(b: Bound) -> DataFrame:
    """Exports whose name no import anywhere brings in; names come from the imports' JSON."""
    used = b("imports").select(F.explode(scalars.specifiers(F.col("specifiers_json"))).alias("s")).select(F.col("s.imported").alias("name"))
    return b("exports").join(used, "name", "left_anti").select("id", "module_id", "name", F.lit("warning").alias("severity"))


@query("ins18_interface_segregation", """
    SELECT c.id, count(*) AS value, 'warning' AS severity FROM classes c JOIN members m ON m.parent_id = c.id
    WHERE (SELECT count(*) FROM symbol_references r WHERE r.target_id % 150 = c.id) > 0 GROUP BY c.id HAVING count(*) >= 7""")
def interface_segregation(b: Bound) -> DataFrame:
    """Interfaces with seven members or more that something implements."""
    wide = b("members").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("value")).filter(F.col("value") >= WIDE_INTERFACE)
    implemented = b("symbol_references").select((F.col("target_id") % 150).alias("id"))
    return wide.join(b("classes"), "id", "left_semi").join(implemented, "id", "left_semi").withColumn("severity", F.lit("warning"))


@query("ins19_missing_return_types", """
    SELECT id, 'method' AS kind, 'info' AS severity FROM members WHERE NOT has_explicit_return_type AND kind = 'method'
    UNION ALL SELECT id, 'function', 'info' FROM members WHERE NOT has_explicit_return_type AND kind = 'property'""")
def missing_return_types(b: Bound) -> DataFrame:
    missing = b("members").filter("not has_explicit_return_type")
    return missing.select("id", F.when(F.col("kind") == "method", "method").otherwise("function").alias("kind"), F.lit("info").alias("severity"))


@query("ins20_async_boundary_mismatches", """
    SELECT DISTINCT s.id AS source_id, t.id AS target_id, 'info' AS severity FROM symbol_references r JOIN members s ON s.id = r.source_id JOIN members t ON t.id = r.target_id
    WHERE s.kind = 'method' AND t.kind = 'method' AND NOT s.is_async AND t.is_async""")
def async_mismatches(b: Bound) -> DataFrame:
    methods = b("members").filter("kind = 'method'")
    plain = methods.filter("not is_async").select(F.col("id").alias("source_id"))
    asynchronous = methods.filter("is_async").select(F.col("id").alias("target_id"))
    return b("symbol_references").join(plain, "source_id").join(asynchronous, "target_id").select("source_id", "target_id", F.lit("info").alias("severity")).distinct()


#: Each insight's kind with the query that finds it and its name; of some, every row is an insight of so many entities.
REPORT = {
    "circular-imports": (circular_imports, "ins01_circular_imports", True),
    "import-fan-in": (fan_in, "ins02_import_fan_in", False),
    "import-fan-out": (fan_out, "ins03_import_fan_out", False),
    "heavy-external-dependency": (heavy_external, "ins04_heavy_external_dependency", False),
    "god-class": (god_class, "ins05_god_class", False),
    "long-parameter-lists": (long_parameter_lists, "ins06_long_parameter_lists", False),
    "module-size": (module_size, "ins07_module_size", False),
    "deep-inheritance": (deep_inheritance, "ins08_deep_inheritance", False),
    "leaky-encapsulation": (leaky_encapsulation, "ins09_leaky_encapsulation", False),
    "barrel-file-depth": (barrel_depth, "ins10_barrel_file_depth", False),
    "unexported-entities": (unexported, "ins11_unexported_entities", False),
    "type-only-dependencies": (type_only, "ins12_type_only_dependencies", False),
    "orphaned-modules": (orphans, "ins13_orphaned_modules", False),
    "hub-modules": (hubs, "ins14_hub_modules", False),
    "bridge-modules": (bridges, "ins15_bridge_modules", False),
    "cluster-detection": (clusters, "ins16_cluster_detection", True),
    "unused-exports": (unused_exports, "ins17_unused_exports", False),
    "interface-segregation-violations": (interface_segregation, "ins18_interface_segregation", False),
    "missing-return-types": (missing_return_types, "ins19_missing_return_types", False),
    "async-boundary-mismatches": (async_mismatches, "ins20_async_boundary_mismatches", False),
}
_NO_SEVERITY = ("unexported-entities",)  # always info


def insights(b: Bound, kinds: list[str] | None = None) -> DataFrame:
    """kind, severity and entities of every insight; one member that is critical makes its insight critical.

    The imports, their graph and its degrees are made once and kept in the
    checkpoint folder for all insights that need them. Insights that loop do so
    at the same time.
    """
    b.keep("imports", graphs.settled(b("imports")))
    b.import_graph = graphs.settled(import_graph(b))
    b.degrees = graphs.settled(graphs.degrees(b("modules"), b.import_graph))
    rank = F.max(F.array_position(F.array(*map(F.lit, ("info", "warning", "critical"))), F.col("severity")))
    name = F.element_at(F.array(*map(F.lit, ("info", "warning", "critical"))), rank.cast("int"))
    parts, wanted = [], list(kinds or REPORT)
    for kind, rows in zip(wanted, graphs.together(*(partial(REPORT[k][0], b) for k in wanted)), strict=True):
        each = REPORT[kind][2]
        rows = rows.withColumn("severity", F.lit("info")) if kind in _NO_SEVERITY else rows
        found = rows.select("severity", F.col("value").cast("long").alias("entities")) if each else rows.agg(name.alias("severity"), F.count("*").alias("entities")).filter("entities > 0")
        parts.append(found.select(F.lit(kind).alias("kind"), "severity", "entities"))
    return reduce(DataFrame.union, parts)


def summary(found: DataFrame) -> DataFrame:
    """Insights by severity, and the health score: 100 less 5 for each critical and 2 for each warning, 0 at least."""
    count = lambda s: F.count_if(F.col("severity") == s)
    return found.agg(count("critical").alias("critical"), count("warning").alias("warning"), count("info").alias("info")).withColumn("health", F.greatest(F.lit(0), 100 - 5 * F.col("critical") - 2 * F.col("warning")).cast("long"))


def report_sql() -> str:
    """The insights' own twins, put together."""
    parts = []
    for kind, (_, name, each) in REPORT.items():
        found = f"(SELECT *{", 'info' AS severity" if kind in _NO_SEVERITY else ''} FROM ({given_sql(name)}))"
        if each:
            parts.append(f"SELECT '{kind}' AS kind, severity, value::BIGINT AS entities FROM {found}")
        else:
            severity = "CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'warning') THEN 'warning' ELSE 'info' END"
            parts.append(f"SELECT '{kind}' AS kind, {severity} AS severity, count(*) AS entities FROM {found} HAVING count(*) > 0")
    return " UNION ALL ".join(parts)


@query("insr_report", report_sql())
def report(b: Bound) -> DataFrame:
    """All twenty insights."""
    return insights(b)


@query("insr_report_summary", f"""WITH i AS ({report_sql()})
    SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info,
           greatest(0, 100 - 5 * count(*) FILTER (severity = 'critical') - 2 * count(*) FILTER (severity = 'warning'))::BIGINT AS health FROM i""")
def report_summary(b: Bound) -> DataFrame:
    return summary(insights(b))
