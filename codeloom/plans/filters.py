"""Filters and predicates, and the scans they read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths, scalars
from codeloom.operators import graphs
from codeloom.plans.bindings import Bound
from codeloom.plans.registry import query


@query("src01_open_store", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def open_store(b: Bound) -> DataFrame:
    return b("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


@query("src02_parameterised_query", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000")
def parameterised(b: Bound) -> DataFrame:
    """SQL text with parameters; the first column is named id."""
    found = b.spark.sql("SELECT c_custkey, c_name AS name FROM {t} WHERE c_mktsegment = :segment AND c_acctbal > :least", args={"segment": "BUILDING", "least": 1000}, t=b("customer"))
    return found.withColumnRenamed(found.columns[0], "id")


@query("flt01_point_lookup", "SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderkey = 77")
def point(b: Bound) -> DataFrame:
    return b("orders").filter("o_orderkey = 77").limit(1).select(F.col("o_orderkey").alias("id"), "o_custkey")


def retrieve(df: DataFrame, **given: object) -> DataFrame:
    """Rows that equal every value given; None asks for nothing."""
    for name, value in given.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


@query("flt02_optional_conjunction", "SELECT id FROM modules WHERE package_id = 'en' AND is_barrel")
def optional(b: Bound) -> DataFrame:
    return retrieve(b("modules"), package_id="en", is_barrel=True, id=None).select("id")


@query("flt03_in_list", "SELECT id, module_id, name FROM exports WHERE module_id IN ('m1', 'm2', 'm3') ORDER BY name")
def in_list(b: Bound) -> DataFrame:
    return b("exports").filter(F.col("module_id").isin("m1", "m2", "m3")).select("id", "module_id", "name").orderBy("name", "id")


@query("flt04_two_column_or", "SELECT src, dst FROM edges WHERE src = 3 OR dst = 3")
def either(b: Bound) -> DataFrame:
    return b("edges").filter("src = 3 or dst = 3")


@query("flt05_package_pushdown", "SELECT id, line_count FROM modules WHERE package_id = 'de'")
def pushdown(b: Bound) -> DataFrame:
    return retrieve(b("modules"), package_id="de").select("id", "line_count")


@query("flt06_prefix_exclusion", "SELECT id, source FROM imports WHERE source NOT LIKE '.%' AND source NOT LIKE '/%' AND source NOT LIKE '@/%' AND source NOT LIKE 'src/%'")
def excluded(b: Bound) -> DataFrame:
    return b("imports").filter(~paths.is_internal(F.col("source"))).select("id", "source")


@query("flt07_internal_import", "SELECT id, (source LIKE '.%' OR source LIKE '/%' OR source LIKE '@/%' OR source LIKE 'src/%') AS internal FROM imports")
def internal(b: Bound) -> DataFrame:
    return b("imports").select("id", paths.is_internal(F.col("source")).alias("internal"))


@query("flt08_external_import", "SELECT id, CASE WHEN seq % 4 = 0 THEN seq % 8 = 0 WHEN seq % 6 = 1 THEN true ELSE NOT (source LIKE '.%' OR source LIKE '/%' OR source LIKE '@/%' OR source LIKE 'src/%') END AS external FROM imports")
def external(b: Bound) -> DataFrame:
    flag = F.when(F.col("seq") % 4 == 0, F.col("seq") % 8 == 0)
    package = F.when(F.col("seq") % 6 == 1, F.lit("p"))
    return b("imports").select("id", paths.is_external(F.col("source"), flag, package).alias("external"))


_TEST = " OR ".join(f"regexp_matches(replace(p, '\\', '/'), '(?i){x}')" for x in (r"(^|/)__tests__(/|$)", r"\.(test|spec)\.[cm]?[jt]sx?$", r"\.(e2e|integration)\.[cm]?[jt]sx?$", r"(^|/)(e2e|integration)(/|$)", r"(^|/)(test|tests|spec|specs)(/|$)"))
_PATH = r"""CASE seq % 12 WHEN 0 THEN concat('src/Tests/', name, '.ts') WHEN 1 THEN concat(directory, '/', name, '.SPEC.tsx') WHEN 2 THEN concat('lib/', name, '.e2e.mjs') WHEN 3 THEN 'src/integration'
    WHEN 4 THEN concat('a', chr(92), 'specs', chr(92), name, '.ts') WHEN 5 THEN concat('latest/', name, '.ts') WHEN 6 THEN concat('src/', name, '.integration.json') WHEN 7 THEN concat('__TESTS__/', name)
    WHEN 8 THEN concat('src/', name, '.test.ts.bak') WHEN 9 THEN NULL WHEN 10 THEN concat('e2e/', name, '.ts') ELSE relative_path END"""


@query("flt09_test_file", f"SELECT id, coalesce({_TEST}, false) AS test FROM (SELECT id, {_PATH} AS p FROM modules)")
def test_file(b: Bound) -> DataFrame:
    return b("modules").select("id", paths.is_test_file(F.expr(_PATH.replace("chr(92)", "char(92)"))).alias("test"))


@query("flt10_hide_test_files", "SELECT src, dst FROM edges WHERE src % 4 <> 0 AND dst % 4 <> 0")
def hide_tests(b: Bound) -> DataFrame:
    """Test nodes go, then the edges that hang on them."""
    left = b("nodes").filter(F.col("id") % 4 != 0).select("id")
    return b("edges").join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


@query("flt11_edge_visibility", "SELECT src, dst, kind, NOT (kind IN ('contains', 'uses') OR kind IN ('import')) AS hidden FROM view_edges")
def visibility(b: Bound) -> DataFrame:
    shown = F.col("kind").isNull() | F.col("kind").isin("contains", "uses") | F.col("kind").isin("import")
    return b("view_edges").select("src", "dst", "kind", (~shown).alias("hidden"))


_RAW_KIND = """CASE event_id % 7 WHEN 0 THEN 'devDependency' WHEN 1 THEN 'peerDependency' WHEN 2 THEN event_type WHEN 3 THEN NULL WHEN 4 THEN 'uses' WHEN 5 THEN 'export' ELSE 'Import' END"""


@query("flt12_edge_kind_coercion", f"SELECT event_id AS id, CASE WHEN event_id % 7 IN (0, 1, 4, 5) THEN {_RAW_KIND} ELSE 'dependency' END AS kind FROM events")
def coercion(b: Bound) -> DataFrame:
    return b("events").select(F.col("event_id").alias("id"), graphs.coerced_kind(F.expr(_RAW_KIND)).alias("kind"))


#: The kinds of nodes that an edge of a kind may come from, and lead to.
EDGE_RULES = {
    "import": (("module",), ("module", "externalPackage")),
    "extends": (("class", "interface", "module"), ("class", "interface", "module")),
    "implements": (("class", "module"), ("interface", "module")),
    "contains": (("module", "class", "interface"), ("class", "interface", "function", "property", "method", "enum", "type")),
    "dependency": (("package", "module"), ("package", "externalPackage")),
    "devDependency": (("package", "module"), ("package", "externalPackage")),
    "peerDependency": (("package", "module"), ("package", "externalPackage")),
    "export": (("module",), ("module",)),
    "uses": (("class", "interface", "function", "method"), ("property", "method")),
}
_NODE_KIND = "CASE {c} % 10 WHEN 0 THEN 'module' WHEN 1 THEN 'class' WHEN 2 THEN 'interface' WHEN 3 THEN 'package' WHEN 4 THEN 'externalPackage' WHEN 5 THEN 'function' WHEN 6 THEN 'method' WHEN 7 THEN 'property' WHEN 8 THEN 'enum' ELSE 'type' END"


@query("flt13_edge_rule_violations", f"""WITH e AS (SELECT src, dst, kind, {_NODE_KIND.format(c="src")} AS a, {_NODE_KIND.format(c="dst")} AS z FROM view_edges)
    SELECT src, dst, kind FROM e WHERE NOT CASE kind
        WHEN 'import' THEN a = 'module' AND z IN ('module', 'externalPackage')
        WHEN 'extends' THEN a IN ('class', 'interface', 'module') AND z IN ('class', 'interface', 'module')
        WHEN 'implements' THEN a IN ('class', 'module') AND z IN ('interface', 'module')
        WHEN 'contains' THEN a IN ('module', 'class', 'interface') AND z NOT IN ('module', 'package', 'externalPackage')
        WHEN 'uses' THEN a IN ('class', 'interface', 'function', 'method') AND z IN ('property', 'method') END""")
def violations(b: Bound) -> DataFrame:
    rules = b.spark.createDataFrame([(k, a, z) for k, (sources, targets) in EDGE_RULES.items() for a in sources for z in targets], "kind string, a string, z string")
    placed = b("view_edges").withColumn("a", F.expr(_NODE_KIND.format(c="src"))).withColumn("z", F.expr(_NODE_KIND.format(c="dst")))
    return placed.join(F.broadcast(rules), ["kind", "a", "z"], "left_anti").select("src", "dst", "kind")


@query("flt14_issues_of_node", "SELECT id FROM issues WHERE module_id = 'm7' OR entity_id = 'c3' OR parent_id = 'c3'")
def issues_of(b: Bound) -> DataFrame:
    return b("issues").filter("module_id = 'm7' or entity_id = 'c3' or parent_id = 'c3'").select("id")


@query("flt15_nodes_of_insight", "SELECT DISTINCT entity_id AS node FROM issues WHERE rule_code = 'r3' UNION SELECT module_id FROM issues WHERE rule_code = 'r3'")
def nodes_of(b: Bound) -> DataFrame:
    return b("issues").filter("rule_code = 'r3'").select(F.explode(F.array("entity_id", "module_id")).alias("node")).filter("node is not null").distinct()


@query("flt16_name_search", "SELECT e.src, e.dst FROM edges e WHERE EXISTS (SELECT 1 FROM nodes n WHERE lower(n.name) LIKE '%1%' AND n.id IN (e.src, e.dst))")
def search(b: Bound) -> DataFrame:
    """Edges at nodes whose label has the text, whatever the case."""
    hits = b("nodes").filter(F.contains(F.lower("name"), F.lower(F.lit("1")))).select("id")
    at = lambda c: b("edges").join(hits.withColumnRenamed("id", c), c, "left_semi").select("src", "dst")
    return at("src").union(at("dst")).distinct()


@query("flt17_complexity_class", "SELECT id, CASE WHEN seq % 30 >= 20 THEN 'error' WHEN seq % 30 >= 10 THEN 'warn' ELSE 'ok' END AS class FROM modules")
def complexity_class(b: Bound) -> DataFrame:
    c = F.col("seq") % 30
    return b("modules").select("id", F.when(c >= 20, "error").when(c >= 10, "warn").otherwise("ok").alias("class"))


@query("flt18_severity_colour", "SELECT id, CASE WHEN seq % 30 <= 10 THEN 'green' WHEN seq % 30 <= 20 THEN 'yellow' ELSE 'red' END AS colour FROM modules")
def colour(b: Bound) -> DataFrame:
    c = F.col("seq") % 30
    return b("modules").select("id", F.when(c <= 10, "green").when(c <= 20, "yellow").otherwise("red").alias("colour"))


@query("flt19_dependency_level", "WITH m AS (SELECT module_id, count(DISTINCT source) AS p, count(*) AS s FROM imports GROUP BY 1) SELECT module_id AS id, CASE WHEN p >= 20 OR s >= 120 THEN 'critical' WHEN p >= 12 OR s >= 60 THEN 'high' ELSE 'normal' END AS level FROM m")
def dependency_level(b: Bound) -> DataFrame:
    m = b("imports").groupBy(F.col("module_id").alias("id")).agg(F.count_distinct("source").alias("p"), F.count("*").alias("s"))
    return m.select("id", F.when((F.col("p") >= 20) | (F.col("s") >= 120), "critical").when((F.col("p") >= 12) | (F.col("s") >= 60), "high").otherwise("normal").alias("level"))


@query("flt20_severity_normalisation", "SELECT id, CASE severity WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'info' END AS severity FROM issues")
def normal_severity(b: Bound) -> DataFrame:
    return b("issues").select("id", scalars.severity(F.col("severity")).alias("severity"))


@query("flt21_null_dropping", """SELECT id, '{"module_id":"' || module_id || '"' || CASE WHEN parent_id IS NULL THEN '' ELSE ',"parent_id":"' || parent_id || '"' END || '}' AS ref FROM issues""")
def dropped_nulls(b: Bound) -> DataFrame:
    return b("issues").select("id", F.to_json(F.struct("module_id", "parent_id")).alias("ref"))


def enabled(name: str, disabled: list[str], allowed: list[str]) -> bool:
    """Whether an analyzer runs: being disabled wins, and an empty allowlist allows all."""
    return name not in disabled and (not allowed or name in allowed)


@query("flt22_enablement", "SELECT * FROM (VALUES ('coupling'), ('size')) t(name)")
def enablement(b: Bound) -> DataFrame:
    names = [n for n in ("coupling", "documentation", "knip", "size") if enabled(n, ["knip"], ["coupling", "knip", "size"])]
    return b.spark.createDataFrame([(n,) for n in names], "name string")
