"""Writes: inserts, patches, deletes, exports and their stored forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import entities, rules, tables
from codeloom.plans.bindings import Bound
from codeloom.plans.registry import query


def _halves(b: Bound) -> tuple[DataFrame, DataFrame]:
    rows = b("exports").withColumn("seq", F.substring("id", 2, 99).cast("long"))
    return rows.filter("seq % 3 = 0").select("module_id", "name").distinct(), rows.select("module_id", "name", "seq")


@query("snk01_batch_insert", "SELECT DISTINCT module_id, name FROM exports")
def batch_insert(b: Bound) -> DataFrame:
    """Rows whose key is there already are skipped, and of new rows with one key the first goes in."""
    table, rows = _halves(b)
    return tables.insert(table, rows, ["module_id", "name"], "seq")


@query("snk02_insert_returning", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 99, 'new'")
def insert_returning(b: Bound) -> DataFrame:
    new = b.spark.createDataFrame([(99, "new", 0)], "id int, name string, seq int")
    return tables.insert(b("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), new, ["id"], "seq")


@query("snk03_partial_update", "SELECT id, name, CASE WHEN seq % 4 = 0 THEN seq ELSE line_count END AS line_count FROM modules")
def partial_update(b: Bound) -> DataFrame:
    patches = b("modules").filter("seq % 4 = 0").select("id", F.col("seq").alias("line_count"), F.lit(1).alias("at"))
    return tables.patch(b("modules").select("id", "name", "line_count"), patches, "id", "at")


@query("snk04_column_patches", "SELECT id, CASE WHEN seq % 2 = 0 THEN name || '!' ELSE name END AS name, CASE WHEN seq % 3 = 0 THEN 7 ELSE line_count END AS line_count FROM modules")
def column_patches(b: Bound) -> DataFrame:
    """Two patches for a row: the later one's fields win where it has any."""
    first = b("modules").select("id", F.when(F.col("seq") % 2 == 0, "old").alias("name"), F.when(F.col("seq") % 3 == 0, F.lit(7).cast("long")).alias("line_count"), F.lit(1).alias("at"))
    then = b("modules").select("id", F.when(F.col("seq") % 2 == 0, F.concat("name", F.lit("!"))).alias("name"), F.lit(None).cast("long").alias("line_count"), F.lit(2).alias("at"))
    return tables.patch(b("modules").select("id", "name", "line_count"), first.union(then), "id", "at")


@query("snk05_delete_by_key", "SELECT id FROM modules WHERE package_id <> 'de'")
def delete_by_key(b: Bound) -> DataFrame:
    return tables.delete(b("modules"), b.spark.createDataFrame([("de",)], "package_id string"), "package_id").select("id")


@query("snk06_delete_by_subquery", "SELECT entity_id, snapshot, metric_key FROM facts WHERE snapshot NOT IN (SELECT snapshot FROM facts GROUP BY 1 HAVING snapshot % 2 = 0)")
def delete_by_subquery(b: Bound) -> DataFrame:
    return tables.delete(b("facts"), b("facts").filter("snapshot % 2 = 0").select("snapshot").distinct(), "snapshot").select("entity_id", "snapshot", "metric_key")


@query("snk07_cascade_delete", "SELECT 'modules' AS t, count(*) AS n FROM modules WHERE NOT is_barrel UNION ALL SELECT 'imports', count(*) FROM imports WHERE module_id NOT IN (SELECT id FROM modules WHERE is_barrel) UNION ALL SELECT 'exports', count(*) FROM exports WHERE module_id NOT IN (SELECT id FROM modules WHERE is_barrel)")
def cascade_delete(b: Bound) -> DataFrame:
    left = tables.cascade(b("modules"), b("modules").filter("is_barrel").select("id"), "id", {"imports": (b("imports"), "module_id"), "exports": (b("exports"), "module_id")})
    counts = [df.agg(F.count("*").alias("n")).select(F.lit("modules" if name == "root" else name).alias("t"), "n") for name, df in left.items()]
    return tables.union_all(counts)


@query("snk09_migrate_verify", "SELECT n_nationkey AS id, CAST(NULL AS INTEGER) AS complexity FROM nation")
def migrated(b: Bound) -> DataFrame:
    made = tables.migrate(b("nation").select(F.col("n_nationkey").alias("id")), {"complexity": "int"})
    if tables.verify({"nation": made}, {"nation": ["id", "complexity"]}):
        raise ValueError("the migration left something out")
    return made


@query("snk10_json_rows", """SELECT n_nationkey AS id, '{"key":' || n_nationkey || ',"names":{"n":"' || n_name || '"}}' AS json FROM nation""")
def json_rows(b: Bound) -> DataFrame:
    return b("nation").select(F.col("n_nationkey").alias("id"), F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.create_map(F.lit("n"), "n_name").alias("names"))).alias("json"))


@query("snk12_markdown_report", "WITH r AS (SELECT rule_code AS kind, severity, 'm' || id AS entity, row_number() OVER (PARTITION BY rule_code ORDER BY 'm' || id) AS place FROM issues) SELECT kind, '## ' || kind || ' (' || max(severity) || ')' || chr(10) || string_agg('- ' || entity, chr(10) ORDER BY place) FILTER (place <= 5) || CASE WHEN count(*) > 5 THEN chr(10) || '+' || (count(*) - 5) || ' more' ELSE '' END AS report FROM r GROUP BY kind")
def markdown(b: Bound) -> DataFrame:
    return tables.markdown(b("issues").select(F.col("rule_code").alias("kind"), "severity", F.concat(F.lit("m"), F.col("id").cast("string")).alias("entity")), most=5)


#: A file by its module's number, in SQL that both engines read; ~ stands for the end of a line.
_FILE = """replace(concat('interface Other {~  kind: 1 | 2;~}~', CASE WHEN seq % 2 = 0 THEN 'export ' ELSE '' END, 'interface K', seq, ' {~  size: number;~  my_kind', CASE WHEN seq % 3 = 0 THEN '?' ELSE '' END, ': "a" |  "b"',
    repeat(' | Map<X | Y>', CAST(seq % 4 AS INT)), ';~}~const z = 1;~'), '~', chr(10))"""


@query("snk13_refactor_preview", """SELECT id, seq % 4 > 0 AS success, CASE WHEN seq % 4 > 0 THEN replace(concat('interface Other {~  kind: 1 | 2;~}~', e, 'type K', seq, 'MyKind = "a" | "b"', repeat(' | Map<X | Y>', (seq % 4)::INT), ';~',
      e, 'interface K', seq, ' {~  size: number;~  my_kind', CASE WHEN seq % 3 = 0 THEN '?' ELSE '' END, ': K', seq, 'MyKind;~}~const z = 1;~'), '~', chr(10)) END AS preview
    FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN 'export ' ELSE '' END AS e FROM modules)""")
def preview(b: Bound) -> DataFrame:
    """Inline unions of three members or more, as the rule finds them, become named types above their interface; other files give an error."""
    modules = b("modules").select("id", F.expr(_FILE).alias("text"))
    findings = rules.run_rules({"properties": entities.properties(modules)}).select(F.col("module_id").alias("id"), "action", "context")
    return rules.rewrite(modules.join(findings, "id", "left")).select("id", "success", F.col("transformed").alias("preview"))


@query("snk14_insert_or_ignore", "SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT src, dst FROM acyclic)")
def insert_or_ignore(b: Bound) -> DataFrame:
    return tables.insert(b("edges"), b("acyclic").withColumn("seq", F.lit(0)), ["src", "dst"], "seq")


#: Modules that import by doc_id, before and after an edit of a part: other imports, other paths, modules that go and come.
_MODULES = """SELECT concat('m', doc_id) AS id, doc_id AS seq, concat('src/', {path}, doc_id, '.ts') AS relative_path,
    concat('import a from "./f', doc_id * 7 % (doc_id + 11), '";', chr(10), 'import b from "pkg";', chr(10), 'import c from "./g', {target}, '";') AS text FROM {{documents}} WHERE {kept}"""
_BEFORE = _MODULES.format(path="'f'", target="doc_id * 3 % (doc_id + 5)", kept="doc_id % 60 <> 9")
_AFTER = _MODULES.format(path="CASE WHEN doc_id % 90 = 5 THEN 'g' ELSE 'f' END", target="CASE WHEN doc_id % 50 = 1 THEN doc_id % 90 * 90 + 5 ELSE doc_id * 3 % (doc_id + 5) END", kept="doc_id % 70 <> 3")


@query("snk01_incremental_imports", rf"""WITH m AS ({_AFTER.replace("{documents}", "documents")}), k AS (SELECT id, substr(relative_path, 1, length(relative_path) - 3) AS key FROM m),
    w AS (SELECT id AS src, 'src/' || substr(unnest(regexp_extract_all(text, '\./[fg][0-9]+')), 3) AS key FROM m) SELECT DISTINCT src, k.id AS dst FROM w JOIN k USING (key) WHERE src <> k.id""")
def incremental_imports(b: Bound) -> DataFrame:
    """The import graph after an edit, from the graph before it and what the edit touches."""
    from codeloom.operators import incremental
    from codeloom.operators.graphs import checkpoint_folder
    from codeloom.sources.versions import VersionedTables

    store = VersionedTables(b.spark, f"{checkpoint_folder(b.spark)}/codeloom-imports-{uuid.uuid4().hex}")
    incremental.refresh(store, b.spark.sql(_BEFORE, documents=b("documents")))
    return incremental.refresh(store, b.spark.sql(_AFTER, documents=b("documents"))).edges
