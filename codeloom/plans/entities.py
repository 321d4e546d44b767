"""Entity extraction over source text that each document's number shapes: what there is, how it is written and how often."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import entities, graphs, resolve
from codeloom.plans.bindings import Bound
from codeloom.plans.registry import query

#: Source text by doc_id, in SQL that Spark and DuckDB read alike; ~ stands for the end of a line.
SOURCE = """replace(concat(
    'export ', CASE WHEN doc_id % 4 = 0 THEN 'abstract ' ELSE '' END, 'class K', doc_id, CASE WHEN doc_id % 3 = 0 THEN '<T>' ELSE '' END,
    CASE WHEN doc_id % 2 = 0 THEN concat(' extends Base', doc_id % 5) ELSE '' END, CASE doc_id % 3 WHEN 0 THEN ' implements I1, I2<T>' WHEN 1 THEN ' implements I3' ELSE '' END, ' {~',
    CASE WHEN doc_id % 5 <> 0 THEN '  private count: number = 0;~' ELSE '' END, '  readonly name', doc_id % 7, ': string;~',
    CASE WHEN doc_id % 3 <> 1 THEN '  async load(a: string, b?: number): Promise<void> {~    if (a) { go(); }~  }~' ELSE '' END,
    repeat(concat('  run', doc_id % 6, '(...rest: any[]) { return 1; }~'), CASE WHEN doc_id % 6 = 5 THEN 0 ELSE 1 END), '}~',
    CASE WHEN doc_id % 4 <> 1 THEN concat('interface J', doc_id, CASE WHEN doc_id % 2 = 1 THEN ' extends P, Q' ELSE '' END, ' {~  size: number;~', CASE WHEN doc_id % 6 = 0 THEN '  grow(by: number): void;~' ELSE '' END, '}~') ELSE '' END,
    CASE WHEN doc_id % 5 < 3 THEN concat('export ', CASE WHEN doc_id % 2 = 0 THEN 'async ' ELSE '' END, 'function fn', doc_id, '(x: number, { y }: O', repeat(', z?: T', CAST(doc_id % 3 % 2 AS INT)), ') { return x }~') ELSE 'function hidden(x) { return x }~' END,
    CASE WHEN doc_id % 3 = 0 THEN concat('export type T', doc_id, '<A, B> = { a: A }~  | ', CASE WHEN doc_id % 2 = 0 THEN 'string' ELSE 'null' END, ';~') ELSE 'type Own = 1;~' END,
    CASE WHEN doc_id % 4 = 2 THEN concat('export enum E', doc_id, ' { A = ', doc_id, ', B }~') ELSE '' END), '~', chr(10))"""


def _modules(b: Bound) -> DataFrame:
    return b("documents").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("id"), "doc_id", F.expr(SOURCE).alias("text"))


@query("ext04_classes", """SELECT 'm' || doc_id AS module_id, 'K' || doc_id AS name, CASE WHEN doc_id % 2 = 0 THEN 'Base' || (doc_id % 5) END AS extends,
    CASE doc_id % 3 WHEN 0 THEN 'I1,I2' WHEN 1 THEN 'I3' ELSE '' END AS implements FROM documents""")
def classes(b: Bound) -> DataFrame:
    return entities.classes(_modules(b)).withColumn("implements", F.array_join("implements", ","))


@query("ext05_interfaces", "SELECT 'm' || doc_id AS module_id, 'J' || doc_id AS name, CASE WHEN doc_id % 2 = 1 THEN 'P,Q' ELSE '' END AS extends FROM documents WHERE doc_id % 4 <> 1")
def interfaces(b: Bound) -> DataFrame:
    return entities.interfaces(_modules(b)).withColumn("extends", F.array_join("extends", ","))


@query("ext06_methods", """SELECT 'm' || doc_id AS module_id, 'K' || doc_id AS parent, 'load' AS name, true AS is_async, 'Promise<void>' AS return_type FROM documents WHERE doc_id % 3 <> 1
    UNION ALL SELECT 'm' || doc_id, 'K' || doc_id, 'run' || (doc_id % 6), false, NULL FROM documents WHERE doc_id % 6 <> 5
    UNION ALL SELECT 'm' || doc_id, 'J' || doc_id, 'grow', false, 'void' FROM documents WHERE doc_id % 4 <> 1 AND doc_id % 6 = 0""")
def methods(b: Bound) -> DataFrame:
    return entities.methods(_modules(b)).select("module_id", "parent", "name", "is_async", "return_type")


@query("ext07_properties", """SELECT 'm' || doc_id AS module_id, 'K' || doc_id AS parent, 'count' AS name, 'private' AS visibility, 'number' AS type FROM documents WHERE doc_id % 5 <> 0
    UNION ALL SELECT 'm' || doc_id, 'K' || doc_id, 'name' || (doc_id % 7), 'public', 'string' FROM documents UNION ALL SELECT 'm' || doc_id, 'J' || doc_id, 'size', 'public', 'number' FROM documents WHERE doc_id % 4 <> 1""")
def properties(b: Bound) -> DataFrame:
    return entities.properties(_modules(b)).select("module_id", "parent", "name", "visibility", "type")


@query("ext08_parameters", """SELECT 'm' || doc_id AS module_id, 'load' AS method, unnest([0, 1]) AS place, unnest(['a', 'b']) AS name, unnest([false, true]) AS is_optional, false AS is_rest FROM documents WHERE doc_id % 3 <> 1
    UNION ALL SELECT 'm' || doc_id, 'run' || (doc_id % 6), 0, 'rest', false, true FROM documents WHERE doc_id % 6 <> 5 UNION ALL SELECT 'm' || doc_id, 'grow', 0, 'by', false, false FROM documents WHERE doc_id % 4 <> 1 AND doc_id % 6 = 0""")
def parameters(b: Bound) -> DataFrame:
    each = entities.methods(_modules(b)).select("module_id", F.col("name").alias("method"), F.posexplode("params").alias("place", "p"))
    return each.select("module_id", "method", "place", "p.name", "p.is_optional", "p.is_rest")


@query("ext09_functions", "SELECT 'm' || doc_id AS module_id, 'fn' || doc_id AS name, doc_id % 2 = 0 AS is_async, (1 + doc_id % 3 % 2)::INT AS parameters FROM documents WHERE doc_id % 5 < 3")
def functions(b: Bound) -> DataFrame:
    return entities.functions(_modules(b)).select("module_id", "name", "is_async", F.size("params").alias("parameters"))


@query("ext10_type_aliases", """SELECT 'm' || doc_id AS module_id, 'T' || doc_id AS name, '{ a: A } | ' || CASE WHEN doc_id % 2 = 0 THEN 'string' ELSE 'null' END AS body, '["A","B"]' AS type_parameters_json FROM documents WHERE doc_id % 3 = 0""")
def type_aliases(b: Bound) -> DataFrame:
    return entities.type_aliases(_modules(b))


@query("ext11_enums", """SELECT 'm' || doc_id AS module_id, 'E' || doc_id AS name, '[{"name":"A","value":"' || doc_id || '"},{"name":"B"}]' AS members_json FROM documents WHERE doc_id % 4 = 2""")
def enums(b: Bound) -> DataFrame:
    return entities.enums(_modules(b))


@query("src10_module_parse", "SELECT 'm' || doc_id AS id, doc_id % 5 <> 0 AS parsed, (doc_id % 5 <> 0)::INT AS classes, (doc_id % 5 <> 0 AND doc_id % 4 <> 1)::INT AS interfaces FROM documents")
def module_parse(b: Bound) -> DataFrame:
    """A module row for every file, also for one that can't be read or in which nothing is found."""
    given = _modules(b).withColumn("text", F.when(F.col("doc_id") % 5 != 0, F.col("text")))
    count = lambda kind: F.count_if(F.col("kind") == kind).cast("int")
    found = entities.scanned(given, "class", "interface").groupBy(F.col("module_id").alias("id")).agg(count("class").alias("classes"), count("interface").alias("interfaces"))
    both = given.join(found, "id", "left")
    return both.select("id", F.col("text").isNotNull().alias("parsed"), F.coalesce("classes", F.lit(0)).alias("classes"), F.coalesce("interfaces", F.lit(0)).alias("interfaces"))


#: Calls by doc_id, with what is imported from a package, key words, declarations and a constructor, in SQL that both engines read.
CALLS = """replace(concat('import { ext', doc_id % 3, ' } from "pkg"; ext0(1);~function own(a) { return 1 }~', CASE WHEN doc_id % 2 = 0 THEN concat('fn', doc_id, '(1); fn', doc_id + 1, '(2); fn', doc_id + 1, '(3);~') ELSE '' END,
    'this.k.load(7); a.run', doc_id % 6, '();~if (x) { new Map(y) }~'), '~', chr(10))"""


@query("an09_call_edges", """WITH c AS (SELECT doc_id, 'ext0' AS name, false AS q FROM documents UNION ALL SELECT doc_id, unnest(['fn' || doc_id, 'fn' || (doc_id + 1)]), false FROM documents WHERE doc_id % 2 = 0
      UNION ALL SELECT doc_id, unnest(['load', 'run' || (doc_id % 6)]), true FROM documents),
    f AS (SELECT 'fn' || doc_id AS name, count(*) AS n FROM documents WHERE doc_id % 5 < 3 GROUP BY 1),
    m AS (SELECT name, count(*) AS n FROM (SELECT 'load' AS name FROM documents WHERE doc_id % 3 <> 1 UNION ALL SELECT 'run' || (doc_id % 6) FROM documents WHERE doc_id % 6 <> 5) GROUP BY 1),
    x AS (SELECT doc_id, c.name, CASE WHEN q THEN coalesce(m.n, f.n) ELSE coalesce(f.n, m.n) END AS n FROM c LEFT JOIN f ON f.name = c.name LEFT JOIN m ON m.name = c.name)
    SELECT 'm' || doc_id AS module_id, name, CASE WHEN name = 'ext0' AND doc_id % 3 = 0 THEN 'external' WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM x""")
def call_edges(b: Bound) -> DataFrame:
    """Calls of each module with what they mean among all modules' functions and methods; what a package gives is external."""
    declared = graphs.settled(entities.scanned(_modules(b), "class", "interface", "method", "function"))
    functions = entities.functions(declared).select(F.concat_ws(":", "module_id", "name").alias("id"), "name")
    methods = entities.methods(declared).filter("parent_type = 'class'").select(F.concat_ws(":", "module_id", "parent", "name").alias("id"), "name")
    calling = b("documents").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("id"), F.expr(CALLS).alias("text"))
    return resolve.call_graph(calling, functions, methods).select("module_id", "name", "status")


#: Functions that call by doc_id: methods, nested and nameless functions, objects' methods, strings that look like code.
CALLERS = """replace(concat('import { ext', doc_id % 3, ' } from "pkg";~class K', doc_id, ' { async run', doc_id % 6, '(a: T) { await this.k.load(7); ext0(a); } }~',
    'export ', CASE WHEN doc_id % 2 = 0 THEN 'async ' ELSE '' END, 'function fn', doc_id, '(x) {~  const s = "} nothing(1) {"; // gone(2)~  one', doc_id % 2, '(x); one', doc_id % 2, '(x);~',
    '  list.map((y) => lost(y));~  const load = (z) => { two(`a ${three(z)} }`); };~  return { m() { four(); } };~}~fn', doc_id, '(0);~'), '~', chr(10))"""


@query("an09_callers", """WITH e AS (
      SELECT doc_id, 'K' || doc_id || '.run' || (doc_id % 6) AS source, 'method' AS source_type, unnest(['load', 'ext0']) AS name, unnest(['this.k', NULL]) AS qualifier, 2 AS line, unnest([true, false]) AS is_awaited, true AS is_async FROM documents
      UNION ALL SELECT doc_id, 'fn' || doc_id, 'function', unnest(['one' || (doc_id % 2), 'map']), unnest([NULL, 'list']), unnest([5, 6]), false, doc_id % 2 = 0 FROM documents)
    SELECT 'm' || doc_id AS module_id, 'm' || doc_id || ':' || source AS source_id, source_type, name, qualifier, line, is_awaited, is_async,
           CASE WHEN name = 'ext0' AND doc_id % 3 = 0 THEN 'external' ELSE 'unresolved' END AS status, NULL::VARCHAR AS target_id FROM e""")
def callers(b: Bound) -> DataFrame:
    """Calls with the function that makes them, line and status: nested functions' own calls aren't their surroundings'."""
    given = b("documents").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("id"), F.expr(CALLERS).alias("text"))
    named = lambda df, *parts: df.select(F.concat(F.col("module_id"), F.lit(":"), F.concat_ws(".", *parts)).alias("id"), "module_id", "name")
    shapes = graphs.settled(entities.calling(given))
    return resolve.call_edges(given, named(entities.functions(shapes), "name"), named(entities.methods(shapes), "parent", "name"), shapes)


#: Methods by doc_id whose parameters have a type, a default, a rest, or nothing.
UNTYPED = """concat('class K', doc_id, ' { m', doc_id % 4, '(a, b: string, c = 1, ...d) { return (w) => w; } constructor(x) { } set v(y) { } n = (z) => z; ', CASE WHEN doc_id % 2 = 0 THEN 'k(e?, { p }, f?: any) { } ' ELSE '' END,
    '} interface I { m(h); } function q(r) { }')"""


@query("an08_implicit_any", """SELECT 'm' || doc_id AS module_id, 'K' || doc_id AS parent, 'm' || (doc_id % 4) AS method, 'a' AS parameter FROM documents UNION ALL SELECT 'm' || doc_id, 'K' || doc_id, 'k', 'e' FROM documents WHERE doc_id % 2 = 0""")
def implicit_any(b: Bound) -> DataFrame:
    """Parameters of classes' methods that are any without saying so."""
    return entities.implicit_any(b("documents").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("id"), F.expr(UNTYPED).alias("text")))
