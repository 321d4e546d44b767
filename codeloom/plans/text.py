"""Text analyzers, extractors and scans of source text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths, scalars
from codeloom.operators import complexity as walks
from codeloom.operators import graphs, pipeline, resolve, rules, sources_text
from codeloom.plans.bindings import Bound
from codeloom.plans.registry import query
from codeloom.sources import files

_TOKENS = r"'[a-zA-Z_$][\w$]*|[+\-*/%=<>!&|^~?:,;]'"
_VOLUME = f"CASE WHEN len(list_distinct(regexp_extract_all(text, {_TOKENS}))) > 1 THEN len(regexp_extract_all(text, {_TOKENS})) * log2(len(list_distinct(regexp_extract_all(text, {_TOKENS})))) ELSE 0.0 END"

#: Source text made of a document: an import, an export, comments and its words.
SOURCE = r"""concat('import type { A', doc_id % 7, ', B as C', doc_id % 5, ' } from "./f', doc_id % 11, '";\nimport X', doc_id % 3, ' from "pkg', doc_id % 13, '";\n/** doc */\nexport class K', doc_id, ' {}\n// line\n/* two\nlines */\n\nexport const v = a as any; if (x) { y!.z } // @ts-ignore\n')"""


def _source(b: Bound) -> DataFrame:
    return b("documents").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("id"), "doc_id", F.expr(SOURCE).alias("text"))




@query("src03_discovered_files", """SELECT id, relative_path FROM modules WHERE (package_id IN ('de', 'fr') OR relative_path LIKE 'src/src1/%' OR relative_path LIKE 'src/src/%' OR relative_path LIKE 'src/forum/%')
    AND NOT (package_id = 'fr' AND relative_path LIKE '%/index.ts')""")
def discovered(b: Bound) -> DataFrame:
    """Source files below the roots that each package's tsconfig includes; without include, or without a tsconfig, all are."""
    package = F.col("package_id")
    config = F.when(package == "fr", '{"exclude": ["**/index.ts"]}').when(package != "de", '// comment\n{"include": ["src/src1**/*", "./src/src/**/*.ts", "src/forum/*"], /* more */ }')
    configs = b("modules").select("package_id").distinct().withColumn("tsconfig", config)
    return files.included(b("modules").select("id", "package_id", "relative_path"), configs).select("id", "relative_path")


@query("src04_walked_files", r"""SELECT path FROM (SELECT seq, CASE seq % 10 WHEN 0 THEN 'node_modules/' || name WHEN 1 THEN '.git/' || name WHEN 2 THEN 'a/dist/' || name WHEN 3 THEN 'tmp/' || name WHEN 4 THEN 'a/vendor/' || name
    WHEN 5 THEN 'build/x/' || name WHEN 6 THEN 'out' || name WHEN 7 THEN 'coverage/' || name WHEN 8 THEN 'a/out/' || name ELSE relative_path END AS path FROM modules) WHERE seq % 10 IN (3, 4, 6, 9)""")
def walked(b: Bound) -> DataFrame:
    """Paths outside hidden and excluded folders."""
    folder = F.element_at(F.array(*map(F.lit, ("node_modules/", ".git/", "a/dist/", "tmp/", "a/vendor/", "build/x/", "out", "coverage/", "a/out/"))), (F.col("seq") % 10 + 1).cast("int"))
    path = F.when(F.col("seq") % 10 == 9, F.col("relative_path")).otherwise(F.concat(folder, "name"))
    return b("modules").select(path.alias("path")).filter(files.is_walked(F.col("path")))


_FILE = "CASE seq % 9 WHEN 0 THEN concat(name, '.d.ts') WHEN 1 THEN concat(name, '.TSX') WHEN 2 THEN concat(name, '.D.tsx') WHEN 3 THEN concat(name, '.json') WHEN 4 THEN concat(name, '.vue') WHEN 5 THEN concat(name, '.mts') WHEN 6 THEN concat(name, '.d.js') WHEN 7 THEN concat(name, '.Mjs') ELSE relative_path END"


@query("src05_source_predicate", "SELECT id, seq % 9 NOT IN (0, 2, 3, 5) AS source FROM modules")
def source_file(b: Bound) -> DataFrame:
    return b("modules").select("id", paths.is_source_file(F.expr(_FILE)).alias("source"))


@query("src06_embedded_scripts", r"SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<script>(.*?)</script>', 1), chr(10)) AS script FROM pages")
def scripts(b: Bound) -> DataFrame:
    return b("pages").select("page_id", sources_text.scripts(F.col("html")).alias("script"))


@query("src07_package_json", "SELECT p_partkey AS package_id, CASE WHEN p_partkey % 2 = 0 THEN 'dependencies' ELSE 'devDependencies' END AS scope, p_name AS name, '^' || p_size AS declared, CASE WHEN p_name LIKE 's%' THEN '9.9.9' ELSE '^' || p_size END AS version FROM part")
def package_json(b: Bound) -> DataFrame:
    scope = F.when(F.col("p_partkey") % 2 == 0, "dependencies").otherwise("devDependencies")
    json = F.concat(F.lit('{"'), scope, F.lit('": {"'), F.col("p_name"), F.lit('": "^'), F.col("p_size").cast("string"), F.lit('", "none": ""}, "other": {"x": "1"}}'))
    locks = b("part").filter(F.col("p_name").startswith("s")).select(F.col("p_name").alias("name"), F.lit("9.9.9").alias("version")).distinct()
    return sources_text.package_dependencies(b("part").select(F.col("p_partkey").alias("package_id"), json.alias("json")), locks)


@query("src08_lock_json", """SELECT p_partkey AS package_id, 'a' AS name, p_size || '.0.0' AS version FROM part WHERE p_partkey % 5 IN (0, 4) UNION ALL SELECT p_partkey, '@s/b', '1.' || p_size FROM part WHERE p_partkey % 5 = 0
    UNION ALL SELECT p_partkey, 'y' || (p_size % 4), p_size || '.1.0' FROM part WHERE p_partkey % 5 IN (1, 2)""")
def lock_json(b: Bound) -> DataFrame:
    """A package's lock: package-lock.json, else yarn.lock where that is missing or malformed, else nothing."""
    k, n = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    plain = F.concat(F.lit('{"packages": {"": {"name": "root"}, "node_modules/a": {"version": "'), n, F.lit('.0.0"}'))
    json = F.when(k == 0, F.concat(plain, F.lit(', "node_modules/@s/b": {"version": "1.'), n, F.lit('"}}}'))).when(k == 1, "oops {").when(k == 4, F.concat(plain, F.lit("}}")))
    yarn = F.when(k.isin(0, 1, 2), F.concat(F.lit("y"), (F.col("p_size") % 4).cast("string"), F.lit('@^1:\n  version "'), n, F.lit('.1.0"\n')))
    return sources_text.locked_versions(b("part").select(F.col("p_partkey").alias("package_id"), json.alias("lock_json"), yarn.alias("yarn_lock")))


@query("src09_yarn_lock", "SELECT p_partkey AS file, unnest(['@s/b', 'a' || p_size]) AS name, unnest(['2.0.0', p_size || '.1.0']) AS version FROM part")
def yarn_lock(b: Bound) -> DataFrame:
    n = F.col("p_size").cast("string")
    text = F.concat(F.lit('# yarn\n\na'), n, F.lit('@^1.0.0:\n  version "'), n, F.lit('.1.0"\n  resolved "x"\n\n"@s/b@~2":\n  version "2.0.0"\n'))
    return sources_text.lock_versions(b("part").select(F.col("p_partkey").alias("file"), text.alias("text")))


@query("src12_config_merge", """SELECT * FROM (VALUES ('complexity.error', '40'), ('complexity.warning', '20'), ('deep', 'true'), ('layers', '["a","b"]'), ('lines', '300'), ('mode', '"fast"')) t(key, value)""")
def config(b: Bound) -> DataFrame:
    """A configuration laid over the defaults, sections within sections; a field of a wrong type falls back, an unknown one goes."""
    defaults = {"complexity": {"warning": 20, "error": 30}, "lines": 300, "deep": False, "layers": [], "mode": "fast"}
    given = {"complexity": {"error": 40, "warning": "many", "odd": 1}, "lines": [], "deep": True, "layers": ["a", "b"], "unknown": 1, "mode": None}
    return b.spark.createDataFrame(sorted(files.flat(files.merged_config(defaults, given)).items()), "key string, value string")


@query("src11_report_json", "SELECT CASE WHEN turn % 4 < 3 THEN conv_id END AS conv_id, CASE WHEN turn % 4 < 3 THEN turn END AS turn, CASE WHEN turn % 4 < 3 THEN role || '}{\"' END AS role FROM conversations")
def reports(b: Bound) -> DataFrame:
    """Reports of other tools: the first JSON object of noisy output, with braces in its texts and behind it; one in the noise comes first."""
    json = F.to_json(F.struct("conv_id", "turn", F.concat("role", F.lit('}{"')).alias("role"), F.struct(F.lit("\\").alias("s")).alias("more")))
    turn = F.col("turn") % 4
    noisy = F.concat(F.when(turn == 3, "warn {x}\n").otherwise('it"s noise }\n'), json, F.when(turn == 1, '\nwarn {x} "').when(turn == 2, json).otherwise("\ndone"))
    return b("conversations").select(F.from_json(files.first_object(noisy), "conv_id long, turn long, role string").alias("r")).select("r.*")


@query("ext01_imports", """SELECT 'm' || doc_id AS module_id, './f' || (doc_id % 11) AS source, 'A' || (doc_id % 7) AS imported, 'A' || (doc_id % 7) AS local, 'type' AS kind FROM documents
    UNION ALL SELECT 'm' || doc_id, './f' || (doc_id % 11), 'B', 'C' || (doc_id % 5), 'type' FROM documents UNION ALL SELECT 'm' || doc_id, 'pkg' || (doc_id % 13), 'default', 'X' || (doc_id % 3), 'default' FROM documents""")
def imports(b: Bound) -> DataFrame:
    return sources_text.imports(_source(b))


@query("ext02_exports", "SELECT 'm' || doc_id AS id, 'K' || doc_id || ',v' AS names FROM documents")
def exports(b: Bound) -> DataFrame:
    return _source(b).select("id", F.array_join(sources_text.exports(F.col("text")), ",").alias("names"))


@query("ext03_barrel_detection", "SELECT seq AS id, CASE WHEN seq % 6 = 0 THEN false WHEN seq % 5 = 0 THEN true ELSE (seq % 4) * 1.0 / (seq % 6) > 0.8 END AS barrel FROM modules")
def barrel(b: Bound) -> DataFrame:
    s = F.col("seq")
    return b("modules").select(s.alias("id"), sources_text.is_barrel(s % 6, s % 4, s % 5 == 0).alias("barrel"))


@query("ext12_variable_initializers", "SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS initializer FROM documents")
def initializers(b: Bound) -> DataFrame:
    return b("documents").select("doc_id", scalars.truncate(F.col("text"), 500, "...").alias("initializer"))


@query("ext13_symbol_usages", "SELECT DISTINCT parent_id AS owner, kind, name FROM members")
def usages(b: Bound) -> DataFrame:
    return b("members").select(F.col("parent_id").alias("owner"), "kind", "name").dropDuplicates(["owner", "kind", "name"])


@query("an01_size", f"SELECT doc_id, len(string_split(text, chr(10))) AS physical_lines, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS logical_lines, 0 AS comment_lines, len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '\\S'))) AS blank_lines, {_VOLUME} AS volume FROM documents")
def size(b: Bound) -> DataFrame:
    return b("documents").select("doc_id", *(v.alias(k) for k, v in sources_text.sizes(F.col("text")).items()))


#: Code and comments of both kinds by doc_id, in SQL that both engines read.
_COMMENTED = """replace(concat(repeat('let a = 1; // tail~', CAST(doc_id % 3 AS INT)), repeat('// line~', CAST(doc_id % 4 AS INT)), repeat('~  ~', CAST(doc_id % 2 AS INT)),
    CASE WHEN doc_id % 5 = 0 THEN '/* two~lines */ code();~' ELSE '' END, 'end'), '~', chr(10))"""


@query("an01_size_of_code", """SELECT doc_id, (doc_id % 3 + doc_id % 4 + 2 * (doc_id % 2) + 2 * (doc_id % 5 = 0)::INT + 1)::INT AS physical_lines, (doc_id % 3 + (doc_id % 5 = 0)::INT + 1)::INT AS logical_lines,
    (doc_id % 4 + (doc_id % 5 = 0)::INT)::INT AS comment_lines, (2 * (doc_id % 2))::INT AS blank_lines FROM documents""")
def size_of_code(b: Bound) -> DataFrame:
    """The same over text with comments of both kinds."""
    made = {k: v for k, v in sources_text.sizes(F.col("text")).items() if k != "volume"}
    return b("documents").select("doc_id", F.expr(_COMMENTED).alias("text")).select("doc_id", *(v.alias(k) for k, v in made.items()))


@query("an02_unused_code", "SELECT module_id, count(*) AS unused, bool_or(name = 's1') AS dead FROM exports WHERE name NOT IN (SELECT imported FROM imports) GROUP BY 1")
def unused_code(b: Bound) -> DataFrame:
    """Recomputed here from exports and imports; a tool's saved report joins by path as jn16 does."""
    left = b("exports").join(b("imports").select(F.col("imported").alias("name")), "name", "left_anti")
    return left.groupBy("module_id").agg(F.count("*").alias("unused"), F.max(F.col("name") == "s1").alias("dead"))


#: An unused-code report's entry for a module by its number, in SQL that both engines read.
_ENTRY = """concat('{"file": "x", "exports": [{"name": "e', seq, '", "line": ', seq, ', "col": 1}', repeat(', {"line": 2}', CAST(seq % 2 AS INT)), '], "types": ', CASE WHEN seq % 3 = 0 THEN '[{"name": "T"}]' ELSE '[]' END,
    ', "unlisted": ', CASE WHEN seq % 5 = 0 THEN '[{"name": "pkg"}]' ELSE 'null' END, ', "odd": [{"name": "no"}], "files": ', CASE seq % 4 WHEN 0 THEN 'true' WHEN 1 THEN '[{"name": "f"}]' WHEN 2 THEN '[]' ELSE 'false' END, '}')"""


def _reported(b: Bound) -> tuple[DataFrame, DataFrame]:
    reports = b("modules").filter("seq % 7 <> 6").select(F.concat(F.lit("./"), "relative_path").alias("file"), F.expr(_ENTRY).alias("entry"))
    strange = b("modules").filter("seq % 7 = 6").select(F.concat(F.lit("elsewhere/"), "id", F.lit(".js")).alias("file"), F.expr(_ENTRY).alias("entry"))
    return rules.unused_code(reports.union(strange), b("modules"))


@query("an02_report_findings", """WITH m AS (SELECT * FROM modules WHERE seq % 7 <> 6)
    SELECT id AS module_id, 'knip.unusedExport' AS rule_code, 'warning' AS severity, 'Unused export: e' || seq AS message, seq::INT AS line FROM m UNION ALL SELECT id, 'knip.unusedExport', 'warning', 'Unused export: (anonymous)', 2 FROM m WHERE seq % 2 = 1
    UNION ALL SELECT id, 'knip.unusedType', 'info', 'Unused type export: T', NULL FROM m WHERE seq % 3 = 0 UNION ALL SELECT id, 'knip.unlistedDependency', 'warning', 'Unlisted dependency: pkg', NULL FROM m WHERE seq % 5 = 0
    UNION ALL SELECT id, 'knip.unusedFile', 'warning', 'Unused file: ./' || relative_path, NULL FROM m WHERE seq % 4 < 2""")
def report_findings(b: Bound) -> DataFrame:
    """Findings of a saved report; fields it doesn't know and files that are no module are left out."""
    return _reported(b)[0]


@query("an02_report_metrics", "SELECT id AS module_id, 1 + seq % 2 + (seq % 3 = 0)::BIGINT AS unused, seq % 4 < 2 AS dead FROM modules WHERE seq % 7 <> 6")
def report_metrics(b: Bound) -> DataFrame:
    return _reported(b)[1]


@query("an03_lint_findings", "SELECT id, rule_code, CASE severity WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'info' END AS severity FROM issues")
def lint(b: Bound) -> DataFrame:
    return b("issues").select("id", "rule_code", scalars.severity(F.col("severity")).alias("severity"))


#: A linter's messages for a module by its number, in SQL that both engines read.
_LINT = """CASE WHEN seq % 11 = 10 THEN 'no json' ELSE concat('[{"ruleId": "no-', seq % 5, '", "severity": ', seq % 3, ', "message": "said ', seq, '", "line": ', seq, ', "column": 2, "odd": {}}', repeat(', {"ruleId": null, "severity": 2, "message": "broken"}', CAST(seq % 2 AS INT)), ']') END"""


@query("an03_report_findings", """WITH m AS (SELECT * FROM modules WHERE seq % 11 <> 10 AND seq % 7 <> 3)
    SELECT id AS module_id, 'eslint.no-' || (seq % 5) AS rule_code, CASE seq % 3 WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, 'said ' || seq AS message, seq::INT AS line, 2 AS col FROM m
    UNION ALL SELECT id, 'eslint.unknown', 'error', 'broken', NULL, NULL FROM m WHERE seq % 2 = 1""")
def lint_report(b: Bound) -> DataFrame:
    """Findings of a linter's saved results; files that are no module and malformed lists have none."""
    file = F.when(F.col("seq") % 7 == 3, F.concat(F.lit("elsewhere/"), "name")).otherwise(F.col("relative_path"))
    return rules.lint_findings(b("modules").select(file.alias("file"), F.expr(_LINT).alias("messages")), b("modules"))


@query("an04_architecture", "SELECT e.src, e.dst, a.folder AS from_layer, z.folder AS to_layer FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes z ON z.id = e.dst WHERE (a.folder, z.folder) IN ((0, 1), (2, 1), (3, 4))")
def architecture(b: Bound) -> DataFrame:
    """Edges between layers that a rule forbids."""
    rules = b.spark.createDataFrame([(0, 1), (2, 1), (3, 4)], "from_layer int, to_layer int")
    layer = lambda key, name: b("nodes").select(F.col("id").alias(key), F.col("folder").alias(name))
    return b("edges").join(layer("src", "from_layer"), "src").join(layer("dst", "to_layer"), "dst").join(F.broadcast(rules), ["from_layer", "to_layer"], "left_semi").select("src", "dst", "from_layer", "to_layer")


@query("an05_duplication", r"""WITH l AS (SELECT 'm' || doc_id AS id, list_filter(list_transform(string_split(text, chr(10)), lambda x, k: {'line': trim(x), 'at': k, 'n': len(regexp_extract_all(x, '\w+|[^\s\w]'))}), lambda x: length(x.line) > 0) AS ls FROM documents),
    s AS (SELECT id, unnest(generate_series(1, len(ls) - 9)) AS k, ls FROM l WHERE len(ls) >= 10),
    f AS (SELECT sha1(array_to_string(list_transform(ls[k:k + 9], lambda x: x.line), chr(10))) AS fragment, id AS module_id, ls[k].at AS start_line FROM s WHERE list_sum(list_transform(ls[k:k + 9], lambda x: x.n)) >= 70)
    SELECT fragment, module_id, start_line, count(*) OVER (PARTITION BY fragment) AS places FROM f QUALIFY places > 1""")
def duplication(b: Bound) -> DataFrame:
    """Runs of ten lines with seventy tokens that come again."""
    return sources_text.clones(b("documents").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("id"), "text"))


_CLONES = r"""l AS (SELECT 'm' || doc_id AS id, list_filter(list_transform(string_split(text, chr(10)), lambda x, k: {'line': trim(x), 'at': k, 'n': len(regexp_extract_all(x, '\w+|[^\s\w]'))}), lambda x: length(x.line) > 0) AS ls FROM documents),
    s AS (SELECT id, unnest(generate_series(1, len(ls) - 9)) AS k, ls FROM l WHERE len(ls) >= 10),
    f AS (SELECT sha1(array_to_string(list_transform(ls[k:k + 9], lambda x: x.line), chr(10))) AS fragment, id, k, ls FROM s),
    w AS (SELECT *, first_value(id) OVER o AS fid, first_value(k) OVER o AS fk, count(*) OVER (PARTITION BY fragment) AS places FROM f WINDOW o AS (PARTITION BY fragment ORDER BY id, k)),
    x AS (SELECT *, k - row_number() OVER (PARTITION BY id, fid, k - fk ORDER BY k) AS island FROM w WHERE places > 1 AND (id <> fid OR k <> fk)),
    g AS (SELECT id, fid, k - fk AS diagonal, min(k) AS a, max(k) + 9 AS z, any_value(ls) AS ls, sha1(string_agg(fragment, '' ORDER BY k)) AS fingerprint FROM x GROUP BY id, fid, diagonal, island),
    c AS (SELECT fingerprint, fid AS first_module, b.ls[a - diagonal].at AS first_start, b.ls[z - diagonal].at AS first_end, g.id AS second_module, g.ls[a].at AS second_start, g.ls[z].at AS second_end,
                 b.ls[z - diagonal].at - b.ls[a - diagonal].at + 1 AS lines, list_sum(list_transform(g.ls[a:z], lambda x: x.n))::BIGINT AS tokens FROM g JOIN l b ON b.id = fid)"""


@query("an05_clone_pairs", f"WITH {_CLONES} SELECT * FROM c WHERE tokens >= 70")
def clone_pairs(b: Bound) -> DataFrame:
    """Maximal stretches that stand again, with lines and tokens."""
    return sources_text.clone_pairs(b("documents").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("id"), "text"))


@query("an05_duplicated_lines", f"WITH {_CLONES}, e AS (SELECT first_module AS module_id, lines FROM c WHERE tokens >= 70 UNION ALL SELECT second_module, lines FROM c WHERE tokens >= 70 AND second_module <> first_module) SELECT module_id, sum(lines)::BIGINT AS lines FROM e GROUP BY module_id")
def duplicated_lines(b: Bound) -> DataFrame:
    return sources_text.duplicated_lines(clone_pairs(b))


@query("an04_cycles", """WITH RECURSIVE reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON e.src = r.dst),
    m AS (SELECT a.src AS id, least(a.src, min(a.dst)) AS component FROM reach a JOIN reach z ON z.src = a.dst AND z.dst = a.src WHERE a.src <> a.dst GROUP BY a.src)
    SELECT component AS cycle, '[' || string_agg(id::VARCHAR, ',' ORDER BY id) || ']' AS participants_json, count(*) AS length FROM m GROUP BY component""")
def cycles(b: Bound) -> DataFrame:
    """Import cycles with those that take part, as they are stored."""
    found = graphs.strongly_connected(b("nodes"), b("edges"))
    return found.groupBy(F.col("component").alias("cycle")).agg(F.to_json(F.sort_array(F.collect_list("id"))).alias("participants_json"), F.count("*").alias("length"))


_TYPE = """CASE p_size % 5 WHEN 0 THEN 'A<B | C> | ''x|y'' | { a: 1 | 2 } | (() => void)' WHEN 1 THEN 'A | B' WHEN 2 THEN concat('A | ', repeat('(a | ', p_size), 'z', repeat(')', p_size), ' | [x | y]')
    WHEN 3 THEN concat('| X', repeat(' | \"q|\"', p_size)) ELSE 'Map<string, Array<A | B>>' END"""
_MEMBERS = "CASE p_size % 5 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 + p_size ELSE 1 END"


def _types(b: Bound) -> DataFrame:
    """Types that part's rows make, of one to many members."""
    return b("part").select(F.col("p_partkey").alias("id"), sources_text.union_members(F.expr(_TYPE.replace("''", "\\'"))).alias("members"))


@query("an06_inline_unions", f"SELECT p_partkey AS id, {_MEMBERS} AS members FROM part WHERE {_MEMBERS} >= 3")
def unions(b: Bound) -> DataFrame:
    """Types that are unions of three members or more where they stand."""
    return _types(b).filter("members >= 3")


_BRANCHES = r"'\bif\b' '\belse\s+if\b' '\bfor\b' '\bwhile\b' '\bcase\b' '\bcatch\b' '&&' '\|\|' '\?\?'".split(" ")
#: Documents with code behind them that has branches, and marks that are none.
_CODE = "concat(text, chr(10), CASE doc_id % 4 WHEN 0 THEN 'a ?? b ? c?.d : 1.5' WHEN 1 THEN 'if (x) { for (;;) {} } else if (z && (\"s\" || 7)) {}' WHEN 2 THEN '// while' ELSE 'switch (v) { case 1: } try {} catch (e) { ifs }' END)"
_BRANCHY = f"SELECT doc_id, {_CODE} AS text FROM documents"


def _branchy(b: Bound) -> DataFrame:
    return b("documents").select("doc_id", F.expr(_CODE).alias("text"))



@query("an07_complexity", "SELECT doc_id, 1 + " + " + ".join(f"len(regexp_extract_all(text, {p}))" for p in _BRANCHES) + f" AS complexity FROM ({_BRANCHY})")
def complexity(b: Bound) -> DataFrame:
    """Branches by pattern; nesting needs a syntax tree and is not told."""
    return _branchy(b).select("doc_id", sources_text.branch_count(F.col("text")).alias("complexity"))


#: Loose types by doc_id, in SQL that both engines read.
_LOOSE = """replace(concat(repeat('a = c as any; ', CAST(doc_id % 3 AS INT)), repeat('<T>b; ', CAST(doc_id % 2 AS INT)), CASE WHEN doc_id % 5 = 0 THEN 'let u: unknown; ' ELSE '' END, repeat('y!.z; ', CAST(doc_id % 4 AS INT)),
    'x != "any string"; ', CASE WHEN doc_id % 2 = 0 THEN '// @ts-ignore any~' ELSE '// @ts-expect-error~' END, CASE WHEN doc_id % 6 = 0 THEN '/* p as q */' ELSE '' END), '~', chr(10))"""


@query("an08_type_safety", """WITH c AS (SELECT doc_id, doc_id % 3 AS any_count, (doc_id % 5 = 0)::BIGINT AS unknown_count, doc_id % 3 AS as_count, doc_id % 2 AS angle_count, doc_id % 4 AS non_null_count, 1 AS ignore_count,
           (2 * (doc_id % 3) + 2 * (doc_id % 2) + (doc_id % 5 = 0)::INT + 2 * (doc_id % 4) + 1)::BIGINT AS identifiers FROM documents)
    SELECT *, any_count / greatest(identifiers, 1)::DOUBLE AS any_density FROM c""")
def type_safety(b: Bound) -> DataFrame:
    made = sources_text.type_safety(F.col("text"))
    return b("documents").select("doc_id", F.expr(_LOOSE).alias("text")).select("doc_id", *(v.alias(k) for k, v in made.items()))


#: Exports by doc_id, some with documentation before them, in SQL that both engines read.
_DOCUMENTED = """replace(concat(repeat('/** about ~ * @throws Error */~export function f(a) {}~', CAST(doc_id % 3 AS INT)), repeat('// no block~export class K {}~', CAST(doc_id % 4 AS INT)),
    CASE WHEN doc_id % 5 = 0 THEN '/** @deprecated */ export const v = 1;~/** of nothing exported */~const w = 2;~' ELSE '' END), '~', chr(10))"""


@query("an10_documentation", """WITH c AS (SELECT doc_id, (doc_id % 3 + doc_id % 4 + (doc_id % 5 = 0)::INT)::BIGINT AS exported, (doc_id % 3 + (doc_id % 5 = 0)::INT)::BIGINT AS documented, doc_id % 3 AS throws, (doc_id % 5 = 0)::BIGINT AS deprecated FROM documents)
    SELECT *, CASE WHEN exported = 0 THEN 0.0 ELSE documented / exported::DOUBLE END::DOUBLE AS coverage FROM c""")
def documentation(b: Bound) -> DataFrame:
    made = sources_text.doc_coverage(F.col("text"))
    return b("documents").select("doc_id", F.expr(_DOCUMENTED).alias("text")).select("doc_id", *(v.alias(k) for k, v in made.items()))


@query("an11_coupling", """SELECT n.id, count(DISTINCT o.dst) AS efferent, count(DISTINCT i.src) AS afferent, CASE WHEN count(DISTINCT o.dst) + count(DISTINCT i.src) = 0 THEN 0.0 ELSE count(DISTINCT o.dst) * 1.0 / (count(DISTINCT o.dst) + count(DISTINCT i.src)) END::DOUBLE AS instability
    FROM nodes n LEFT JOIN edges o ON o.src = n.id LEFT JOIN edges i ON i.dst = n.id GROUP BY n.id""")
def coupling(b: Bound) -> DataFrame:
    found = graphs.degrees(b("nodes"), b("edges"))
    return found.select("id", F.col("fan_out").alias("efferent"), F.col("fan_in").alias("afferent"), scalars.ratio(F.col("fan_out"), F.col("fan_in") + F.col("fan_out")).alias("instability"))


@query("an11_coupling_of_imports", r"""WITH w AS (SELECT id, module_id, regexp_replace(replace(regexp_extract(from_path, '^(.+)/[^/]*$', 1) || '/' || source, '/./', '/'), '[^/]+/\.\./', '') AS p FROM imports WHERE source LIKE '.%'),
    t AS (SELECT id, module_id, unnest(list_transform(['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.vue', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs', '/index.vue'], lambda e, k: {'path': p || e, 'rank': k})) AS c FROM w),
    r AS (SELECT t.id, t.module_id AS src, arg_min(m.id, {'rank': c.rank, 'id': m.id}) AS dst FROM t JOIN modules m ON m.relative_path = c.path GROUP BY t.id, t.module_id),
    g AS (SELECT DISTINCT src, dst FROM r WHERE src <> dst)
    SELECT m.id, (SELECT count(*) FROM g WHERE g.dst = m.id) AS fan_in, (SELECT count(*) FROM g WHERE g.src = m.id) AS fan_out FROM modules m""")
def coupling_of_imports(b: Bound) -> DataFrame:
    """The same over relative imports resolved by rank; modules without any are there with zeros."""
    own = b("imports").select("id", F.col("module_id").alias("src"))
    edges = resolve.ranked_candidates(b("imports"), b("modules")).join(own, "id").select("src", "dst").filter("src <> dst")
    return graphs.degrees(b("modules"), edges)


@query("an12_maintainability", f"""SELECT doc_id, greatest(0.0, least(100.0, 171 - 5.2 * ln(greatest({_VOLUME}, 1.0)) - 0.23 * (1 + """ + " + ".join(f"len(regexp_extract_all(text, {p}))" for p in _BRANCHES) + r""") - 16.2 * ln(greatest(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S') AND NOT regexp_matches(x, '^\s*//'))), 1)))) AS mi FROM (""" + _BRANCHY + ")")
def maintainability(b: Bound) -> DataFrame:
    return _branchy(b).select("doc_id", sources_text.maintainability(F.col("text")).alias("mi"))


#: A function by doc_id, in SQL that both engines read; every fourth document has none.
_FUNCTIONS = """CASE WHEN doc_id % 4 = 3 THEN '' ELSE concat(' ; export async function f', doc_id, '<T>(a: Map<string, T>, b = 1', repeat(', ...c', CAST(doc_id % 2 AS INT)), '): Promise<{ x: T }> { ',
    repeat('if (a && b) { for (const q of c) {} } else if (b || a && c) {} ', CAST(doc_id % 4 AS INT)), repeat('x = a ? 1 : "if (b)"; ', CAST(doc_id % 3 AS INT)), 'return () => { while (a) { /* if */ } } }') END"""


@query("anp_pipeline", """SELECT 'documentation' AS analyzer, count(*) * 5 AS facts FROM documents UNION ALL SELECT 'maintainability', count(*) FROM documents UNION ALL SELECT 'size', count(*) * 5 FROM documents
    UNION ALL SELECT 'complexity', 5 * count(*) FROM documents WHERE doc_id % 4 < 3 UNION ALL SELECT 'coupling', 3 * count(*) FROM documents""")
def facts(b: Bound) -> DataFrame:
    """Metrics of the analyzers over a function for each document; some are switched off."""
    docs = b("documents").select("doc_id", F.expr(_FUNCTIONS).alias("text"), F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("relative_path"))
    found, _ = pipeline.run_pipeline(b.spark, docs, disabled=("type-safety", "dep-cruiser", "call-graph", "legacy-rules", "duplication"))
    return found.groupBy("analyzer").agg(F.count("*").alias("facts"))


@query("an07_function_complexity", """SELECT 'm' || doc_id AS module_id, 'f' || doc_id AS name, 1 + 6 * (doc_id % 4) + doc_id % 3 AS cyclomatic, 8 * (doc_id % 4) + 1 * (doc_id % 3) + 3 AS cognitive, 2 AS nesting, 1 AS lines, 2 + doc_id % 2 AS params
    FROM documents WHERE doc_id % 4 < 3""")
def function_complexity(b: Bound) -> DataFrame:
    """McCabe's and cognitive complexity, nesting, lines and parameters of each named function."""
    modules = b("documents").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("id"), F.expr(_FUNCTIONS).alias("text"))
    return walks.functions(modules).drop("parent")


@query("fn15_union_split", f"SELECT p_partkey AS id, {_MEMBERS} AS members FROM part")
def union_split(b: Bound) -> DataFrame:
    return _types(b)
