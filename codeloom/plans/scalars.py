"""The scalar functions over bound columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import layout, paths, scalars
from codeloom.plans.bindings import Bound
from codeloom.plans.registry import query

_INTERNAL = "(source LIKE '.%' OR source LIKE '/%' OR source LIKE '@/%' OR source LIKE 'src/%')"


@query("fn01_external_package", f"""SELECT id, CASE WHEN {_INTERNAL} OR source = '' THEN NULL
    WHEN source LIKE '@%' THEN CASE WHEN split_part(source, '/', 2) <> '' THEN split_part(source, '/', 1) || '/' || split_part(source, '/', 2) END
    ELSE split_part(source, '/', 1) END AS package FROM imports""")
def external_package(b: Bound) -> DataFrame:
    return b("imports").select("id", paths.external_package(F.col("source")).alias("package"))


@query("fn02_strip_extension_index", r"""SELECT id, regexp_replace(regexp_replace(relative_path, '\.(tsx?|jsx?|mjs|cjs)$', ''), '/index$', '') AS path FROM modules""")
def strip(b: Bound) -> DataFrame:
    return b("modules").select("id", paths.without_extension(F.col("relative_path")).alias("path"))


@query("fn03_dirname", "SELECT page_id, regexp_extract(url, '^(.+)/[^/]*$', 1) AS directory FROM pages")
def dirname(b: Bound) -> DataFrame:
    return b("pages").select("page_id", paths.dirname(F.col("url")).alias("directory"))


@query("fn04_normalize_path", r"""SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace('a//./' || directory || '/x/../' || name || '/', '/(\./)+', '/', 'g'), '/+', '/', 'g'), '[^/]+/\.\./', ''), '/$', '') AS path FROM modules""")
def normalize(b: Bound) -> DataFrame:
    return b("modules").select("id", paths.normalize(F.concat(F.lit("a//./"), "directory", F.lit("/x/../"), "name", F.lit("/"))).alias("path"))


@query("fn05_posix_join", r"""SELECT id, '../' || name AS above, directory || '/' || name AS below FROM modules""")
def join_path(b: Bound) -> DataFrame:
    return b("modules").select("id", paths.join_path(F.lit("a/b"), F.concat(F.lit("../../../"), "name")).alias("above"), paths.join_path(F.col("directory"), F.concat(F.lit("./y/.././"), "name")).alias("below"))


@query("fn06_path_variants", r"""
    WITH v AS (SELECT id, relative_path AS p, regexp_replace(relative_path, '\.(tsx?|jsx?|mjs|cjs|vue)$', '') AS q FROM modules)
    SELECT id, p || ',' || q || CASE WHEN q LIKE '%/index' THEN ',' || left(q, length(q) - 6) ELSE '' END AS variants,
           list_sum([length(q) + length(e) for e in ['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.vue', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs', '/index.vue']])::BIGINT AS length
    FROM v""")
def variants(b: Bound) -> DataFrame:
    bare = F.regexp_replace("relative_path", r"\.(tsx?|jsx?|mjs|cjs|vue)$", "")
    length = F.aggregate(paths.candidates(bare), F.lit(0).cast("long"), lambda n, c: n + F.length(c))
    return b("modules").select("id", F.array_join(paths.variants(F.col("relative_path")), ",").alias("variants"), length.alias("length"))


@query("fn07_package_prefix", "SELECT page_id, CASE WHEN strpos(u, '/src/') > 1 THEN left(u, strpos(u, '/src/') - 1) ELSE '' END AS prefix FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(url, '/en/', '/src/') ELSE '/src/x' END AS u FROM pages)")
def package_prefix(b: Bound) -> DataFrame:
    u = F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit("/en/"), F.lit("/src/"))).otherwise("/src/x")
    return b("pages").select("page_id", paths.package_prefix(u).alias("prefix"))


@query("fn08_glob_prefix", r"SELECT id, rtrim(split_part(directory || '/**/' || name || '*.ts', '*', 1), '/') AS prefix FROM modules")
def glob_prefix(b: Bound) -> DataFrame:
    return b("modules").select("id", paths.glob_prefix(F.concat("directory", F.lit("/**/"), "name", F.lit("*.ts"))).alias("prefix"))


LAYERS = (("low", "src/src1"), ("mid", "src/src"), ("top", "src/src2"))


@query("fn09_first_layer", "SELECT id, CASE WHEN contains(relative_path, 'src/src1') THEN 'low' WHEN contains(relative_path, 'src/src') THEN 'mid' WHEN contains(relative_path, 'src/src2') THEN 'top' END AS layer FROM modules")
def first_layer(b: Bound) -> DataFrame:
    """The layers are configuration, so their number is fixed and they stand in the expression."""
    layer = F.coalesce(*(F.when(F.contains("relative_path", F.lit(prefix)), name) for name, prefix in LAYERS))
    return b("modules").select("id", layer.alias("layer"))


@query("fn10_regex_escape", r"SELECT page_id, regexp_replace(url, '([.*+?^${}()|\[\]\\])', '\\\1', 'g') AS escaped FROM pages")
def regex_escape(b: Bound) -> DataFrame:
    return b("pages").select("page_id", F.regexp_replace("url", r"([.*+?^${}()|\[\]\\])", r"\\$1").alias("escaped"))


@query("fn11_pascal_case", r"""WITH p AS (SELECT p_partkey AS id, p_name || '_' || lower(p_type) || '--a.b  fooBar9Baz_' AS s FROM part)
    SELECT id, array_to_string(list_transform(regexp_split_to_array(regexp_replace(s, '([a-z])([A-Z])', '\1 \2', 'g'), '[_\-\s]+'), lambda w: upper(w[1]) || w[2:]), '') AS name FROM p""")
def pascal(b: Bound) -> DataFrame:
    return b("part").select(F.col("p_partkey").alias("id"), scalars.pascal_case(F.concat("p_name", F.lit("_"), F.lower("p_type"), F.lit("--a.b  fooBar9Baz_"))).alias("name"))


@query("fn12_collapse_whitespace", r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM documents")
def collapse_space(b: Bound) -> DataFrame:
    return b("documents").select("doc_id", scalars.collapse_space(F.col("text")).alias("text"))


@query("fn13_truncate", "SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS head, CASE WHEN length(source) > 4 THEN left(source, 4) || '…' ELSE source END AS short FROM documents")
def truncate(b: Bound) -> DataFrame:
    return b("documents").select("doc_id", scalars.truncate(F.col("text"), 500, "...").alias("head"), scalars.truncate(F.col("source"), 4, "…").alias("short"))


@query("fn14_strip_leading_colon", "SELECT id, name FROM modules")
def strip_colon(b: Bound) -> DataFrame:
    return b("modules").select("id", scalars.without_leading_colon(F.concat(F.lit(":  "), "name")).alias("name"))


@query("fn16_object_layout", """SELECT id, CASE seq % 4 WHEN 0 THEN replace('{~   a: ' || seq || ';~   b: {~     c: string, d: [x, y] ~  } ~}', '~', chr(10)) WHEN 1 THEN replace('{~  x' || seq || ': Map<a, b>,~   y: "};" | z ~}', '~', chr(10))
    WHEN 2 THEN '{' || chr(10) || '}' END AS layout FROM modules""")
def object_layout(b: Bound) -> DataFrame:
    """Objects in objects, commas of types, quoted braces, an empty object, and a text that is no object."""
    n, k = F.col("seq").cast("string"), F.col("seq") % 4
    text = F.when(k == 0, F.concat(F.lit(" { a: "), n, F.lit("; b: { c: string, d: [x, y] } }"))).when(k == 1, F.concat(F.lit("{x"), n, F.lit(': Map<a, b>, y: "};" | z }'))).when(k == 2, "{}").otherwise("{ a } | { b")
    return b("modules").select("id", layout.object_layout(b.spark, text).alias("layout"))


@query("fn17_rolling_hash", """WITH t AS (SELECT id, CASE WHEN seq % 3 = 0 THEN relative_path || chr(128512) || 'é' ELSE relative_path END AS s FROM modules),
    u AS (SELECT id, flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN ord(c) < 65536 THEN [ord(c)::BIGINT] ELSE [(55296 + (ord(c) - 65536) // 1024)::BIGINT, (56320 + (ord(c) - 65536) % 1024)::BIGINT] END)) AS units FROM t)
    SELECT id, list_reduce(units, lambda h, c: (h * 31 + c) % 4294967296, 0::BIGINT) AS hash FROM u""")
def rolling_hash(b: Bound) -> DataFrame:
    text = F.when(F.col("seq") % 3 == 0, F.concat("relative_path", F.lit("\U0001f600é"))).otherwise(F.col("relative_path"))
    return b("modules").select("id", scalars.rolling_hash(text).alias("hash"))


@query("fn18_fingerprint", "SELECT id, sha1(CASE WHEN seq % 3 = 0 THEN name ELSE relative_path || ':' || line_count || ':' || directory || ':' || seq END) AS fingerprint FROM modules")
def fingerprint(b: Bound) -> DataFrame:
    fragment = F.when(F.col("seq") % 3 == 0, F.col("name")).when(F.col("seq") % 3 == 1, "")
    return b("modules").select("id", scalars.fingerprint(fragment, F.col("relative_path"), F.col("line_count"), F.col("directory"), F.col("seq")).alias("fingerprint"))


@query("fn19_uuid5", """WITH h AS (SELECT id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(package_id || '.' || relative_path)) AS h FROM modules)
    SELECT id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', ('0x' || h[17])::INT % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS uuid FROM h""")
def uuid5(b: Bound) -> DataFrame:
    return b("modules").select("id", scalars.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.concat_ws(".", "package_id", "relative_path")).alias("uuid"))


@query("fn20_guarded_ratio", "SELECT entity_id, snapshot, CASE WHEN sum(metric_value) FILTER (metric_key = '1-URGENT') IS NULL THEN 0.0 ELSE sum(metric_value) FILTER (metric_key = '1-URGENT') / sum(metric_value) END AS ratio FROM facts GROUP BY ALL")
def guarded_ratio(b: Bound) -> DataFrame:
    part = F.coalesce(F.sum(F.when(F.col("metric_key") == "1-URGENT", F.col("metric_value"))), F.lit(0.0))
    return b("facts").groupBy("entity_id", "snapshot").agg(scalars.ratio(part, F.sum("metric_value")).alias("ratio"))


@query("fn21_maintainability_index", "SELECT id, greatest(0.0, least(100.0, 171 - 5.2 * ln(greatest(line_count * 3.0, 1)) - 0.23 * (seq % 30) - 16.2 * ln(greatest(line_count, 1)))) AS mi FROM modules")
def maintainability(b: Bound) -> DataFrame:
    return b("modules").select("id", scalars.maintainability(F.col("line_count") * 3.0, F.col("seq") % 30, F.col("line_count")).alias("mi"))


@query("fn22_halstead_volume", r"WITH t AS (SELECT doc_id, regexp_extract_all(text || ' x1.y[0] != \"q\"', '[a-zA-Z_$][\w$]*|[+\-*/%=<>!&|^~?:,;]') AS t FROM documents) SELECT doc_id, CASE WHEN len(list_distinct(t)) > 1 THEN len(t) * log2(len(list_distinct(t))) ELSE 0.0 END AS volume FROM t")
def halstead(b: Bound) -> DataFrame:
    from codeloom.operators.sources_text import TOKENS

    return b("documents").select("doc_id", scalars.halstead_volume(F.regexp_extract_all(F.concat("text", F.lit(' x1.y[0] != "q"')), F.lit(TOKENS), F.lit(0))).alias("volume"))


@query("fn23_step_cost", "SELECT dst AS id, 1 + log2(count(*)) AS cost FROM edges GROUP BY dst")
def step_cost(b: Bound) -> DataFrame:
    from codeloom.operators.graphs import step_cost

    return b("edges").groupBy(F.col("dst").alias("id")).agg(step_cost(F.count("*")).alias("cost"))


@query("fn24_percent_delta", "SELECT id, CASE WHEN x = 0 THEN CASE WHEN y = 0 THEN 0.0 ELSE 'inf'::DOUBLE END ELSE 100.0 * (y - x) / x END AS percent FROM (SELECT id, (seq % 5)::DOUBLE AS x, (seq % 7)::DOUBLE AS y FROM modules)")
def percent_delta(b: Bound) -> DataFrame:
    return b("modules").select("id", scalars.percent_delta((F.col("seq") % 7).cast("double"), (F.col("seq") % 5).cast("double")).alias("percent"))


_NUMBER = "CASE WHEN seq % 13 = 5 THEN CAST('Infinity' AS DOUBLE) WHEN seq % 17 = 5 THEN CAST('NaN' AS DOUBLE) ELSE (CAST((seq * 377 % 4001 - 2000) * (seq % 3) * (seq % 3) AS DOUBLE) * 7 + 3) / 7 / (1 + seq % 2 * 99) END"


@query("fn25_number_format", f"""SELECT id, CASE WHEN NOT isfinite(x) THEN 'n/a' WHEN abs(x) >= 100 THEN printf('%.0f', x) WHEN abs(x) >= 10 THEN printf('%.1f', x) ELSE printf('%.2f', x) END AS delta,
    CASE WHEN NOT isfinite(x) THEN 'new' WHEN abs(x) >= 1000 THEN printf('%.1fk', x / 1000) || '%' WHEN abs(x) >= 100 THEN printf('%.0f', x) || '%' ELSE printf('%.1f', x) || '%' END AS percent FROM (SELECT id, {_NUMBER} AS x FROM modules)""")
def number_format(b: Bound) -> DataFrame:
    x = F.expr(_NUMBER)
    return b("modules").select("id", scalars.format_delta(x).alias("delta"), scalars.format_percent(x).alias("percent"))


@query("fn26_delta_direction", "SELECT id, CASE WHEN d = 0 THEN 'same' WHEN (k = 'docCoverage' AND d > 0) OR (k <> 'docCoverage' AND d < 0) THEN 'better' ELSE 'worse' END AS direction FROM (SELECT id, seq % 5 - 2 AS d, CASE WHEN seq % 2 = 0 THEN 'docCoverage' ELSE 'size' END AS k FROM modules)")
def delta_direction(b: Bound) -> DataFrame:
    key = F.when(F.col("seq") % 2 == 0, "docCoverage").otherwise("size")
    return b("modules").select("id", scalars.delta_direction(key, F.col("seq") % 5 - 2).alias("direction"))


@query("fn27_heat_colour", """WITH t AS (SELECT id, CASE WHEN seq % 4 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (line_count - 20) / (seq % 4 * 100.0))) END::DOUBLE AS t FROM modules),
    d AS (SELECT id, floor(0.5 + CASE WHEN t <= 0.5 THEN 34 + 200 * (t / 0.5) ELSE 234 + 5 * ((t - 0.5) / 0.5) END)::INT AS r, floor(0.5 + CASE WHEN t <= 0.5 THEN 197 - 18 * (t / 0.5) ELSE 179 - 111 * ((t - 0.5) / 0.5) END)::INT AS g,
                 floor(0.5 + CASE WHEN t <= 0.5 THEN 94 - 86 * (t / 0.5) ELSE 8 + 60 * ((t - 0.5) / 0.5) END)::INT AS b FROM t)
    SELECT id, printf('rgb(%d, %d, %d)', r, g, b) AS colour FROM d""")
def heat(b: Bound) -> DataFrame:
    """The scale of every fourth module is 0, and some values lie below 0."""
    return b("modules").select("id", scalars.heat(F.col("line_count") - 20, F.col("seq") % 4 * 100.0).alias("colour"))


@query("fn28_safe_json_array", "SELECT id, CASE WHEN specifiers_json = 'not json' THEN 0 ELSE 1 END::BIGINT AS n, CASE WHEN specifiers_json <> 'not json' THEN imported END AS name, CASE WHEN specifiers_json <> 'not json' THEN CASE WHEN is_type_only THEN 'type' ELSE 'value' END END AS kind FROM imports")
def safe_array(b: Bound) -> DataFrame:
    s = scalars.specifiers(F.col("specifiers_json"))
    return b("imports").select("id", F.size(s).cast("long").alias("n"), F.get(s, F.lit(0))["imported"].alias("name"), F.get(s, F.lit(0))["kind"].alias("kind"))


@query("fn29_safe_json_map", """SELECT event_id, CASE WHEN event_id % 10 = 3 THEN '' ELSE CASE event_id % 4 WHEN 0 THEN 'a=dependency,' WHEN 1 THEN 'a=devDependency,' WHEN 2 THEN 'a=peerDependency,' ELSE '' END || 'b=dependency' END AS scopes FROM events""")
def safe_map(b: Bound) -> DataFrame:
    """Scopes by name; other values, numbers and objects are dropped, and so is malformed JSON."""
    scope = F.element_at(F.array(*map(F.lit, ("dependency", "devDependency", "peerDependency", "dependencies"))), (F.col("event_id") % 4 + 1).cast("int"))
    json = F.when(F.col("event_id") % 10 == 3, "broken {").otherwise(F.concat(F.lit('{"a": "'), scope, F.lit('", "b": "dependency", "c": "bundled", "d": {"dependency": "dependency"}, "e": 5}')))
    told = F.transform(F.map_entries(scalars.scope_map(json)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return b("events").select("event_id", F.array_join(F.sort_array(told), ",").alias("scopes"))


@query("fn30_scope_precedence", "SELECT p_name AS name, min(CASE p_size % 3 WHEN 0 THEN '0 dependency' WHEN 1 THEN '1 peer' ELSE '2 dev' END)[3:] AS scope FROM part GROUP BY p_name")
def scope_precedence(b: Bound) -> DataFrame:
    """Of a package's scopes dependency comes before peer, and peer before dev."""
    rank = F.col("p_size") % 3
    scope = F.when(rank == 0, "dependency").when(rank == 1, "peer").otherwise("dev")
    return b("part").groupBy(F.col("p_name").alias("name")).agg(F.min_by(scope, rank).alias("scope"))


@query("fn31_specifier_names", "SELECT id, CASE WHEN specifiers_json = 'not json' THEN '(side-effect)' ELSE imported || ' as l' || (seq % 9) END AS names FROM imports")
def specifier_names(b: Bound) -> DataFrame:
    names = F.transform(scalars.specifiers(F.col("specifiers_json")), scalars.specifier_name)
    return b("imports").select("id", F.when(F.size(names) == 0, "(side-effect)").otherwise(F.array_join(names, ", ")).alias("names"))


@query("fn32_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM events")
def iso_time(b: Bound) -> DataFrame:
    return b("events").select("event_id", scalars.iso_time(F.col("ts")).alias("at"))


@query("fn33_polymorphic_list", "SELECT seq AS id, CASE seq % 3 WHEN 0 THEN name ELSE id END AS name FROM modules")
def polymorphic(b: Bound) -> DataFrame:
    """List entries are text, or objects named by id, module_id or name."""
    entry = F.when(F.col("seq") % 3 == 0, F.concat(F.lit('"'), "name", F.lit('"'))).when(F.col("seq") % 3 == 1, F.to_json(F.struct("id"))).otherwise(F.to_json(F.struct(F.col("id").alias("module_id"), "name")))
    v = F.parse_json(entry)
    text = F.coalesce(F.try_variant_get(v, "$.id", "string"), F.try_variant_get(v, "$.module_id", "string"), F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$", "string"))
    return b("modules").select(F.col("seq").alias("id"), text.alias("name"))


@query("fn34_location_label", "SELECT seq AS id, CASE seq % 4 WHEN 0 THEN relative_path || ':' || seq || '-' || (seq + 3) WHEN 1 THEN id WHEN 2 THEN name ELSE 'unknown' END AS label FROM modules")
def location(b: Bound) -> DataFrame:
    k = F.col("seq") % 4
    file, module, entity = F.when(k == 0, F.col("relative_path")), F.when(k == 1, F.col("id")), F.when(k == 2, F.col("name"))
    spot = F.concat(file, F.lit(":"), F.col("seq").cast("string"), F.lit("-"), (F.col("seq") + 3).cast("string"))
    return b("modules").select(F.col("seq").alias("id"), F.coalesce(spot, module, entity, F.lit("unknown")).alias("label"))


@query("fn35_type_only_flag", "SELECT id, specifiers_json <> 'not json' AND is_type_only AS type_only FROM imports")
def type_only(b: Bound) -> DataFrame:
    return b("imports").select("id", scalars.type_only(scalars.specifiers(F.col("specifiers_json"))).alias("type_only"))
