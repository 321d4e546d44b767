"""Text metrics and extraction from source text, by expressions over the text column.

No parser for the analysed language is at hand, so entities are read by
patterns; what needs a syntax tree is approximate and says so.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import scalars
from codeloom.workers import ship_code

#: The tokens that the volume counts; numbers, brackets, dots and quotes are none.
TOKENS = r"[a-zA-Z_$][\w$]*|[+\-*/%=<>!&|^~?:,;]"
#: What makes a branch; else if counts as if, too.
BRANCHES = (r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b", r"&&", r"\|\|", r"\?\?")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def without_comments(text: Column) -> Column:
    """A text without block and line comments; line breaks in blocks stay."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)/\*.*?\*/"), F.lit(0))
    bare = F.aggregate(blocks, text, lambda t, block: F.replace(t, block, F.regexp_replace(block, "[^\n]", "")))
    return F.regexp_replace(bare, r"//[^\n]*", "")


def sizes(text: Column, bare: Column | None = None) -> dict[str, Column]:
    """Physical, logical, comment and blank lines, and the Halstead volume; bare: the text without comments, if it is a column already."""
    each, bare = lines(text), lines(without_comments(text) if bare is None else bare)
    blank = lambda x: F.regexp_replace(x, r"\s", "") == ""
    n_blank = F.size(F.filter(each, blank))
    logical = F.size(F.filter(bare, lambda x: ~blank(x)))
    return {
        "physical_lines": F.size(each),
        "logical_lines": logical,
        "comment_lines": F.size(each) - logical - n_blank,
        "blank_lines": n_blank,
        "volume": scalars.halstead_volume(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))),
    }


def branch_count(text: Column) -> Column:
    out = F.lit(1)
    for pattern in BRANCHES:
        out = out + F.regexp_count(text, F.lit(pattern))
    return out


def code_lines(text: Column) -> Column:
    """Lines that are neither blank nor begin with //."""
    return F.size(F.filter(lines(text), lambda x: ~F.regexp_replace(x, r"^\s+", "").startswith("//") & (F.regexp_replace(x, r"\s", "") != "")))


def maintainability(text: Column) -> Column:
    volume = scalars.halstead_volume(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)))
    return scalars.maintainability(volume, branch_count(text), code_lines(text))


#: Words of the language, which are no identifiers.
KEYWORDS = (
    "abstract any as async await boolean break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get if implements import in "
    "infer instanceof interface is keyof let module namespace never new null number object of package private protected public readonly return set static string super switch symbol this throw true try "
    "type typeof undefined unknown var void while with yield"
).split()


def without_strings(text: Column) -> Column:
    """A text whose quoted parts are empty; each ends on its line."""
    return F.regexp_replace(text, r"'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"", "''")


def type_safety(text: Column, bare: Column | None = None) -> dict[str, Column]:
    """Counts of loose types, as far as text shows them: comments and quoted parts aside, but for what is ignored; bare: the text without these, if it is a column already."""
    bare = without_comments(without_strings(text)) if bare is None else bare
    n = lambda pattern: F.regexp_count(bare, F.lit(pattern)).cast("long")
    any_count, words = n(r"\bany\b"), n(r"[A-Za-z_$][\w$]*")
    identifiers = words - n(rf"(?<![\w$])(?:{'|'.join(KEYWORDS)})(?![\w$])")
    return {
        "any_count": any_count,
        "unknown_count": n(r"\bunknown\b"),
        "as_count": n(r"\bas\s+[A-Za-z]"),
        "angle_count": n(r"(?<![\w$)\]>]\s?)<[A-Za-z_$][\w$.\[\]]*>\s*[\w$({\[]"),
        "non_null_count": n(r"[A-Za-z0-9_)\]]!(?![=!])"),
        "ignore_count": F.regexp_count(text, F.lit(r"@ts-(ignore|expect-error)")).cast("long"),
        "identifiers": identifiers,
        "any_density": any_count / F.greatest(identifiers, F.lit(1)),
    }


def scripts(html: Column) -> Column:
    """The bodies of the embedded scripts of a page or component; those with src= or another language are left out."""
    whole = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>.*?</script>"), F.lit(0))
    own = F.filter(whole, lambda s: ~s.rlike(r"(?is)^<script[^>]*\ssrc\s*=") & ~s.rlike(r"(?is)^<script[^>]*\slang\s*=\s*[\"'](?!(ts|tsx|js|jsx)[\"'])"))
    return F.array_join(F.transform(own, lambda s: F.regexp_extract(s, r"(?is)^<script[^>]*>(.*?)</script>$", 1)), "\n")


IMPORT = r"import\s+(type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\*\s+as\s+([\w$]+)|\{([^}]*)\})?\s*(?:from\s*)?['\"]([^'\"]+)['\"]"
EXPORT = r"export\s+(?:default\s+)?(?:abstract\s+|async\s+)?(class|function|const|let|var|type|enum|interface)\s+([\w$]+)"


def imports(modules: DataFrame) -> DataFrame:
    """module_id, source, imported, local and kind of every import; of names that come again under one path the first counts."""
    each = modules.select(F.col("id").alias("module_id"), F.posexplode(F.regexp_extract_all("text", F.lit(IMPORT), F.lit(0))).alias("place", "found"))
    part = lambda k: F.nullif(F.trim(F.regexp_extract("found", IMPORT, k)), F.lit(""))
    kind = F.when(part(1).isNotNull(), "type").otherwise("value")
    plain = F.lit(None).cast("string")
    named = F.transform(F.filter(F.split(F.coalesce(part(4), F.lit("")), ","), lambda s: F.trim(s) != ""), lambda s: F.struct(
        F.regexp_extract(F.trim(s), r"^(?:type\s+)?([\w$]+)", 1).alias("imported"),
        F.coalesce(F.nullif(F.regexp_extract(s, r"\sas\s+([\w$]+)", 1), F.lit("")), F.regexp_extract(F.trim(s), r"^(?:type\s+)?([\w$]+)", 1)).alias("local"),
        F.when(F.trim(s).startswith("type "), "type").otherwise(kind).alias("kind"),
    ))
    default = F.filter(F.array(F.struct(F.lit("default").alias("imported"), part(2).alias("local"), F.lit("default").alias("kind"))), lambda s: s["local"].isNotNull())
    space = F.filter(F.array(F.struct(F.lit("*").alias("imported"), part(3).alias("local"), F.lit("namespace").alias("kind"))), lambda s: s["local"].isNotNull())
    every = F.concat(default, space, named)
    effect = F.array(F.struct(plain.alias("imported"), plain.alias("local"), F.lit("sideEffect").alias("kind")))
    rows = each.select("module_id", "place", part(5).alias("source"), F.posexplode(F.when(F.size(every) == 0, effect).otherwise(every)).alias("at", "s"))
    first = rows.groupBy("module_id", "source", F.col("s.local").alias("local")).agg(F.min_by("s", F.struct("place", "at")).alias("s"))
    return first.select("module_id", "source", "s.imported", "local", "s.kind")


def exports(text: Column) -> Column:
    """Names that a text exports, each once; * for a whole re-export."""
    own = F.transform(F.regexp_extract_all(text, F.lit(EXPORT), F.lit(0)), lambda x: F.regexp_extract(x, EXPORT, 2))
    lists = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"export\s*\{([^}]*)\}"), F.lit(1)), lambda x: F.split(x, ",")))
    named = F.filter(F.transform(lists, lambda x: F.regexp_extract(F.trim(x), r"([\w$]+)$", 1)), lambda x: x != "")
    star = F.when(text.rlike(r"export\s*\*"), F.array(F.lit("*"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(own, named, star))


def is_barrel(n_exports: Column, n_reexports: Column, star: Column) -> Column:
    return F.when(n_exports == 0, False).when(star, True).otherwise(n_reexports / F.nullif(n_exports, F.lit(0)) > 0.8)


def doc_coverage(text: Column) -> dict[str, Column]:
    """Exported entities, those with a documentation block before them, and tags."""
    exported, documented = F.regexp_count(text, F.lit(EXPORT)), F.regexp_count(text, F.lit(r"(?s)/\*\*(?:(?!\*/).)*\*/\s*" + EXPORT))
    return {"exported": exported, "documented": documented, "coverage": scalars.ratio(documented, exported), "throws": F.regexp_count(text, F.lit(r"@throws\b")), "deprecated": F.regexp_count(text, F.lit(r"@deprecated\b"))}


def _runs(size: int) -> str:
    return "array<struct<" + ",".join(f"l{k}:struct<line:string,at:int,n:int>" for k in range(size)) + ">>"


def clones(modules: DataFrame, size: int = 10, tokens: int = 70) -> DataFrame:
    """fragment, module_id, start_line and places of runs of `size` lines, `tokens` tokens together at least, that stand in two places or more.

    Blank lines don't count, nor does space at a line's ends. Lines are shingled
    within a module and grouped by hash: a fragment's places are counted, never
    paired.
    """
    kept = F.filter(F.transform(lines(F.col("text")), lambda x, k: F.struct(F.trim(x).alias("line"), (k + 1).alias("at"), F.regexp_count(x, F.lit(r"\w+|[^\s\w]")).alias("n"))), lambda x: F.length(x["line"]) > 0)
    # The lists of first, second, ... lines of all runs lie side by side, so each line is touched once for each place.
    beside = F.arrays_zip(*(F.slice("kept", F.lit(k + 1), F.greatest(F.size("kept") - size + 1, F.lit(0))).alias(f"l{k}") for k in range(size)))
    text = lambda x: F.concat_ws("\n", *(x[f"l{k}"]["line"] for k in range(size)))
    enough = lambda x: sum((x[f"l{k}"]["n"] for k in range(1, size)), x["l0"]["n"]) >= tokens
    shingled = F.transform(F.filter("runs", enough), lambda x: F.struct(F.sha1(text(x)).alias("fragment"), x["l0"]["at"].alias("start_line")))
    modules = modules.select("id", kept.alias("kept")).select("id", beside.cast(_runs(size)).alias("runs"))
    placed = modules.select(F.col("id").alias("module_id"), F.explode(shingled).alias("s")).select("s.fragment", "module_id", "s.start_line")
    several = placed.groupBy("fragment").agg(F.count("*").alias("places")).filter("places > 1")
    return placed.join(several, "fragment").select("fragment", "module_id", "start_line", "places")


def _windows(modules: DataFrame, size: int) -> DataFrame:
    """fragment, module_id, place (among lines that aren't blank), from and to (lines), own (tokens of the first line) and tokens of all runs of `size` lines."""
    kept = F.filter(F.transform(lines(F.col("text")), lambda x, k: F.struct(F.trim(x).alias("line"), (k + 1).alias("at"), F.regexp_count(x, F.lit(r"\w+|[^\s\w]")).alias("n"))), lambda x: F.length(x["line"]) > 0)
    beside = F.arrays_zip(*(F.slice("kept", F.lit(k + 1), F.greatest(F.size("kept") - size + 1, F.lit(0))).alias(f"l{k}") for k in range(size)))
    text = lambda x: F.concat_ws("\n", *(x[f"l{k}"]["line"] for k in range(size)))
    each = lambda x, k: F.struct(
        F.sha1(text(x)).alias("fragment"), k.alias("place"), x["l0"]["at"].alias("from"), x[f"l{size - 1}"]["at"].alias("to"), x["l0"]["n"].alias("own"), sum((x[f"l{k}"]["n"] for k in range(1, size)), x["l0"]["n"]).alias("tokens")
    )
    runs = modules.select("id", kept.alias("kept")).select("id", beside.cast(_runs(size)).alias("runs"))
    return runs.select(F.col("id").alias("module_id"), F.explode(F.transform("runs", each)).alias("w")).select("module_id", "w.*")


def clone_pairs(modules: DataFrame, size: int = 10, tokens: int = 70) -> DataFrame:
    """Maximal stretches that stand again: a row for each, with the place where its text stood first.

    fingerprint, first_module, first_start, first_end, second_module,
    second_start, second_end, lines (of the first place) and tokens. Seeds are
    equal runs of `size` lines, blank ones and space at ends left out; each is
    paired with the first place of its text, in order of modules and lines, so a
    text of many places makes as many pairs and not their square. Seeds that
    follow each other in both modules lie on one diagonal and are one clone; it
    counts if it has so many tokens.
    """
    seeds = _windows(modules, size)
    first = seeds.groupBy("fragment").agg(F.min(F.struct("module_id", "place", "from", "to")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("fragment", "first")
    met = seeds.join(first, "fragment").filter((F.col("module_id") != F.col("first.module_id")) | (F.col("place") != F.col("first.place")))
    met = met.withColumn("diagonal", F.col("place") - F.col("first.place"))
    line = ["module_id", F.col("first.module_id"), "diagonal"]
    islands = met.withColumn("island", F.col("place") - F.row_number().over(Window.partitionBy(*line).orderBy("place")))
    whole = islands.groupBy("module_id", F.col("first.module_id").alias("first_module"), "diagonal", "island").agg(
        F.min("first.from").alias("first_start"), F.max("first.to").alias("first_end"), F.min("from").alias("second_start"), F.max("to").alias("second_end"),
        (F.sum("own") + F.max_by(F.col("tokens") - F.col("own"), "place")).alias("tokens"),
        F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "fragment"))), lambda x: x["fragment"]), "")).alias("fingerprint"),
    )
    counted = whole.filter(F.col("tokens") >= tokens).withColumn("lines", F.col("first_end") - F.col("first_start") + 1)
    return counted.select("fingerprint", "first_module", "first_start", "first_end", F.col("module_id").alias("second_module"), "second_start", "second_end", "lines", "tokens")


def duplicated_lines(pairs: DataFrame) -> DataFrame:
    """module_id and lines: those of all clones that a module takes part in, once where both places are its own."""
    sides = F.array_distinct(F.array("first_module", "second_module"))
    return pairs.select(F.explode(sides).alias("module_id"), "lines").groupBy("module_id").agg(F.sum("lines").alias("lines"))


#: A quoted part, to its end or the text's; a bracket or a bar; what stands between them, space left out.
_TYPE_PART = re.compile(r"""(?:'(?:[^'\\]|\\.)*+(?:'|\\?\Z)|"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|`[^`]*+`?)|[()\[\]{}<>|]|[^ '"`()\[\]{}<>|]+""", re.S)
_TYPE_CLOSE = {")": "(", "]": "[", "}": "{", ">": "<"}


def _members_of(text: str) -> int:
    depth, total, begun, n = dict.fromkeys("([{<", 0), 0, False, 0
    for part in _TYPE_PART.findall(text):
        if part == "|" and not total:
            begun = False
            continue
        n, begun = n + (not begun), True
        if part in depth:
            depth[part] += 1
            total += 1
        elif depth.get(opened := _TYPE_CLOSE.get(part, "")):
            depth[opened] -= 1
            total -= 1
    return n


def members_of_all(texts: pa.Array) -> pa.Array:
    """The count for each text of a batch; equal texts are walked once."""
    each = texts.dictionary_encode()
    return pa.array([_members_of(t) for t in each.dictionary.to_pylist()], pa.int32()).take(each.indices)


def union_members(type_text: Column) -> Column:
    """Members of a union type at its top level, however deep brackets, braces, angles and quotes nest; 0 for an empty text.

    An Arrow function walks over quoted parts, brackets and bars: the depth of
    each kind of bracket, never below 0, and whether a member has begun. It counts as not deterministic so that a
    filter on it isn't computed a second time below the column.
    """
    ship_code(SparkSession.active())

    @F.arrow_udf("int")
    def members(texts: pa.Array) -> pa.Array:
        return members_of_all(texts)

    return members.asNondeterministic()(type_text)


def lock_versions(text: DataFrame) -> DataFrame:
    """file, name and version from yarn.lock files: a header line carries on until the next one."""
    each = text.select("file", F.posexplode(lines(F.col("text"))).alias("at", "line"))
    header = F.when(F.col("line").rlike(r'^"?(@?[^@"\s]+)@'), F.regexp_extract("line", r'^"?(@?[^@"\s]+)@', 1))
    from pyspark.sql import Window

    carried = F.last(header, ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
    version = F.regexp_extract("line", r'^\s+version:?\s+"?([^"\s]+)"?', 1)
    return each.select("file", carried.alias("name"), version.alias("version")).filter("version <> '' and name is not null")


def locked_versions(packages: DataFrame) -> DataFrame:
    """package_id, name and version of each package's lock; packages: package_id, lock_json, yarn_lock (texts or null).

    package-lock.json counts if it can be read, else yarn.lock, else nothing is locked.
    """
    parsed = F.from_json("lock_json", "packages map<string,struct<version:string>>")["packages"]
    read = packages.withColumn("packages", parsed)
    prefix = "node_modules/"
    own = read.select("package_id", F.explode("packages").alias("path", "entry")).filter(F.col("path").startswith(prefix) & F.col("entry.version").isNotNull())
    by_json = own.select("package_id", F.substring("path", len(prefix) + 1, 1 << 30).alias("name"), F.col("entry.version").alias("version"))
    by_yarn = lock_versions(read.filter("packages is null and yarn_lock is not null").select(F.col("package_id").alias("file"), F.col("yarn_lock").alias("text")))
    return by_json.union(by_yarn.select("file", "name", "version"))


def package_dependencies(packages: DataFrame, locks: DataFrame) -> DataFrame:
    """package_id, scope, name, declared and version from package.json texts; a lock's version wins."""
    parsed = scalars.package_scopes(F.col("json"))
    each = packages.select("package_id", F.explode(parsed).alias("scope", "deps")).select("package_id", "scope", F.explode("deps").alias("name", "declared")).filter("declared <> ''")
    return each.join(locks.select("name", F.col("version").alias("locked")), "name", "left").select("package_id", "scope", "name", "declared", F.coalesce("locked", "declared").alias("version"))
