"""Source files and reports, read by Spark from any store."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths

#: Folders that are never walked, beside hidden ones.
EXCLUDED = ("node_modules", "dist", "build", "coverage", "out")


def is_walked(path: Column) -> Column:
    """Whether a relative path has no hidden or excluded folder in it."""
    return ~path.rlike(rf"(^|/)(\.[^/]*|{'|'.join(EXCLUDED)})/")


def first_object(text: Column) -> Column:
    """The text from its first brace to the one that closes it, braces in strings not counted; null if none does.

    A walk over the characters, in one expression: level, whether in a string
    and behind a backslash, characters passed, where the object begins and ends.
    """
    state = "struct<depth:int,quoted:boolean,escaped:boolean,at:int,begin:int,end:int>"
    start = F.struct(F.lit(0), F.lit(False), F.lit(False), F.lit(0), F.lit(0), F.lit(0)).cast(state)

    def step(s: Column, c: Column) -> Column:
        at, quoted = s["at"] + 1, s["quoted"]
        code = ~quoted & (s["end"] == 0)
        inside = code & (s["depth"] > 0)
        opens, closes = code & (c == "{"), inside & (c == "}")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        flips = (c == '"') & F.when(quoted, ~s["escaped"]).otherwise(inside)
        return F.struct(
            depth.alias("depth"),
            F.when(flips, ~quoted).otherwise(quoted).alias("quoted"),
            (quoted & (c == "\\") & ~s["escaped"]).alias("escaped"),
            at.alias("at"),
            F.when(opens & (s["begin"] == 0), at).otherwise(s["begin"]).alias("begin"),
            F.when(closes & (depth == 0), at).otherwise(s["end"]).alias("end"),
        ).cast(state)

    def cut(s: Column) -> Column:
        return F.when(s["end"] > 0, F.substring(text, s["begin"], s["end"] - s["begin"] + 1))

    return F.aggregate(F.split(text, ""), start, step, cut)


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """path, relative_path and text of the source files below root, without hidden and excluded folders.

    A file is one row, so a file must fit in memory; files are split over tasks.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split("://")[-1].rstrip("/")
    relative = F.regexp_replace("path", rf"^.*\Q{base}\E/", "")
    walked = is_walked(relative)
    return found.select("path", relative.alias("relative_path"), F.decode("content", "UTF-8").alias("text")).filter(walked & paths.is_source_file(F.col("relative_path")))


def json_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The first JSON object of each report file, whatever noise stands around it; a malformed one gives nulls."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json(first_object(F.col("value")), schema).alias("r")).select("r.*")


def included(modules: DataFrame, configs: DataFrame) -> DataFrame:
    """The modules below the roots that their package's tsconfig includes, but for those that it excludes by ending.

    modules: package_id, relative_path; configs: package_id, tsconfig (JSON with
    comments and commas too many; null for none). A glob includes what lies
    in the folder that its part before the first star names; one that begins with **/ excludes what
    ends in the rest. Without include, or without a config, everything is.
    """
    bare = F.regexp_replace("tsconfig", r"(?s),(?=\s*(?:/\*(?:(?!\*/).)*\*/\s*)*[}\]])", "")
    parsed = F.from_json(bare, "include array<string>, exclude array<string>", {"allowComments": "true"}).alias("c")
    clean = lambda g: F.regexp_replace(g, r"^\./", "")
    read = configs.filter("tsconfig is not null").select("package_id", parsed).select("package_id", F.col("c.include").alias("include"), F.col("c.exclude").alias("exclude"))
    inside = F.col("include").isNull() | F.exists("include", lambda g: (paths.glob_prefix(clean(g)) == "") | F.startswith("relative_path", F.concat(paths.glob_prefix(clean(g)), F.lit("/"))))
    ending = lambda g: g.startswith("**/") & F.endswith("relative_path", F.concat(F.lit("/"), F.substring(g, F.lit(4), F.length(g))))
    outside = F.coalesce(F.exists("exclude", ending), F.lit(False))
    return modules.join(read, "package_id", "left").filter(inside & ~outside).drop("include", "exclude")


def merged_config(defaults: dict, given: dict) -> dict:
    """defaults with given laid over, section by section; fields of another type than the default's, and unknown ones, are left out."""
    out = {}
    for key, value in defaults.items():
        other = given.get(key)
        if isinstance(value, dict):
            out[key] = merged_config(value, other) if isinstance(other, dict) else dict(value)
        else:
            out[key] = other if type(other) is type(value) else value
    return out


def flat(config: dict, above: str = "") -> dict[str, str]:
    """Fields by their path with dots, values as JSON."""
    out: dict[str, str] = {}
    for key, value in config.items():
        out |= flat(value, f"{above}{key}.") if isinstance(value, dict) else {f"{above}{key}": json.dumps(value, separators=(",", ":"))}
    return out
