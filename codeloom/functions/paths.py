"""Column expressions over module paths and import sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an import may end in, as written or as an index file.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue")
#: Prefixes of imports that stay inside the package.
INTERNAL = (".", "/", "@/", "src/")


def is_internal(source: Column) -> Column:
    out = F.lit(False)
    for prefix in INTERNAL:
        out = out | source.startswith(prefix)
    return out


def external_package(source: Column) -> Column:
    """The package that an import names; null for internal ones and for a scope without a name."""
    parts = F.split(source, "/")
    scoped = F.when((F.size(parts) >= 2) & (F.get(parts, F.lit(1)) != ""), F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    return F.when(is_internal(source) | (source == ""), None).when(source.startswith("@"), scoped).otherwise(F.get(parts, F.lit(0)))


def is_external(source: Column, flag: Column, package: Column) -> Column:
    """A stored flag wins, then a stored package name, then the form of the source."""
    return F.coalesce(flag, F.when(package.isNotNull(), True), ~is_internal(source))


def without_extension(path: Column) -> Column:
    """A path without a script extension (.vue stays) and without a final /index."""
    return F.regexp_replace(F.regexp_replace(path, r"\.(tsx?|jsx?|mjs|cjs)$", ""), "/index$", "")


def dirname(path: Column) -> Column:
    """The path before its last slash; empty if there is none or it comes first."""
    return F.regexp_extract(path, "^(.+)/[^/]*$", 1)


def normalize(path: Column, keep_leading_parents: bool = False) -> Column:
    """A path without empty and . parts, with .. resolved.

    .. at the root is dropped, or kept as Node's posix paths do.
    """

    def step(stack: Column, part: Column) -> Column:
        nothing = (F.size(stack) == 0) | (F.try_element_at(stack, F.lit(-1)) == "..")
        up = F.when(nothing, F.concat(stack, F.array(part)) if keep_leading_parents else stack).otherwise(F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
        return F.when(part.isin("", "."), stack).when(part == "..", up).otherwise(F.concat(stack, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def join_path(directory: Column, source: Column) -> Column:
    return normalize(F.concat_ws("/", directory, source), keep_leading_parents=True)


def variants(path: Column) -> Column:
    """A path as it is, without its extension, and, for an index file, its folder; each once."""
    bare = F.regexp_replace(path, r"\.(tsx?|jsx?|mjs|cjs|vue)$", "")
    folder = F.when(bare.endswith("/index"), F.regexp_replace(bare, "/index$", ""))
    return F.array_distinct(F.array_compact(F.array(path, bare, folder)))


def candidates(path: Column) -> Column:
    """The files that a path without extension may mean, in order: itself, with each extension, as each index file."""
    endings = ["", *EXTENSIONS, *(f"/index{e}" for e in EXTENSIONS)]
    return F.array_distinct(F.transform(F.array(*map(F.lit, endings)), lambda e: F.concat(path, e)))


def package_prefix(path: Column) -> Column:
    """What stands before /src/, unless that comes first."""
    at = F.locate("/src/", path)
    return F.when(at > 1, F.substring(path, F.lit(1), at - 1)).otherwise("")


def glob_prefix(glob: Column) -> Column:
    """A glob up to its first *, without slashes at the end."""
    return F.regexp_replace(F.regexp_replace(glob, r"\*.*$", ""), "/+$", "")


#: What a source file ends in, and what a file of declarations ends in, whatever the case.
SOURCE_FILE, DECLARATIONS = r"(?i)\.(ts|tsx|js|jsx|mjs|cjs|vue)$", r"(?i)\.d\.[cm]?tsx?$"
#: Paths of tests, whatever the case.
TEST_FILES = (
    r"(^|/)__tests__(/|$)",
    r"\.(test|spec)\.[cm]?[jt]sx?$",
    r"\.(e2e|integration)\.[cm]?[jt]sx?$",
    r"(^|/)(e2e|integration)(/|$)",
    r"(^|/)(test|tests|spec|specs)(/|$)",
)


def is_source_file(path: Column) -> Column:
    return path.rlike(SOURCE_FILE) & ~path.rlike(DECLARATIONS)


def is_test_file(path: Column) -> Column:
    """Whether any pattern of TEST_FILES fits; backslashes count as slashes, and no path is no test."""
    return F.coalesce(F.replace(path, F.lit("\\"), F.lit("/")).rlike("(?i)" + "|".join(TEST_FILES)), F.lit(False))
