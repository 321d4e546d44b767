"""Rules that give findings over a model's frames, transforms that rewrite what a finding names, and findings of saved reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import scalars
from codeloom.operators import resolve, sources_text

FINDING = ("module_id", "rule_code", "severity", "entity_name", "message", "suggestion", "action", "context")


@dataclass(frozen=True)
class Rule:
    """check gives, from frames by name, module_id, entity_name, message, suggestion, action and context (a JSON text) of what it finds."""

    code: str
    name: str
    severity: str
    check: Callable[[dict[str, DataFrame], int], DataFrame]


def _inline_unions(model: dict[str, DataFrame], threshold: int) -> DataFrame:
    n = sources_text.union_members(F.col("type"))
    found = model["properties"].withColumn("n", n).filter(F.col("n") >= F.greatest(F.lit(threshold), F.lit(2)))
    alias = F.concat("parent", scalars.pascal_case(F.col("name")))
    message = F.format_string("Property '%s' on %s '%s' has an inline union type with %d members that should be extracted to a named type alias.", "name", "parent_type", "parent", "n")
    context = F.to_json(F.struct(alias.alias("suggestedName"), F.col("parent").alias("parentName"), F.col("parent_type").alias("parentType"), F.col("name").alias("propertyName")))
    return found.select(
        "module_id", F.col("name").alias("entity_name"), message.alias("message"), F.concat(F.lit("Extract to type alias '"), alias, F.lit("'")).alias("suggestion"),
        F.lit("extract-type-union").alias("action"), context.alias("context"),
    )


RULES: dict[str, Rule] = {r.code: r for r in (Rule("type-union-without-alias", "Type Union Without Type Alias", "warning", _inline_unions),)}


def run_rules(model: dict[str, DataFrame], rules: dict[str, Rule] | None = None, threshold: int = 3) -> DataFrame:
    """FINDING of every rule; model: frames by name, as the rules ask for them (properties: module_id, parent, parent_type, name, type)."""
    chosen = (RULES if rules is None else rules).values()
    return reduce(DataFrame.unionByName, (r.check(model, threshold).withColumn("rule_code", F.lit(r.code)).withColumn("severity", F.lit(r.severity)).select(*FINDING) for r in chosen))


@dataclass(frozen=True)
class Transform:
    """execute gives the new text from the old one and the finding's context; null where it doesn't apply."""

    action: str
    name: str
    execute: Callable[[Column, Column], Column]


def _extract_union(text: Column, context: Column) -> Column:
    """The property's union becomes a type of its own before its parent, exported if that is; other properties so called stay.

    The parent's body is what stands from its head to the first line that begins
    with a closing brace.
    """
    c = F.from_json(context, "suggestedName string, parentName string, parentType string, propertyName string")
    word = lambda name: F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    head = F.concat(F.lit(r"(?sm)^((?:export\s+)?(?:default\s+)?(?:abstract\s+)?"), c["parentType"], F.lit(r"\s+"), word(c["parentName"]), F.lit(r"\b[^{]*\{.*?^\})"))
    extract = lambda t, pattern, k: F.call_function("regexp_extract", t, pattern, F.lit(k))  # noqa: E731  the pattern is a column
    body = extract(text, head, 1)
    mine = F.concat(F.lit(r"(?m)^(\s+(?:(?:public|private|protected|static|readonly)\s+)*"), word(c["propertyName"]), F.lit(r"[?!]?\s*:\s*)((?:[^;={}]|\{[^{}]*\}|=>)+?)(\s*(?:=(?!>)[^;]*)?;)"))
    union = extract(body, mine, 2)
    exported = F.when(F.startswith(body, F.lit("export")), "export ").otherwise("")
    alias = F.concat(exported, F.lit("type "), c["suggestedName"], F.lit(" = "), scalars.collapse_space(union), F.lit(";\n"))
    named = F.regexp_replace(body, mine, F.concat(F.lit("$1"), c["suggestedName"], F.lit("$3")))
    fits = (body != "") & (sources_text.union_members(union) >= 2)
    return F.when(fits, F.replace(text, body, F.concat(alias, named)))


TRANSFORMS: dict[str, Transform] = {t.action: t for t in (Transform("extract-type-union", "Extract Type Union", _extract_union),)}


def rewrite(requests: DataFrame, transforms: dict[str, Transform] | None = None) -> DataFrame:
    """requests (text, action, context and more) with success, transformed and error; text stays as it is.

    An unknown action, a context that names nothing and a text to which the
    transform doesn't apply are errors of their own row.
    """
    chosen = TRANSFORMS if transforms is None else transforms
    made = F.coalesce(*(F.when(F.col("action") == a, t.execute(F.col("text"), F.col("context"))) for a, t in chosen.items()), F.lit(None).cast("string"))
    error = F.when(~F.coalesce(F.col("action").isin(*chosen), F.lit(False)), F.concat(F.lit("unknown action "), F.coalesce("action", F.lit("null")))).when(F.col("transformed").isNull(), "the transform does not apply")
    return requests.withColumn("transformed", made).withColumn("error", error).withColumn("success", F.col("error").isNull())


#: Fields of an unused-code report, with the rule, severity and message of each; its name takes the place of %s.
REPORT_FIELDS: dict[str, tuple[str, str, str]] = {
    "exports": ("knip.unusedExport", "warning", "Unused export: %s"),
    "nsExports": ("knip.unusedNamespaceExport", "warning", "Unused namespace export: %s"),
    "types": ("knip.unusedType", "info", "Unused type export: %s"),
    "nsTypes": ("knip.unusedNamespaceType", "info", "Unused namespace type export: %s"),
    "duplicates": ("knip.duplicateExport", "warning", "Duplicate export: %s"),
    "enumMembers": ("knip.unusedEnumMember", "info", "Unused enum member: %s"),
    "classMembers": ("knip.unusedClassMember", "warning", "Unused class member: %s"),
    "namespaceMembers": ("knip.unusedNamespaceMember", "info", "Unused namespace member: %s"),
    "unlisted": ("knip.unlistedDependency", "warning", "Unlisted dependency: %s"),
    "unresolved": ("knip.unresolvedImport", "warning", "Unresolved import: %s"),
    "dependencies": ("knip.unusedDependency", "warning", "Unused dependency: %s"),
    "devDependencies": ("knip.unusedDevDependency", "info", "Unused devDependency: %s"),
    "optionalPeerDependencies": ("knip.unusedOptionalPeerDependency", "info", "Unused optional peer dependency: %s"),
    "binaries": ("knip.unusedBinary", "info", "Unused binary: %s"),
    "catalog": ("knip.unusedCatalogEntry", "info", "Unused catalog entry: %s"),
}
#: The fields that count as unused exports.
UNUSED_EXPORTS = ("exports", "nsExports", "types", "nsTypes", "enumMembers", "classMembers", "namespaceMembers")
_ENTRIES = "array<struct<name:string,line:int,col:int>>"


def unused_code(reports: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings (module_id, rule_code, severity, message, line) and metrics (module_id, unused, dead) of saved unused-code reports.

    reports: file and entry (JSON, a list for each field of REPORT_FIELDS, and
    files: a list or true where the whole file is unused); modules: id,
    relative_path. Files that are no module are left out; metrics are of modules
    with an unused export and of dead ones.
    """
    placed = reports.select(F.col("file").alias("path"), "entry").join(resolve.tiered(reports.select(F.col("file").alias("path")).distinct(), modules), "path")
    v = F.try_parse_json("entry")
    field = lambda name: F.coalesce(F.try_variant_get(v, f"$.{name}", _ENTRIES), F.array().cast(_ENTRIES))
    kinds = [F.struct(F.lit(name).alias("field"), F.lit(r).alias("rule_code"), F.lit(s).alias("severity"), F.lit(m).alias("told"), field(name).alias("entries")) for name, (r, s, m) in REPORT_FIELDS.items()]
    each = placed.select("module_id", F.explode(F.array(*kinds)).alias("k")).select("module_id", "k.*").select("module_id", "field", "rule_code", "severity", "told", F.explode("entries").alias("e"))
    findings = each.select("module_id", "rule_code", "severity", F.replace("told", F.lit("%s"), F.coalesce("e.name", F.lit("(anonymous)"))).alias("message"), F.col("e.line").alias("line"))
    whole = F.coalesce(F.size(F.try_variant_get(v, "$.files", "array<variant>")) > 0, F.try_variant_get(v, "$.files", "boolean"), F.lit(False))
    dead = placed.filter(whole).select("module_id", "path")
    files = dead.select("module_id", F.lit("knip.unusedFile").alias("rule_code"), F.lit("warning").alias("severity"), F.concat(F.lit("Unused file: "), "path").alias("message"), F.lit(None).cast("int").alias("line"))
    counted = each.filter(F.col("field").isin(*UNUSED_EXPORTS)).select("module_id", F.lit(1).alias("n"), F.lit(False).alias("d")).union(dead.select("module_id", F.lit(0), F.lit(True)))
    return findings.union(files), counted.groupBy("module_id").agg(F.sum("n").alias("unused"), F.max("d").alias("dead"))


_MESSAGES = "array<struct<ruleId:string,severity:int,message:string,line:int,column:int>>"


def lint_findings(reports: DataFrame, modules: DataFrame) -> DataFrame:
    """module_id, rule_code, severity, message, line and col of a linter's saved results.

    reports: file (a module's relative path) and messages (a JSON list of
    ruleId, severity, message, line and column); modules: id, relative_path.
    Severity 2 is an error, 1 a warning, any other info; a message without a
    rule is of an unknown one. Other files and malformed lists have no findings.
    """
    placed = reports.join(modules.select(F.col("id").alias("module_id"), F.col("relative_path").alias("file")), "file")
    each = placed.select("module_id", F.explode(F.from_json("messages", _MESSAGES)).alias("m"))
    severity = F.when(F.col("m.severity") == 2, "error").when(F.col("m.severity") == 1, "warning").otherwise("info")
    code = F.concat(F.lit("eslint."), F.coalesce("m.ruleId", F.lit("unknown")))
    return each.select("module_id", code.alias("rule_code"), severity.alias("severity"), "m.message", "m.line", F.col("m.column").alias("col"))
