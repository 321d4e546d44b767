"""Column expressions over names, numbers, JSON and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPECIFIERS = "array<struct<imported:string,local:string,kind:string>>"
#: The sections of package.json that name dependencies, and the scopes that stand for them.
SECTIONS = ("dependencies", "devDependencies", "peerDependencies")
SCOPES = ("dependency", "devDependency", "peerDependency")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; 0 where there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.nullif(whole.cast("double"), F.lit(0.0)))


def round_half_up(x: Column) -> Column:
    """To the next whole number, halves upwards also below zero."""
    return F.floor(x + 0.5)


def pascal_case(name: Column) -> Column:
    """A name joined at underscores, hyphens, white space and between a small and a capital letter, each part begun with a capital."""
    parts = F.split(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), r"[_\-\s]+")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate(text: Column, most: int, mark: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def without_leading_colon(text: Column) -> Column:
    return F.regexp_replace(text, r"^:\s*", "")


def rolling_hash(text: Column) -> Column:
    """h * 31 + unit of UTF-16, modulo 2**32; a code point beyond 65,535 is two units."""
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    on = lambda h, unit: (h * 31 + unit) % 4294967296

    def step(h: Column, c: Column) -> Column:
        above = F.ascii(c) - 65536
        pair = on(on(h, 55296 + F.floor(above / 1024)), 56320 + above % 1024)
        return F.when(above < 0, on(h, F.ascii(c))).otherwise(pair).cast("long")

    return F.aggregate(characters, F.lit(0).cast("long"), step)


def fingerprint(fragment: Column, first_file: Column, first_line: Column, second_file: Column, second_line: Column) -> Column:
    """SHA-1 of a clone's text; without any, of the two places with colons between."""
    return F.sha1(F.when(F.coalesce(fragment, F.lit("")) != "", fragment).otherwise(F.concat_ws(":", first_file, first_line.cast("string"), second_file, second_line.cast("string"))))


def format_delta(x: Column) -> Column:
    """0, 1 or 2 digits behind the point from 100, from 10 and below; n/a for what is no finite number."""
    size = F.abs(x)
    told = F.when(size >= 100, F.format_string("%.0f", x)).when(size >= 10, F.format_string("%.1f", x)).otherwise(F.format_string("%.2f", x))
    return F.when(_finite(x), told).otherwise("n/a")


def format_percent(x: Column) -> Column:
    """Thousands with a k, no digits behind the point from 100, else one; new for what is no finite number."""
    size = F.abs(x)
    told = F.when(size >= 1000, F.format_string("%.1fk%%", x / 1000)).when(size >= 100, F.format_string("%.0f%%", x)).otherwise(F.format_string("%.1f%%", x))
    return F.when(_finite(x), told).otherwise("new")


def _finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def maintainability(volume: Column, complexity: Column, lines: Column) -> Column:
    """171 - 5.2 ln V - 0.23 CC - 16.2 ln LOC between 0 and 100; logarithms of less than 1 count as 0."""
    raw = 171 - 5.2 * F.log(F.greatest(volume, F.lit(1.0))) - 0.23 * complexity - 16.2 * F.log(F.greatest(lines.cast("double"), F.lit(1.0)))
    return F.greatest(F.least(raw, F.lit(100.0)), F.lit(0.0))


def halstead_volume(tokens: Column) -> Column:
    """Tokens times the binary logarithm of distinct tokens; 0 with one or none."""
    volume = lambda t, n: F.when(n > 1, F.size(t) * F.log2(n.cast("double"))).otherwise(0.0)
    # A list of one binds the tokens, which are else found again for each use.
    return F.get(F.transform(F.array(tokens), lambda t: volume(t, F.size(F.array_distinct(t)))), F.lit(0))


def percent_delta(now: Column, before: Column) -> Column:
    """Change in percent; from nothing it is infinite, or 0 if nothing came."""
    return F.when(before == 0, F.when(now == 0, 0.0).otherwise(F.lit(float("inf")))).otherwise(100.0 * (now - before) / F.nullif(before, F.lit(0.0)))


def delta_direction(key: Column, delta: Column) -> Column:
    """Whether a change is for the better; more is worse, but for documentation coverage."""
    good = F.when(key == "docCoverage", delta > 0).otherwise(delta < 0)
    return F.when(delta == 0, "same").when(good, "better").otherwise("worse")


#: Stops of the heat ramp.
RAMP = ((34, 197, 94), (234, 179, 8), (239, 68, 68))


def heat(value: Column, most: Column | float) -> Column:
    """A colour between the ramp's stops, as rgb(r, g, b); the first one where the value is no finite number or most isn't above 0."""
    most = F.lit(most).cast("double") if isinstance(most, (int, float)) else most.cast("double")
    value = value.cast("double")
    t = F.when(_finite(value) & _finite(most) & (most > 0), F.greatest(F.least(value / F.nullif(most, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))).otherwise(0.0)

    def channel(k: int) -> Column:
        a, b, c = (stop[k] for stop in RAMP)
        return round_half_up(F.when(t <= 0.5, a + (b - a) * (t / 0.5)).otherwise(b + (c - b) * ((t - 0.5) / 0.5))).cast("int")

    return F.format_string("rgb(%d, %d, %d)", *(channel(k) for k in range(3)))


def specifiers(json: Column) -> Column:
    """Import specifiers; malformed JSON gives none, entries without a name are dropped, kind is value unless told."""
    parsed = F.coalesce(F.from_json(json, SPECIFIERS, {"mode": "PERMISSIVE"}), F.array().cast(SPECIFIERS))
    named = F.filter(parsed, lambda s: s["imported"].isNotNull() & (s["imported"] != ""))
    return F.transform(named, lambda s: F.struct(s["imported"].alias("imported"), s["local"].alias("local"), F.coalesce(s["kind"], F.lit("value")).alias("kind")))


def specifier_name(s: Column) -> Column:
    """imported, with its alias where that differs."""
    return F.when(s["local"].isNull() | (s["local"] == s["imported"]), s["imported"]).otherwise(F.concat(s["imported"], F.lit(" as "), s["local"]))


def package_scopes(json: Column) -> Column:
    """The dependency sections of a package.json; other sections and malformed JSON are dropped."""
    parsed = F.coalesce(F.from_json(json, "map<string,map<string,string>>"), F.create_map().cast("map<string,map<string,string>>"))
    return F.map_filter(parsed, lambda k, _: k.isin(*SECTIONS))


def scope_map(json: Column) -> Column:
    """The scope of each external dependency by name; entries of other values are dropped, malformed JSON and other types give none."""
    parsed = F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_filter(parsed, lambda _, v: v.isin(*SCOPES))


def type_only(specs: Column) -> Column:
    """Whether an import has specifiers and all are types."""
    return (F.size(specs) > 0) & F.forall(specs, lambda s: s["kind"] == "type")


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def uuid5(namespace: str, key: Column) -> Column:
    """The version 5 UUID of a key in a namespace."""
    raw = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(key, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(raw, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(raw, 1, 8), F.substring(raw, 9, 4), F.concat(F.lit("5"), F.substring(raw, 14, 3)), F.concat(variant, F.substring(raw, 18, 3)), F.substring(raw, 21, 12))


def severity(raw: Column) -> Column:
    """A severity of any tool as error, warning or info."""
    low = F.lower(raw)
    return F.when(low.isin("error", "2", "critical"), "error").when(low.isin("warn", "warning", "1"), "warning").otherwise("info")


def natural_order(name: Column) -> tuple[Column, Column]:
    """What to sort by: letters whatever their case and accents, each number by its value whatever its length; then the name as it is.

    A number is written as how many digits it has and then these, without zeros
    in front, so numbers compare by value as texts.
    """
    def by_value(t: Column) -> Column:
        digits = F.regexp_replace(t, "^0+(?=.)", "")
        return F.when(t.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 9, "0"), digits)).otherwise(t)

    parts = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.collate(F.array_join(F.transform(parts, by_value), ""), "UNICODE_CI_AI"), F.collate(F.coalesce(name, F.lit("")), "UNICODE")
