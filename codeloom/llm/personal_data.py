"""Personal data by bootstrapped contextual extraction, in DataFrame operations alone.

Seeds are the spans that the fixed patterns of each kind find, and the values
that a text assigns to a token, key or password. The words around a seed make
its lexical contexts: the two words before it, and the word before with the word
after it. Contexts and surfaces form a bipartite graph that is scored in rounds:
a context's confidence for a kind is the share of the kind among the distinct
identifier-like surfaces that it surrounds, and a surface's score is the chance
that one of its confident contexts is right. Only contexts with enough distinct
surfaces of the kind and a high share count. Surfaces that only such contexts
support are added where they stand and no seed does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import shared

_SPACE = r"\x20\x09-\x0D"
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Kinds in the order of results. The borders added in front only keep a failing start from being tried again at
#: every character of one run; they change no match. Nor do possessive groups, which Java matches without recursion.
KINDS: dict[str, str] = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Names of what is kept secret. A value is 16 or more characters with a digit, assigned to such a name.
SECRETS = ("token", "secret", "password", "passwd", "key")
_VALUE = "[A-Za-z0-9_/+.-]"
#: Kinds that the base results leave out, with patterns of their seeds.
FURTHER: dict[str, str] = {
    "secret": rf"(?<!{_VALUE})(?={_VALUE}{{16}})(?<=(?i:{'|'.join(SECRETS)})[\"']?\x20{{0,3}}[=:]\x20{{0,3}}[\"']?)(?=[A-Za-z_/+.-]*+[0-9]){_VALUE}++={{0,2}}",
}
#: Words that may be identifiers: those with a digit or an at sign.
CANDIDATE = rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _luhn(digits: Column) -> Column:
    """Whether the checksum of a string of digits fits."""
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, n - k, F.lit(1)).cast("int") * (F.lit(1) + k % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _holds(kind: Column, match: Column) -> Column:
    """Whether a match of a kind's pattern is one of the kind."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(kind == "card", F.when(n.between(13, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(kind.isin(*FURTHER))
    )


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """An array of each match with its kind, place in order, length of the text since the last match, and contexts.

    Contexts are read from the text between the matches and from the matches
    themselves, three before and one behind, so each part of a text is read a few
    times, however many matches it has.
    """
    after, word = rf"^[{_SPACE}]*+([^{_SPACE}]++)", rf"(?<![^{_SPACE}])([^{_SPACE}]++)[{_SPACE}]*+\z"
    two_words = rf"(?<![^{_SPACE}])([^{_SPACE}]++)[{_SPACE}]++([^{_SPACE}]++)[{_SPACE}]*+\z"

    def shifted(part: Column, by: int, n: Column) -> Column:
        """n elements of part from number `by`; empty texts stand for those before the first."""
        return F.slice(F.concat(F.array_repeat(F.lit(""), -by), part) if by < 0 else part, 1 + max(by, 0), n)

    def each(s: Column) -> Column:
        found, between, n = s["found"], s["between"], F.size(s["found"])
        back = [shifted(x, -k, n) for k in (3, 2, 1) for x in (between, found)]
        ahead = [shifted(between, 1, n), shifted(F.concat(found, F.array(F.lit(""))), 1, n), shifted(F.concat(between, F.array(F.lit(""))), 2, n)]
        names = ["match", "gap", *(f"b{k}" for k in range(len(back))), *(f"a{k}" for k in range(len(ahead)))]
        zipped = F.arrays_zip(*(x.alias(name) for x, name in zip([found, shifted(between, 0, n), *back, *ahead], names, strict=True)))
        return F.transform(zipped, one)

    def one(m: Column, k: Column) -> Column:
        before, behind = F.lower(F.concat(*(m[f"b{k}"] for k in range(6)), m["gap"])), F.lower(F.concat(*(m[f"a{k}"] for k in range(3))))
        last, following = F.nullif(F.regexp_extract(before, word, 1), F.lit("")), F.nullif(F.regexp_extract(behind, after, 1), F.lit(""))
        pair = F.concat(F.nullif(F.regexp_extract(before, two_words, 1), F.lit("")), F.lit(" "), last)
        return F.struct(
            F.lit(kind).alias("kind"), k.alias("place"), m["match"].alias("match"), F.length(m["gap"]).alias("gap"), pair.alias("two_before"), F.concat(last, F.lit(" _ "), following).alias("around")
        )

    # A list of one binds matches and gaps, which are else made anew for every use.
    held = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return F.get(F.transform(F.array(held), each), F.lit(0))


def _spans(rows: DataFrame) -> DataFrame:
    """row, kind (null for a candidate), surface, start, stop and contexts of every seed and candidate."""
    each = rows.select("row", F.explode("found").alias("f")).select("row", "f.*")
    order = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("gap") + F.length("match")).over(order)
    placed = each.withColumn("stop", stop.cast("long")).withColumn("start", F.col("stop") - F.length("match"))
    seed = F.col("kind") != "candidate"
    kept = placed.filter(~seed | _holds(F.col("kind"), F.col("match")))
    return kept.select("row", F.when(seed, F.col("kind")).alias("kind"), F.lower("match").alias("surface"), "start", "stop", "two_before", "around")


def _uncovered(spans: DataFrame) -> DataFrame:
    """Seeds, and the candidates that no seed of their row overlaps."""
    seed = F.col("kind").isNotNull()
    by = Window.partitionBy("row").orderBy("start")
    reached = F.max(F.when(seed, F.col("stop"))).over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    back = Window.partitionBy("row").orderBy(F.desc("start"))  # a frame that grows takes linear time
    ahead = F.min(F.when(seed, F.col("start"))).over(back.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    marked = spans.withColumn("reached", reached).withColumn("ahead", ahead)
    clear = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.col("ahead").isNull() | (F.col("ahead") >= F.col("stop")))
    return marked.filter(seed | clear).drop("reached", "ahead")


def discovered(spans: DataFrame, support: int = 5, confidence: float = 0.8, accept: float = 0.9, rounds: int = 3) -> DataFrame:
    """row, kind, start and stop of the candidates that confident contexts vouch for.

    support: distinct surfaces of a kind that a context needs; confidence: their
    share among all its surfaces; accept: the score from which a surface counts.
    """
    contexts = F.explode(F.array_compact(F.array("two_before", "around"))).alias("context")
    edges = shared.written(spans.select("surface", contexts).distinct(), "contexts")
    seeds = spans.filter("kind is not null").select("surface", "kind").distinct().withColumn("score", F.lit(1.0))
    totals = edges.groupBy("context").agg(F.count("*").alias("total")).filter(F.col("total") >= support)
    scores = seeds
    for _ in range(rounds):
        trusted = (
            edges.join(scores, "surface")
            .groupBy("context", "kind")
            .agg(F.sum("score").alias("own"))
            .filter(F.col("own") >= support)
            .join(totals, "context")
            .select("context", "kind", F.least(F.col("own") / F.col("total"), F.lit(0.999)).alias("share"))
            .filter(F.col("share") >= confidence)
        )
        # Where several contexts vouch, a surface is wrong only if all are.
        vouched = (
            edges.join(trusted, "context")
            .groupBy("surface", "kind")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("share"))))).alias("score"))
            .filter(F.col("score") >= accept)
        )
        scores = shared.written(seeds.union(vouched).groupBy("surface", "kind").agg(F.max("score").alias("score")), "scores")
    best = scores.join(seeds.select("surface"), "surface", "left_anti").groupBy("surface").agg(F.max_by("kind", F.struct("score", "kind")).alias("new_kind"))
    # A surface counts where one of the trusted contexts surrounds it.
    here = spans.filter("kind is null").select("row", "surface", "start", "stop", contexts)
    return (
        here.join(best, "surface")
        .join(trusted.select("context", F.col("kind").alias("new_kind")), ["context", "new_kind"], "left_semi")
        .select("row", F.col("new_kind").alias("kind"), "start", "stop")
        .distinct()
    )


def find(docs: DataFrame, support: int = 5, confidence: float = 0.8, accept: float = 0.9, rounds: int = 3) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_discovered and n_spans of every row, repeated rows too.

    The counts by kind and base_sha256 are of the seeds; spans also has secrets
    and what contexts discovered, and n_spans counts all. Spans are
    kind:start:end in code points, end exclusive, by kind in the order of KINDS
    and FURTHER, then by start, with commas. A null or empty text has none; a
    null doc_id stays null; other columns, whatever their names, are left out;
    an empty table gives an empty table.
    """
    text = F.coalesce("text", F.lit(""))
    seeds = KINDS | FURTHER
    every = F.concat(*(_matches(text, kind, pattern) for kind, pattern in [*seeds.items(), ("candidate", CANDIDATE)]))
    rows = shared.written(
        docs.select("doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", F.when(text.rlike("[0-9@]"), every).alias("found")), "found"
    )
    spans = shared.written(_uncovered(_spans(rows)), "spans")
    new = discovered(spans, support, confidence, accept, rounds)
    base = spans.filter("kind is not null").select("row", "kind", "start", "stop", F.lit(True).alias("seed"))
    order = F.array_position(F.array(*map(F.lit, seeds)), F.col("kind"))
    told = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("stop").cast("string"))
    listed = base.union(new.withColumn("seed", F.lit(False))).select("row", "kind", "seed", F.struct(order.alias("order"), "start", "stop", told.alias("told")).alias("span"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda s: s["told"]), ",")

    by_row = listed.groupBy("row").agg(
        *(F.count_if(F.col("seed") & (F.col("kind") == k)).alias(f"n_{k}") for k in seeds),
        F.count_if(~F.col("seed")).alias("n_discovered"),
        F.count("*").alias("n_spans"),
        joined(F.collect_list(F.when(F.col("seed") & F.col("kind").isin(*KINDS), F.col("span")))).alias("base"),
        joined(F.collect_list("span")).alias("all"),
    )
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (
        rows.select("row", "doc_id")
        .join(by_row, "row", "left")
        .select(
            "doc_id",
            *(count(f"n_{k}") for k in KINDS),
            F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
            F.coalesce("all", F.lit("")).alias("spans"),
            *(count(f"n_{k}") for k in FURTHER),
            count("n_discovered"),
            count("n_spans"),
        )
    )
