"""Not-modified revisits of a web archive, resolved to the full responses they stand for.

A revisit is met with the latest response of the same canonical URL that was
captured before it. The as-of join has two levels, so that a URL that a third
of all captures share is spread over the cluster: the moments of all URLs, in
one order, are cut into partitions of about equal rows; within a URL's part of a
partition a window finds the latest response so far, and of each part only its
last response goes to the parts after it.

The response found stands if the validators agree: entity tags where both have
one (weak ones compare by their opaque part), else dates of last modification
where both have one, else payload digests. The revisit's headers then replace
the response's, but for those that describe the stored payload or one
connection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import shared

#: Headers that a not-modified answer does not change.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-language", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """A URL without scheme, user, www, default port, fragment and utm_ parameters; host in lower case, parameters in order, no slash at the end."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^[^@]*@", ""), ":(80|443)$", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    path = F.regexp_replace(F.regexp_replace(rest, "\\?.*$", ""), "/+$", "")
    query = F.regexp_extract(rest, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_")))
    asked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(F.regexp_replace(host, "^www\\.", ""), path, asked)


def named_headers(headers: Column) -> Column:
    """Headers by lower-case name; of names that differ in case only the last one's value counts; null is empty."""
    none = F.create_map().cast("map<string,string>")
    entries = F.transform(F.map_entries(F.coalesce(headers, none)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"]))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored response's headers with those of a not-modified answer that may replace them; both by lower-case name."""
    fixed = F.array(*map(F.lit, KEPT_HEADERS))
    update = F.map_filter(fresh, lambda k, _: ~F.array_contains(fixed, k))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)


def _outcome(stored: Column, fresh: Column, stored_digest: Column, digest: Column) -> Column:
    """Whether a response's validators fit those of a revisit."""
    opaque = lambda h: F.regexp_replace(F.trim(F.get(F.array(h["etag"]), 0)), "^W/", "")
    ours, theirs = opaque(stored), opaque(fresh)
    when, then = stored["last-modified"], fresh["last-modified"]
    return (
        F.when(ours.isNotNull() & theirs.isNotNull(), F.when(ours == theirs, "resolved").otherwise("etag_differs"))
        .when(when.isNotNull() & then.isNotNull(), F.when(when == then, "resolved").otherwise("last_modified_differs"))
        .when(stored_digest.isNotNull() & digest.isNotNull(), F.when(stored_digest == digest, "resolved").otherwise("digest_differs"))
        .otherwise("no_validator")
    )


def _latest(moments: DataFrame, parts: int | None) -> DataFrame:
    """url_key, ts and met: the last full response (ts, record_id) of the URL before that moment.

    moments: url_key, ts (each pair once) and full, the response at that moment
    if there is one. parts: partitions of the order; as many as a shuffle has if
    not given.
    """
    ranged = moments.repartitionByRange(*([parts] if parts else []), "url_key", "ts").withColumn("part", F.spark_partition_id())
    placed = shared.written(ranged, "moments")
    before = Window.partitionBy("url_key", "part").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("found", F.last("full", ignorenulls=True).over(before))
    # One row for each URL and partition that has it, so a URL has no more than there are partitions.
    last = placed.groupBy("url_key", "part").agg(F.max("full").alias("last"))
    earlier = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("url_key", "part", F.max("last").over(earlier).alias("carried"))
    return near.join(carried, ["url_key", "part"]).select("url_key", "ts", F.coalesce("found", "carried").alias("met"))


def resolve(records: DataFrame, parts: int | None = None) -> DataFrame:
    """A row for each revisit: record_id, url_key, ts, referent_id, outcome, headers and payload_digest.

    records: record_id, url, ts (a whole number), kind ('response' or
    'revisit'), status, headers (map) and payload_digest. Only responses of
    status 200 are full. Earlier means a smaller ts; of responses at one time the
    one with the largest record_id counts. outcome is resolved, etag_differs,
    last_modified_differs, digest_differs, no_validator or no_response; only a
    resolved revisit gets referent_id, merged headers and the response's digest.
    A null url or ts has no response; null headers are empty; repeated rows give
    repeated results, and of responses that repeat record_id and ts the one with
    the largest digest counts; other columns, whatever their names, are left
    out; an empty table gives an empty table.
    """
    wanted = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind", "status", named_headers(F.col("headers")).alias("headers"), "payload_digest")
    every = shared.written(wanted, "captures")
    is_full = (F.col("kind") == "response") & (F.col("status") == 200)
    slim = every.filter("url_key is not null and ts is not null").filter(is_full | (F.col("kind") == "revisit"))
    # Captures of one URL and moment share one answer, so they are one row before they are dealt.
    moments = slim.groupBy("url_key", "ts").agg(F.max(F.when(is_full, F.struct("ts", "record_id"))).alias("full"))
    met = _latest(moments, parts).filter("met is not null").select("url_key", "ts", F.col("met.record_id").alias("met_id"), F.col("met.ts").alias("met_ts"))
    stored = every.filter(is_full).groupBy(F.col("record_id").alias("met_id"), F.col("ts").alias("met_ts"))
    stored = stored.agg(F.max_by(F.struct("headers", "payload_digest"), F.coalesce("payload_digest", F.lit(""))).alias("stored"))
    told = every.filter("kind = 'revisit'").join(met, ["url_key", "ts"], "left").join(stored, ["met_id", "met_ts"], "left")
    outcome = F.when(F.col("met_id").isNull(), "no_response").otherwise(_outcome(F.col("stored.headers"), F.col("headers"), F.col("stored.payload_digest"), F.col("payload_digest")))
    good = outcome == "resolved"
    return told.select(
        "record_id",
        "url_key",
        "ts",
        F.when(good, F.col("met_id")).alias("referent_id"),
        outcome.alias("outcome"),
        F.when(good, merged_headers(F.col("stored.headers"), F.col("headers"))).alias("headers"),
        F.when(good, F.col("stored.payload_digest")).alias("payload_digest"),
    )


def captures_of(pages: DataFrame, later: int = 1000) -> DataFrame:
    """Captures that stand for a table of pages: each page's response, and a revisit of it `later` seconds on.

    Page page_id is captured at second page_id; every eleventh is not found.
    Pages differ, by page_id modulo 4, in the validators that response and
    revisit have: a tag (the digest of the html) and a date of modification, the
    date alone, the payload digest alone, none. The revisit of every second page
    with a date names another one. Each revisit has a new date and another
    content type, which must not win.
    """
    kind, second = F.col("page_id") % 4, lambda c: F.concat(F.lit("second "), c.cast("string"))
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))

    def headers(**values: Column) -> Column:
        entries = F.array(*(F.struct(F.lit(k.replace("_", "-")).alias("key"), v.alias("value")) for k, v in values.items()))
        return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))

    digest = F.when(kind != 3, F.sha1("html"))
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("ts"), F.lit("response").alias("kind"), F.when(F.col("page_id") % 11 == 0, 404).otherwise(200).alias("status"),
        headers(ETag=F.when(kind == 0, tag), Last_Modified=F.when(kind < 2, second(F.col("page_id") - 5)), Content_Type=F.lit("text/html"), Date=second(F.col("page_id"))).alias("headers"),
        digest.alias("payload_digest"),
    )
    modified = F.when(kind < 2, F.when(F.col("page_id") % 8 < 4, second(F.col("page_id") - 5)).otherwise("second 0"))
    at = F.col("page_id") + later
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", at.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        headers(etag=F.when(kind == 0, F.concat(F.lit("W/"), tag)), last_modified=modified, content_type=F.lit("text/plain"), date=second(at)).alias("headers"),
        F.when(kind == 2, digest).alias("payload_digest"),
    )
    return response.union(revisit)
