"""The queries op1 to op13 over the driver's tables, and their SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import exact_dedup, filter_audit, language_model, late_sessions, licenses, line_dedup, mixing, near_dedup, personal_data, pieces, quality, revisits, token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.captures_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return found.withColumn("headers", F.array_join(lines, "\n"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(quality.stored(_documents(spark, sf_dir)))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of every policy rejects, and rejects alone, from one stored ledger of all documents."""
    rows = quality.stored(_documents(spark, sf_dir))
    return reduce(DataFrame.union, (quality.ablations(rows, policy) for policy in quality.POLICIES))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(_documents(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(_documents(spark, sf_dir), size=3, percent=85)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(_documents(spark, sf_dir))


def op11_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_sessions.of_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_revisits, op2_source_mixing, op3_token_counts, op4_license_scan, op5_language_model, op6_quality_rules, op7_exact_dedup, op8_sentencepiece, op9_near_dedup, op10_personal_data, op11_late_sessions, op12_line_dedup, op13_filter_audit, quality_ablations)
}

_WORDS = r"'[^\x20\x09-\x0D]+'"

ORACLES: dict[str, str] = {
    "op1_revisits": r"""
    WITH u AS (SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
    v AS (SELECT page_id, html,
                 regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www\.', '') AS host,
                 regexp_replace(regexp_replace(regexp_replace(bare, '^[^/?]*', ''), '\?.*$', ''), '/+$', '') AS path,
                 list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_'))) AS q FROM u),
    k AS (SELECT page_id, html, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key, page_id % 4 AS kind, '"' || md5(html) || '"' AS tag FROM v),
    r AS (SELECT url_key, page_id AS at, page_id * 2 AS id, CASE WHEN kind = 0 THEN tag END AS tag, CASE WHEN kind < 2 THEN 'second ' || (page_id - 5) END AS modified, CASE WHEN kind <> 3 THEN sha1(html) END AS digest FROM k WHERE page_id % 11 <> 0),
    x AS (SELECT page_id * 2 + 1 AS record_id, url_key, page_id + 1000 AS ts, CASE WHEN kind = 0 THEN tag END AS new_tag, CASE WHEN kind < 2 THEN CASE WHEN page_id % 8 < 4 THEN 'second ' || (page_id - 5) ELSE 'second 0' END END AS new_modified,
                 CASE WHEN kind = 2 THEN sha1(html) END AS new_digest FROM k),
    m AS (SELECT x.*, r.id, r.tag, r.modified, r.digest FROM x ASOF LEFT JOIN r ON x.url_key = r.url_key AND x.ts > r.at),
    o AS (SELECT *, CASE WHEN id IS NULL THEN 'no_response' WHEN tag IS NOT NULL AND new_tag IS NOT NULL THEN CASE WHEN tag = new_tag THEN 'resolved' ELSE 'etag_differs' END
                 WHEN modified IS NOT NULL AND new_modified IS NOT NULL THEN CASE WHEN modified = new_modified THEN 'resolved' ELSE 'last_modified_differs' END
                 WHEN digest IS NOT NULL AND new_digest IS NOT NULL THEN CASE WHEN digest = new_digest THEN 'resolved' ELSE 'digest_differs' END ELSE 'no_validator' END AS outcome FROM m)
    SELECT record_id, url_key, ts, CASE WHEN outcome = 'resolved' THEN id END AS referent_id, outcome,
           CASE WHEN outcome = 'resolved' THEN 'content-type: text/html' || chr(10) || 'date: second ' || ts || coalesce(chr(10) || 'etag: ' || coalesce('W/' || new_tag, tag), '')
             || coalesce(chr(10) || 'last-modified: ' || coalesce(new_modified, modified), '') END AS headers,
           CASE WHEN outcome = 'resolved' THEN digest END AS payload_digest FROM o
    """,
    "op2_source_mixing": rf"""
    WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_WORDS})), 0)::BIGINT AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
    w AS (SELECT source, n, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
    l AS (
      SELECT source, n, weight, row_number() OVER o AS place,
             (1.5 * sum(n) OVER () - 2.0 * coalesce(sum(n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY n / weight, source NULLS LAST)),
    x AS (SELECT min({{'place': place, 'level': level}}) AS m FROM l WHERE level * weight <= 2.0 * n),
    t AS (SELECT source, n, (CASE WHEN m IS NULL OR place < m.place THEN 2.0 * n ELSE least(m.level * weight, 2.0 * n) END)::DOUBLE AS target FROM l CROSS JOIN x),
    r AS (SELECT doc_id, size, n, target, CASE WHEN n > 0 THEN target / n ELSE 0 END AS rate,
                 ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    c AS (SELECT *, (floor(rate) + (u < rate - floor(rate))::INT)::BIGINT AS copies FROM r)
    SELECT doc_id, size, n AS source_size, target, copies * size AS taken, copies FROM c
    """,
    "op7_exact_dedup": r"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                      sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
    w AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
                 count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM w
    """,
    "op6_quality_rules": rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    m AS (SELECT doc_id, regexp_extract_all(text, {_WORDS}) AS words,
                 length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                 length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORDS})) AS lines
          FROM d),
    g AS (SELECT doc_id, words, generate_series(1, len(words) - 4) AS starts FROM m WHERE len(words) >= 5),
    s AS (SELECT doc_id, unnest(starts) AS i, words FROM g),
    k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i+4], chr(10))) AS n FROM s),
    p AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM k, range(5) t(j) WHERE n > 1 GROUP BY doc_id),
    a AS (SELECT doc_id, len(words)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
                 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                 len(lines)::BIGINT AS n_lines, n_exclamations::BIGINT AS n_exclamations
          FROM m LEFT JOIN p USING (doc_id)),
    f AS (SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (20 * n_symbols > word_chars)::BIGINT
                 + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (20 * n_exclamations > word_chars)::BIGINT
                 + 32 * (word_chars > 40 * n_words)::BIGINT)::BIGINT AS failed FROM a)
    SELECT *, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, 'v1' AS policy FROM f
    """,
}

#: Each rule of the ledger by its bit.
_RULES = "(VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('duplicate_lines', 8), ('shouting', 16), ('long_words', 32)) r(rule, bit)"
ORACLES["quality_ablations"] = f"""
    WITH l AS ({ORACLES["op6_quality_rules"]}), m AS (SELECT p.policy, failed & mask AS failed, mask FROM l CROSS JOIN (VALUES ('base', 3), ('v1', 63)) p(policy, mask))
    SELECT policy, rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed = bit) AS n_failed_alone,
           count(*) FILTER ((failed & bit = failed) OR failed = 0) AS n_kept_without FROM m JOIN {_RULES} ON mask & bit <> 0 GROUP BY policy, rule
    """

ORACLES["op12_line_dedup"] = r"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
    k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    g AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
    m AS (SELECT doc_id, line, place, keeper IS NOT NULL AND keeper <> doc_id AS lost FROM k LEFT JOIN g USING (key))
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT lost), '')) AS kept_sha256 FROM m GROUP BY doc_id
    """

ORACLES["op13_filter_audit"] = r"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
    f AS (SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
                 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e FROM w),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS fails,
                 count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
    c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
    o AS (SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order FROM c p, c q, c r, c s, c t
          WHERE len(list_distinct([p.letter, q.letter, r.letter, s.letter, t.letter])) = 5),
    x AS (SELECT part, filter_order, step, filter_order[step:step] AS own, n, good, toxic,
                 contains(fails, filter_order[step:step]) AS failing, length(translate(filter_order[1:step - 1], fails, '')) < step - 1 AS gone, fails
          FROM m, o, range(1, 6) s(step)),
    y AS (SELECT part, filter_order, step::INT AS step, own, sum(n) FILTER (NOT failing AND NOT gone) AS kept, sum(n) FILTER (failing AND NOT gone) AS removed, sum(n) FILTER (failing AND gone) AS redundant,
                 sum(n) FILTER (fails = own) AS unique_fails, sum(good) FILTER (failing AND NOT gone) AS good_lost, sum(toxic) FILTER (failing AND NOT gone) AS toxic_lost
          FROM x GROUP BY part, filter_order, step, own)
    SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
           coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM y
    """

_CRC = """list_reduce([4294967295::BIGINT] || list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT),
    lambda acc, b: list_reduce([xor(acc, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))"""
ORACLES["op11_late_sessions"] = f"""
    WITH r AS (SELECT conv_id, turn, xor({_CRC.format("conv_id::VARCHAR")}, 4294967295) AS c, xor({_CRC.format("conv_id::VARCHAR || ':' || turn::VARCHAR")}, 4294967295) AS h
               FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
    a AS (SELECT 2 * floor(conv_id / 8)::BIGINT + c % 2 AS user, (c // 2) % 7200 + 300 * turn + h % 600 AS at_s, h, h // 600 AS g FROM r),
    e AS (SELECT user, at_s, h, at_s // 1800 + CASE WHEN g % 5 = 0 THEN g % 4 ELSE 0 END AS batch FROM a),
    s AS (SELECT e.*, b.batch AS now, row_number() OVER (PARTITION BY user, b.batch ORDER BY at_s) AS place,
                 coalesce(at_s - lag(at_s) OVER (PARTITION BY user, b.batch ORDER BY at_s) > 240, true)::INT AS begins
          FROM e JOIN (SELECT DISTINCT user, batch FROM e) b USING (user) WHERE e.batch <= b.batch),
    i AS (SELECT *, sum(begins) OVER (PARTITION BY user, now ORDER BY place) AS part FROM s),
    v AS (SELECT user, now AS batch, min(at_s) AS start_s, max(at_s) AS end_s, count(*) AS n_events, count(*) FILTER (batch = now) AS n_new, sum(h) AS h_sum
          FROM i GROUP BY user, now, part HAVING count(*) FILTER (batch = now) > 0),
    t AS (SELECT v.user, v.batch, v.start_s, min({{'b': w.batch, 's': w.start_s}}) AS by FROM v JOIN v w ON w.user = v.user AND w.batch > v.batch AND w.start_s <= v.start_s AND w.end_s >= v.end_s GROUP BY ALL)
    SELECT v.user, v.batch, v.start_s, v.end_s, v.n_events, v.n_new, (SELECT count(*) FROM t WHERE t.user = v.user AND t.by.b = v.batch AND t.by.s = v.start_s)::BIGINT AS n_retracted,
           v.h_sum::BIGINT AS h_sum, t.by.b AS retracted_batch, t.by.s AS retracted_start_s FROM v LEFT JOIN t ON t.user = v.user AND t.batch = v.batch AND t.start_s = v.start_s
    """
