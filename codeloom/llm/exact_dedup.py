"""Exact dedup by a tree of merged digest runs, in DataFrame operations alone.

Every input partition is a run of digests. In a round, `fan_in` neighbouring
runs are merged into one: they are cut into as many ranges of digests, and each
of the partitions that held them takes one range of all of them, sorted, so the
rows of one digest stand side by side and become one, with the better row and
the sum of the counts. After log(runs) / log(fan_in) rounds one run is left,
cut into as many ranges as there were runs. A round moves a row for each digest
of a run, and a digest that a third of all rows share comes once from each run
after the first round; in that round a range holds `fan_in` input partitions at
most, whatever the size of the corpus.

A digest alone is not taken as proof: rows meet only if the length of the
normalised text and an independent 64-bit hash of it agree with the digest at
every level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import shared

KEY = ["text_sha256", "n_bytes", "check"]


def without_space(text: Column) -> Column:
    """text without characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in shared.SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, n_chars (of the original text), the key of the normalised text and the run (input partition) of every row."""
    plain = docs.select(F.col(id_column).alias("id"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), without_space(F.col("text")).alias("plain"))
    key = F.sha2("plain", 256).alias("text_sha256"), F.octet_length("plain").alias("n_bytes"), F.xxhash64("plain").alias("check")
    return plain.select("id", "n_chars", *key, F.spark_partition_id().alias("run"))


def _slice(ranges: int) -> Column:
    """Which of so many ranges of digests a row's lies in."""
    return F.floor(F.conv(F.substring("text_sha256", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("int")


def merge_runs(rows: DataFrame, fan_in: int = 8) -> DataFrame:
    """KEY, keep_id, n_chars (of the row that stays) and group_size of every digest of rows (id, n_chars, KEY, run).

    keep_id is that of the most characters, then the smallest; a null id comes
    after all others. Ids may be of any type that has an order.
    """
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    best = F.struct((-F.col("n_chars")).alias("shorter"), F.col("id").isNull().alias("unknown"), "id")
    level, left = rows.select(*KEY, best.alias("best"), F.lit(1).cast("long").alias("size"), "run"), runs
    while True:
        left = -(-left // fan_in)
        met = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).withColumn("slice", _slice(-(-runs // left)))
        # The aggregate finds its rows dealt and sorted by what it groups by, and so neither deals nor sorts again.
        dealt = met.repartition("run", "slice").sortWithinPartitions("run", "slice", *KEY)
        level = dealt.groupBy("run", "slice", *KEY).agg(F.min("best").alias("best"), F.sum("size").alias("size")).drop("slice")
        if left == 1:
            return level.select(*KEY, F.col("best.id").alias("keep_id"), (-F.col("best.shorter")).alias("n_chars"), F.col("size").alias("group_size"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Texts are equal without white space; of equal texts the one with the most
    code points stays, then the smallest doc_id. Null and white-space texts are
    equal to the empty text. Rows that repeat a doc_id count one by one in
    group_size, and each with keep_id's id is marked kept. A null doc_id stays
    only where the longest texts of its group have none; keep_id is null then.
    Other columns, whatever their names, are left out; an empty table gives an
    empty table.
    """
    rows = shared.written(digests(docs.select("doc_id", "text")), "digests")
    return rows.join(merge_runs(rows).drop("n_chars"), KEY).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def _known(doc_id: Column) -> Column:
    """An id as text that tells null from all others."""
    return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit(""))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names.

    Of rows that repeat a doc_id and, but for white space, a text one of the
    longest stays, whichever comes first. The texts are moved once: rows are
    first reduced by doc_id, length and digest, then met by those that stay
    under the same keys.
    """
    rows = shared.written(digests(docs.select("doc_id", "text")), "digests")
    own = shared.unused_prefix(docs)
    keys = [f"{own}id", f"{own}n_chars", *(f"{own}{c}" for c in KEY)]
    stay = merge_runs(rows).select(_known(F.col("keep_id")).alias(keys[0]), F.col("n_chars").alias(keys[1]), *(F.col(c).alias(f"{own}{c}") for c in KEY))
    plain = docs.withColumn(f"{own}plain", without_space(docs["text"]))
    text = F.col(f"{own}plain")
    made = _known(docs["doc_id"]), F.length(F.coalesce(docs["text"], F.lit(""))), F.sha2(text, 256), F.octet_length(text), F.xxhash64(text)
    keyed = plain.withColumns(dict(zip(keys, made, strict=True)))
    kept = keyed.drop(f"{own}plain").dropDuplicates(keys).join(stay, keys, "left_semi")
    return kept.drop(*keys).select(*(f"`{c.replace('`', '``')}`" for c in docs.columns))
