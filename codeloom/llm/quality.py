"""Quality rules as a ledger of bits.

Measurements of every text are taken once. Each rule is evaluated once and its
failure is a bit of the document's `failed` number, kept beside the
measurements; `stored` keeps these rows in the shared folder. A policy is a
versioned mask of rules: a document passes if it fails none of them, so a new
policy, or a count of what each rule alone rejects, needs the stored ledger only
and no text, and its rows say which policy was applied.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from codeloom.llm import shared

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations")

#: Rules by name in the order of their bits: when a document fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "20 * n_symbols > word_chars",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "shouting": "20 * n_exclamations > word_chars",
    "long_words": "word_chars > 40 * n_words",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Versioned policies: the rules that reject.
POLICIES: dict[str, int] = {"base": BASE, "v1": sum(BIT.values())}


def _marks(text: pa.Array, characters: str) -> np.ndarray:
    """How many of the given ASCII characters each text has."""
    n = np.zeros(len(text), np.int64)
    for c in characters:
        n += np.asarray(pc.count_substring(text, c)).astype(np.int64)
    return n


def _windows(codes: np.ndarray, offsets: np.ndarray, distinct: int, size: int) -> np.ndarray:
    """For each text, its words that lie in windows of `size` words which it has twice or more.

    A window's number is exact: windows of one word have the word's code, and
    those of a word more get the rank of (number, next word's code) among all
    pairs. Windows never reach over a text's end.
    """
    n = len(codes)
    out = np.zeros(len(offsets) - 1, np.int64)
    if n < size:
        return out
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(text_of[: n - size + 1] == text_of[size - 1 :])
    if not len(starts):
        return out
    number, top = codes[starts], max(distinct, 1)
    for step in range(1, size):
        number = np.unique(number * top + codes[starts + step], return_inverse=True)[1]
    # Only numbers that come again in their own text count.
    key = text_of[starts] * (int(number.max()) + 1) + number
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    same = sorted_key[1:] == sorted_key[:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts[again], 1)
    np.add.at(edge, starts[again] + size, -1)
    return shared.sums((np.cumsum(edge[:-1]) > 0).astype(np.int64), offsets)


def _lines(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word of each text, and those of them that equal an earlier line."""
    split = pc.split_pattern(text, "\n")
    flat, offsets = split.flatten(), np.asarray(split.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    coded = pc.dictionary_encode(flat)
    worded = np.asarray(pc.greater(pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)), 0))
    codes = np.asarray(coded.indices).astype(np.int64)
    full = worded[codes] if len(codes) else np.zeros(0, bool)
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first = np.zeros(len(codes), bool)
    first[np.unique(text_of * max(len(worded), 1) + codes, return_index=True)[1]] = True
    return shared.sums(full.astype(np.int64), offsets), shared.sums((full & ~first).astype(np.int64), offsets)


def measured(text: pa.Array, window: int = 5) -> dict[str, np.ndarray]:
    """MEASURES of each text; a null text is empty."""
    text = pc.fill_null(text, "")
    offsets, codes, distinct = shared.words(text)
    chars = np.asarray(pc.utf8_length(distinct)).astype(np.int64)
    n_lines, n_dup_lines = _lines(text)
    return {
        "n_words": np.diff(offsets),
        "word_chars": shared.sums(chars[codes], offsets),
        "n_symbols": _marks(text, "#*$%&|<>"),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": _windows(codes, offsets, len(distinct), window),
        "n_lines": n_lines,
        "n_exclamations": _marks(text, "!"),
    }


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in shared.slices(batches):
        found = measured(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], ["doc_id", *MEASURES])


def _with_measures(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in shared.slices(batches, text):
        found = measured(batch.column(text))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], [*batch.schema.names, *MEASURES])


def failed_bits() -> Column:
    """The bits of the rules that a document fails, from its measurements."""
    bits = F.lit(0).cast("long")
    for name, rule in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES and failed (the bits of the rules) of every row, repeated rows too.

    A null or empty text has no words and so fails few_words; a null doc_id
    stays null; other columns, whatever their names, are left out; an empty
    table gives an empty table.
    """
    shared.ready_workers(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(_measure, ", ".join([f"doc_id {kind}", *(f"{m} long" for m in MEASURES)]))
    return found.withColumn("failed", failed_bits())


def stored(docs: DataFrame) -> DataFrame:
    """The ledger of docs, written once: policies and ablations read it, and no text again."""
    return shared.written(ledger(docs), "ledger")


def verdicts(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """A ledger with base_failed, kept (no rule of the policy failed) and policy."""
    failed = F.col("failed")
    rows = rows.withColumn("policy", F.lit(policy))
    return rows.withColumn("base_failed", failed.bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", failed.bitwiseAND(F.lit(POLICIES[policy] | BASE)) == 0)


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy, which is named: documents that fail it, that fail it alone, and that the policy without it keeps.

    Rows are counted by their bits first, so no more than two to the number of
    rules go on. An empty ledger gives no rows.
    """
    mask = POLICIES[policy]
    by = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("failed")).count()
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BIT.items() if b & mask))).alias("rule")
    n, failed, bit = F.col("count"), F.col("failed"), F.col("rule.bit")
    return (
        by.select("failed", "count", each)
        .groupBy(F.col("rule.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(failed.bitwiseAND(bit) != 0, n)), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(failed == bit, n)), F.lit(0)).alias("n_failed_alone"),
            F.coalesce(F.sum(F.when(failed.bitwiseAND(F.bitwise_not(bit)) == 0, n)), F.lit(0)).alias("n_kept_without"),
        )
        .withColumn("policy", F.lit(policy))
    )


def good_documents(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of docs that the policy keeps, with all their columns, whatever their names."""
    shared.ready_workers(docs.sparkSession)
    placed = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    schema = StructType([*placed.schema.fields, *(StructField(m, LongType()) for m in MEASURES)])
    found = placed.mapInArrow(partial(_with_measures, text=f"c{docs.columns.index('text')}"), schema)
    return found.filter(failed_bits().bitwiseAND(F.lit(POLICIES[policy] | BASE)) == 0).drop(*MEASURES).toDF(*docs.columns)
