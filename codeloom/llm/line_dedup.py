"""Lines that several documents hold, found in a sharded minimal perfect hash.

Every distinct line of the corpus has a slot of its own: keys are dealt to
shards by their hash, and a shard's function gives each of its keys another
number below their count. The function is a cascade of bit vectors: a key's bit
stands in the first level in which no other key shares its place, and the number
of bits before it is its slot. Beside it lie arrays by slot: a fingerprint, the
number of documents (one byte, up to 255), and for slots of several documents
the one that keeps the line. A shard takes some three bits for the function, five
bytes for each line and eight for each repeated one, and holds about SHARD_KEYS
lines, so shards grow in number, not in size.

Documents probe the arrays: their lines' hashes go to the shards in blocks, a
task reads a shard's row and then streams the blocks behind it, and only those
lines that a document loses are given back. No line meets another line. A line
that a third of all documents share is one slot that all their blocks ask: the
row of a shard that is asked more than BUSY times for each of SHARD_KEYS keys is
given to several tasks, and blocks are dealt to these by document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from codeloom.llm import shared

#: Distinct lines that a shard holds about.
SHARD_KEYS = 1 << 20
#: Times that a task looks up SHARD_KEYS keys, about.
BUSY = 8
#: Places in a level for each key that comes to it.
SPARSE = 2
INDEX = "levels binary, bits binary, prints binary, counts binary, keepers binary"
BLOCK = "first array<bigint>, second array<bigint>, doc array<bigint>"


class PerfectHash:
    """Slots 0 to n - 1 for n keys of two 64-bit hashes; another key gets any slot, or -1."""

    def __init__(self, levels: np.ndarray, bits: np.ndarray) -> None:
        self.ends, self.words = np.cumsum(levels), bits
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits))])

    @staticmethod
    def _place(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (shared.mixed(first ^ shared.mixed(second + np.uint64(level + 1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, first: np.ndarray, second: np.ndarray) -> PerfectHash:
        """The function of distinct keys."""
        levels, parts = [], []
        while len(first):
            size = -(-SPARSE * len(first) // 64) * 64
            place = cls._place(first, second, len(levels), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(size)
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = ~alone[place]
            first, second = first[left], second[left]
        return cls(np.array(levels, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        found, left = np.full(len(first), -1, np.int64), np.arange(len(first))
        start = 0
        for level, end in enumerate(self.ends.tolist()):
            if not len(left):
                break
            at = start + self._place(first[left], second[left], level, end - start)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            here = ((word >> bit) & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            found[left[here]] = (self.before[at >> 6] + below)[here]
            left, start = left[~here], end
        return found


class Shard:
    """A perfect hash with its arrays."""

    def __init__(self, levels: bytes, bits: bytes, prints: bytes, counts: bytes, keepers: bytes) -> None:
        self.hash = PerfectHash(np.frombuffer(levels, np.int64), np.frombuffer(bits, np.uint64))
        self.prints, self.counts, self.keepers = np.frombuffer(prints, np.uint32), np.frombuffer(counts, np.uint8), np.frombuffer(keepers, np.int64)
        self.several = np.cumsum(self.counts > 1) - 1

    @staticmethod
    def row(first: np.ndarray, second: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> list[bytes]:
        """INDEX of distinct keys."""
        made = PerfectHash.of(first, second)
        at = np.argsort(made.slots(first, second))
        counts, keepers = counts[at].astype(np.uint8), keepers[at].astype(np.int64)
        arrays = np.diff(made.ends, prepend=0), made.words, _print(second[at]), counts, keepers[counts > 1]
        return [x.tobytes() for x in arrays]

    def repeated(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys several documents hold, and for these the one that keeps them."""
        slot = self.hash.slots(first, second)
        own = slot >= 0
        own[own] = (self.prints[slot[own]] == _print(second[own])) & (self.counts[slot[own]] > 1)
        return own, self.keepers[self.several[slot[own]]]


def _print(second: np.ndarray) -> np.ndarray:
    return (second >> np.uint64(32)).astype(np.uint32)


def line_keys(text: pa.Array, at_least: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of each text's lines, the lines, a number of each line's key (-1 if it is too short), and two hashes of each key by number."""
    split = pc.split_pattern(pc.fill_null(text, ""), "\n")
    lines, offsets = split.flatten(), np.asarray(split.offsets).astype(np.int64)
    coded = pc.dictionary_encode(pc.ascii_lower(pc.ascii_trim_whitespace(lines)))
    keys, codes = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
    long = np.asarray(pc.greater_equal(pc.utf8_length(keys), at_least)) if len(keys) else np.zeros(0, bool)
    number = np.where(long, np.cumsum(long) - 1, -1)[codes] if len(keys) else codes
    digests = b"".join(xxhash.xxh3_128_digest(x) for x in keys.cast(pa.binary()).filter(pa.array(long)).to_pylist())
    hashes = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    return offsets - offsets[0], lines, number, hashes[:, 0], hashes[:, 1]


def _numbers(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _hash_lines(batches: Iterable[pa.RecordBatch], at_least: int) -> Iterator[pa.RecordBatch]:
    """A row for each distinct key of each text."""
    for batch in shared.slices(batches):
        offsets, _, number, first, second = line_keys(batch.column("text"), at_least)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        once = np.unique((row * max(len(first), 1) + number)[number >= 0])
        row, key = np.divmod(once, max(len(first), 1))
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("doc").take(at), _numbers(first[key]), _numbers(second[key])], ["doc_id", "doc", "first", "second"])


def _groups(shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each shard with the start and end of its rows, in sorted rows."""
    starts = np.flatnonzero(np.diff(shards, prepend=-1))
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(shards)).tolist(), strict=True):
        yield int(shards[a]), a, b


def _index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of INDEX for each shard, from keys in order of shards."""
    names = ["shard", *(c.split()[0] for c in INDEX.split(", "))]
    held: list[list[np.ndarray]] = []
    shard = -1

    def made() -> pa.RecordBatch:
        first, second, counts, keepers = (np.concatenate(x) for x in zip(*held, strict=True))
        row = Shard.row(first.view(np.uint64), second.view(np.uint64), counts, keepers)
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], names)

    for batch in batches:
        columns = [np.asarray(batch.column(c)) for c in ("first", "second", "n", "keeper")]
        for of, a, b in _groups(np.asarray(batch.column("shard"))):
            if of != shard and held:
                yield made()
                held = []
            shard = of
            held.append([x[a:b].copy() for x in columns])
    if held:
        yield made()
    shared.give_back()


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """BLOCK for each shard, and task that has it, which a batch of lines asks."""
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, copy = (np.asarray(batch.column(c)).astype(np.int64) for c in ("shard", "copy"))
        order = np.lexsort((copy, shard))
        rows, shard, copy = batch.take(pa.array(order)), shard[order], copy[order]
        starts = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (copy[1:] != copy[:-1])]))
        offsets = pa.array(np.append(starts, len(shard)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, rows.column(c)) for c in ("first", "second", "doc")]
        yield pa.RecordBatch.from_arrays([pa.array(shard[starts]), pa.array(copy[starts]), *lists], ["shard", "copy", "first", "second", "doc"])


def _probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc and first of the lines that documents lose, from shards' rows with the blocks that ask each behind it."""
    own: Shard | None = None
    for batch in batches:
        for k in range(batch.num_rows):
            if batch.column("bits")[k].is_valid:
                own = Shard(*(batch.column(c.split()[0])[k].as_py() for c in INDEX.split(", ")))
                continue
            first, second, doc = (batch.column(c)[k].values for c in ("first", "second", "doc"))
            x, y = (np.asarray(c).view(np.uint64) for c in (first, second))
            several, keeper = own.repeated(x, y)
            asked = doc.filter(pa.array(several))
            lost = np.asarray(pc.fill_null(pc.not_equal(asked, pa.array(keeper)), True))
            at = pa.array(lost)
            yield pa.RecordBatch.from_arrays([asked.filter(at), _numbers(x[several][lost])], ["doc", "first"])
    shared.give_back()


def _strip(batches: Iterable[pa.RecordBatch], at_least: int) -> Iterator[pa.RecordBatch]:
    """Each document's lines counted, those it loses too, and what is left of its text."""
    for batch in shared.slices(batches):
        text, lost = pc.fill_null(batch.column("text"), ""), batch.column("lost")
        offsets, lines, number, first, _ = line_keys(text, at_least)
        n_dropped, kept = np.zeros(batch.num_rows, np.int64), text
        if lost.null_count < batch.num_rows:
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            # A line goes if its document's list has its key: both are numbered, and pairs are looked up among sorted ones.
            values, at = np.asarray(lost.flatten()).view(np.uint64), np.asarray(pc.list_parent_indices(lost)).astype(np.int64)
            distinct, order = np.unique(first, return_index=True)
            place = np.searchsorted(distinct, values)
            known = place < len(distinct)
            known[known] = distinct[place[known]] == values[known]
            same = np.searchsorted(distinct, first)
            width = max(len(distinct), 1)
            gone = np.isin(np.where(number >= 0, row * width + same[number], -1), at[known] * width + place[known]) if len(first) else np.zeros(len(row), bool)
            n_dropped = shared.sums(gone.astype(np.int64), offsets)
            if gone.any():
                left = lines.filter(pa.array(~gone))
                ends = np.concatenate([[0], np.cumsum(~gone)])[offsets]
                kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), left), "\n")
        names = ["doc_id", "n_lines", "n_dropped", "text"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n_dropped), kept], names)


def _number(docs: DataFrame) -> Column:
    """A document's id as a number: itself, or a hash of an id of another type; null stays null."""
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return F.col("doc_id").cast("long")
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))


def lost_lines(docs: DataFrame, at_least: int = 10, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc and first: the number of a document, and a hash of a line's key that it loses."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = docs.select("doc_id", _number(docs).alias("doc"), "text").mapInArrow(partial(_hash_lines, at_least=at_least), f"doc_id {kind}, doc bigint, first bigint, second bigint")
    lines = shared.written(hashed, "lines")
    by = lines.groupBy("first", "second").agg(F.count("*").alias("held"), F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("unknown"))
    several = F.coalesce(F.col("doc_id") != F.col("last"), F.lit(False)) | (F.col("unknown") & F.col("doc_id").isNotNull())
    number = F.coalesce(_number(docs), F.lit(0))
    keys = shared.written(by.select("first", "second", F.when(several, F.least("held", F.lit(255))).otherwise(1).cast("int").alias("n"), number.alias("keeper"), "held"), "keys")
    shards = max(1, -(-keys.count() // shard_keys))
    shard = F.pmod(F.shiftrightunsigned("first", 1), F.lit(shards)).alias("shard")
    dealt = keys.select("*", shard).repartition("shard").sortWithinPartitions("shard")
    index = shared.written(dealt.select("shard", "first", "second", "n", "keeper").mapInArrow(_index, f"shard bigint, {INDEX}"), "index")
    # Shards that are asked more often than others, by lines that many documents hold: few, as what they are asked adds up to all lines.
    tasks = F.ceil(F.sum("held") / F.lit(BUSY * shard_keys)).cast("long")
    busy = shared.written(keys.groupBy(shard).agg(tasks.alias("tasks")).filter("tasks > 1"), "busy")
    own = F.coalesce("tasks", F.lit(1).cast("long"))
    asked = lines.select(shard, "first", "second", "doc").join(busy, "shard", "left").withColumn("copy", F.pmod(F.xxhash64("doc"), own))
    blocks = asked.select("shard", "copy", "first", "second", "doc").mapInArrow(_blocks, f"shard bigint, copy bigint, {BLOCK}")
    copies = index.join(busy, "shard", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), own - 1))).drop("tasks")
    both = copies.withColumn("asks", F.lit(0)).unionByName(blocks.withColumn("asks", F.lit(1)), allowMissingColumns=True)
    found = both.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "asks").mapInArrow(_probe, "doc bigint, first bigint")
    return shared.written(found, "lost")


def without_repeats(docs: DataFrame, at_least: int = 10, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, n_lines, n_dropped and text: what is left of every row of docs, and how many lines it had and lost.

    A line's key is the line in lower-case A-Z without white space at its ends.
    Keys of at_least code points that several documents hold lose all their
    lines but those of the smallest doc_id. A null or empty text is one empty
    line. Rows of one doc_id are one document, and all rows with a null doc_id
    are one that comes last. Other columns, whatever their names, are left out;
    an empty table gives an empty table.
    """
    shared.ready_workers(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    lost = lost_lines(docs, at_least, shard_keys).groupBy("doc").agg(F.collect_set("first").alias("lost"))
    plain = docs.select("doc_id", "text", _number(docs).alias("number"))
    met = plain.join(lost, plain["number"].eqNullSafe(lost["doc"]), "left").select("doc_id", "text", "lost")
    return met.mapInArrow(partial(_strip, at_least=at_least), f"doc_id {kind}, n_lines bigint, n_dropped bigint, text string")
