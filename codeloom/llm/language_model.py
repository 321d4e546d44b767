"""Scores of a trigram model whose counts lie in a log-frequency Bloom filter.

The filter holds quantised counts of all word pairs, of the triples that were
seen twice or more, and of the words whose exact counts are not broadcast: what
is counted c times is entered at levels 1 to 1 + floor(log_b c). To read a
count, its levels are probed upwards until one is missing. Entries are dealt to
segments by their hash; a segment's bits are sized by what it holds, so the rate
of false positives does not grow with the corpus.

The probability of a word after another interpolates by absolute discounting:
what the discount takes from the pairs goes to the word's own smoothed
probability. Discounts and shares are estimated from all pairs, by the
magnitude of the first word's count. After two words that were seen together c
times, twice or more, the triple's count n gives (n + PRIOR * p) / (c + PRIOR)
with p that of the last word alone; triples seen once count as unseen.

The filter is broadcast while it stays below BROADCAST_BYTES. Beyond it, no one
holds it: slices of the texts send each segment their distinct keys with how
often they learn from them, 0 too. A segment is built from these, tells the level
of each key right away, a byte in the place of its key, and is dropped. The
levels meet the texts of their slice, so keys and each text are moved once.
Exact word counts are broadcast for at most HEAD words of at most HEAD_BYTES
bytes, the most frequent ones; base_score joins the counts of the others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import shared

#: Words whose exact counts are broadcast, and the bytes of the longest.
HEAD, HEAD_BYTES = 1 << 19, 64
#: Bytes of filter that are broadcast, and about how many a training token takes (up to 2.7, if most pairs occur twice).
BROADCAST_BYTES, TOKEN_BYTES = 128 << 20, 1.0
#: Bytes of text, with END_BYTES for each end, that ask the segments together.
ASKED_BYTES, END_BYTES = 8 << 20, 8
#: Tokens, at most, that are counted for one segment; tokens that a task gathers before it gives their counts out.
SEGMENT, GATHERED = 1_000_000, 1_500_000
#: Tasks, at most, that segments are dealt to; a task takes one segment after another.
MOST_TASKS = 20_000
#: Probes of an entry, with as many bits / ln 2 for each entry: 1 in 64 questions for a missing entry errs.
PROBES = 6
#: Counts are told apart by factors of this.
BASE = 2**0.5
#: Weight, in occurrences, of what the last word alone predicts.
PRIOR = 2.0
#: Low bits of a key: for a pair the magnitude of its first word's count (0 for a word that isn't in the head), else these.
TAG_BITS, TRIPLE, SINGLE = 6, 62, 63
#: Bits of a key that tell entries of a segment apart; with a count beside it a key takes a number of 64 bits.
KEY_BITS = 48
#: The token at each text's end, and the history at its begin; no word is empty.
END = ""


def held_out(doc_id: Column) -> Column:
    """Documents that the model does not learn from; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def level_of(n: np.ndarray) -> np.ndarray:
    """The highest level of counts n of 1 or more."""
    return 1 + np.floor(np.log(n) / np.log(BASE) + 1e-9).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the mean of its whole numbers; level 0 is no count."""
    table = [0.0]
    for k in range(1, 130):
        low, high = int(np.ceil(BASE ** (k - 1) - 1e-9)), int(np.ceil(BASE**k - 1e-9)) - 1
        table.append((low + high) / 2 if high >= low else BASE ** (k - 0.5))
    return np.asarray(table)[level]


#: Bytes that are hashed at a time, and a number for each byte and place; made by rule.
_BLOCK = 1 << 20
_BYTE = shared.mixed(np.arange(1, 257, dtype=np.uint64))
_POWER = np.multiply.accumulate(np.where(np.arange(_BLOCK + 1) == 0, np.uint64(1), np.uint64(0x9E3779B97F4A7C15)))


def _hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of words: polynomials in their bytes' numbers, from sums over all bytes of a block, then mixed.

    A word's sum holds a power of its place; a second power makes the places
    equal. Words too long for a block are hashed alone.
    """
    distinct = distinct.cast(pa.large_binary())
    bounds = np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1, distinct.offset * 8)
    data = np.frombuffer(distinct.buffers()[2], np.uint8) if distinct.buffers()[2] is not None else np.zeros(0, np.uint8)
    out = np.zeros(len(distinct), np.uint64)
    begin = 0
    while begin < len(distinct):
        end = int(np.searchsorted(bounds, bounds[begin] + _BLOCK, side="right")) - 1
        if end <= begin:
            word = data[bounds[begin] : bounds[begin + 1]]
            out[begin] = xxhash.xxh3_64_intdigest(word.tobytes())
            begin += 1
            continue
        first, at = bounds[begin], bounds[begin : end + 1] - bounds[begin]
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data[first : bounds[end]]] * _POWER[: at[-1]], dtype=np.uint64)])
            out[begin:end] = (sums[at[1:]] - sums[at[:-1]]) * _POWER[_BLOCK - at[:-1]]
        begin = end
    return shared.mixed(out)


@dataclass
class Tokens:
    """The tokens of some texts: words and, behind each text, END."""

    offsets: np.ndarray
    codes: np.ndarray
    distinct: pa.Array

    @staticmethod
    def of(text: pa.Array) -> Tokens:
        offsets, codes, distinct = shared.words(pc.ascii_lower(pc.fill_null(text, "")))
        n = len(offsets) - 1
        codes = np.insert(codes, offsets[1:], len(distinct))
        return Tokens(offsets + np.arange(n + 1), codes, pa.concat_arrays([distinct.cast(pa.string()), pa.array([END])]))

    def before(self) -> np.ndarray:
        """The code of the token before each; END before the first."""
        out = np.empty_like(self.codes)
        out[1:] = self.codes[:-1]
        out[self.offsets[:-1]] = len(self.distinct) - 1
        return out

    def first(self) -> np.ndarray:
        """Whether a token is its text's first."""
        out = np.zeros(len(self.codes), bool)
        out[self.offsets[:-1]] = True
        return out


class Head:
    """Exact counts of the frequent words."""

    def __init__(self, words: pa.Array, counts: np.ndarray) -> None:
        self.words, self.counts = words, counts

    def counts_of(self, distinct: pa.Array) -> np.ndarray:
        """The count of each word; -1 for those that aren't here."""
        at = pc.index_in(distinct, value_set=self.words)
        found = np.asarray(pc.fill_null(at, -1)).astype(np.int64)
        return np.where(found >= 0, self.counts[found] if len(self.counts) else -1, -1)

    @staticmethod
    def magnitudes(n: np.ndarray) -> np.ndarray:
        """0 for the counts of words that aren't here, else 1 + floor(log2 of the count)."""
        return np.where(n > 0, 1 + np.floor(np.log2(np.maximum(n, 1))), 0).astype(np.uint64)


def pair_keys(tokens: Tokens, hashes: np.ndarray, magnitudes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each token with the one before it, and with the two before it (a text's first token has no such triple)."""
    with np.errstate(over="ignore"):
        before = tokens.before()
        own = hashes[tokens.codes]
        pair = shared.mixed(hashes[before] * np.uint64(0x9E3779B97F4A7C15) + own)
        earlier = np.empty_like(pair)
        earlier[1:] = pair[:-1]
        triple = shared.mixed(earlier * np.uint64(0xD6E8FEB86659FD93) + own)[~tokens.first()]
    return (pair << np.uint64(TAG_BITS)) | magnitudes[before], (triple << np.uint64(TAG_BITS)) | np.uint64(TRIPLE)


def word_keys(hashes: np.ndarray) -> np.ndarray:
    return (shared.mixed(hashes) << np.uint64(TAG_BITS)) | np.uint64(SINGLE)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """Segments are ranges of keys of equal width."""
    return ((keys >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def _probes(keys: np.ndarray, level: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of keys at a level begin, and by what they go on; a segment knows a key's low KEY_BITS only."""
    with np.errstate(over="ignore"):
        begin = shared.mixed((keys & np.uint64((1 << KEY_BITS) - 1)) + np.asarray(level).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return begin, shared.mixed(begin) | np.uint64(1)


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in shared.slices(batches):
        tokens = Tokens.of(batch.column("text"))
        yield pa.RecordBatch.from_arrays([tokens.distinct, pa.array(np.bincount(tokens.codes, minlength=len(tokens.distinct)).astype(np.int64))], ["word", "n"])


def _dealt(keys: np.ndarray, segments: int) -> Iterator[tuple[int, slice]]:
    """Each segment that some of the sorted keys belong to, and which ones."""
    segment = segment_of(keys, segments)
    starts = np.flatnonzero(np.concatenate([[len(keys) > 0], segment[1:] != segment[:-1]]))
    for start, stop in zip(starts.tolist(), np.append(starts[1:], len(keys)).tolist(), strict=True):
        yield int(segment[start]), slice(start, stop)


def _packed(keys: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """The low KEY_BITS of keys counted once, six bytes each; the others with their counts, which take 16 bits of 64."""
    low = keys << np.uint64(64 - KEY_BITS)
    once = n == 1
    low_once = np.ascontiguousarray((low[once] >> np.uint64(64 - KEY_BITS)).view(np.uint8).reshape(-1, 8)[:, :6])
    times, left = low[~once], n[~once]
    most = (1 << 16) - 1
    repeats = -(-left // most)  # a larger count is several entries
    each = np.repeat(times, repeats)
    counts = np.full(len(each), most, np.uint64)
    counts[np.cumsum(repeats) - 1] = left - (repeats - 1) * most
    return low_once.tobytes(), (each | counts).tobytes()


def _unpacked(once: list[bytes], more: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct low keys in order, and their counts."""
    whole = np.frombuffer(b"".join(once), np.uint8).reshape(-1, 6)
    low = np.zeros((len(whole), 8), np.uint8)
    low[:, 2:] = whole
    low[:, 0] = 1
    packed = np.concatenate([low.view(np.uint64).ravel(), np.frombuffer(b"".join(more), np.uint64)])
    packed.sort()
    keys = packed >> np.uint64(64 - KEY_BITS)
    starts = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]]))
    counts = np.add.reduceat(packed & np.uint64(0xFFFF), starts) if len(starts) else np.zeros(0, np.uint64)
    return keys[starts], counts.astype(np.int64)


_COUNTED = "segment int, once binary, more binary"


def _count_pairs(batches: Iterable[pa.RecordBatch], head, segments: int) -> Iterator[pa.RecordBatch]:
    """Counts of pairs and triples, a row for each segment and some millions of tokens."""
    held: list[np.ndarray] = []

    def out() -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        yield from _given_out(keys, n, segments)

    gathered = 0
    for batch in shared.slices(batches, size=shared.SLICE_BYTES // 2):
        tokens = Tokens.of(batch.column("text"))
        held += pair_keys(tokens, _hashes(tokens.distinct), Head.magnitudes(head.value.counts_of(tokens.distinct)))
        gathered += len(tokens.codes)
        if gathered >= GATHERED:
            yield from out()
            gathered = 0
    if held:
        yield from out()


def _given_out(keys: np.ndarray, n: np.ndarray, segments: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, bytes, bytes]] = []
    size = 0
    for segment, part in _dealt(keys, segments):
        rows.append((segment, *_packed(keys[part], n[part])))
        size += part.stop - part.start
        if size > 1 << 17 or len(rows) >= 1 << 13:  # small batches, as both sides of the worker's stream hold one
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], ["segment", "once", "more"])
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], ["segment", "once", "more"])


def _rest_words(batches: Iterable[pa.RecordBatch], segments: int) -> Iterator[pa.RecordBatch]:
    """Counts of the words that the head has not, as entries of their own kind."""
    for batch in batches:
        if batch.num_rows:
            keys, n = word_keys(_hashes(batch.column("word").cast(pa.string()))), np.asarray(batch.column("n"))
            order = np.argsort(keys)
            yield from _given_out(keys[order], n[order], segments)


_TAGS = "tag array<int>, types array<long>, once array<long>, twice array<long>, tokens array<long>"
_STATS = f"segment int, n_bits long, bits binary, {_TAGS}"


def _entered(found: np.ndarray, counts: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """A segment's bits, a byte for each; the levels up to which its keys are entered; for each tag of pairs, counts of counts."""
    tags = (found & np.uint64((1 << TAG_BITS) - 1)).astype(np.int64)
    pairs = tags < TRIPLE
    stats = [np.bincount(tags[pairs], weights=w[pairs], minlength=64).astype(np.int64) for w in (np.ones(len(tags)), counts == 1, counts == 2, counts)]
    # A triple is entered by how often it came again.
    entered = np.where(tags == TRIPLE, counts - 1, counts)
    levels = np.where(entered > 0, level_of(np.maximum(entered, 1)), 0)
    n_bits = np.uint64(max(64, int(levels.sum() * probes / np.log(2))))
    flags = np.zeros(int(n_bits), bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        place, step = _probes(found[levels >= level], level)
        for _ in range(probes):
            flags[place % n_bits] = True
            place += step
    some = np.flatnonzero(stats[0])
    return flags, levels, [pa.array([some.astype(np.int32)])] + [pa.array([s[some]]) for s in stats]


def _groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from rows in order of key."""
    from codeloom.llm.near_dedup import _whole_groups

    for table in _whole_groups(batches, key):
        table = table.combine_chunks()
        of = np.asarray(table[key])
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist()
        for start, stop in zip(starts, [*starts[1:], len(of)], strict=True):
            yield table.slice(start, stop - start)


def _build(batches: Iterable[pa.RecordBatch], probes: int) -> Iterator[pa.RecordBatch]:
    """A row for each segment, from rows in order of segment: its bits and, for each tag of pairs, counts of counts."""
    for part in _groups(batches, "segment"):
        flags, _, lists = _entered(*_unpacked(part["once"].to_pylist(), part["more"].to_pylist()), probes)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part["segment"][0].as_py()], pa.int32()), pa.array([len(flags)]), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary()), *lists],
            ["segment", "n_bits", "bits", "tag", "types", "once", "twice", "tokens"],
        )


class Filter:
    """All segments, ready to be probed."""

    def __init__(self, segments: int, rows: pa.Table, probes: int) -> None:
        """rows: segment, n_bits and bits."""
        rows = rows.sort_by("segment").combine_chunks()
        self.segments, self.probes = segments, probes
        self.n_bits, self.begin = np.zeros(segments, np.uint64), np.zeros(segments, np.int64)
        at, sizes = np.asarray(rows["segment"]), np.asarray(pc.binary_length(rows["bits"])).astype(np.int64)
        self.n_bits[at] = np.asarray(rows["n_bits"]).astype(np.uint64)
        self.begin[at] = np.cumsum(sizes) - sizes
        bits = pa.chunked_array(rows["bits"].chunks).combine_chunks().cast(pa.large_binary()) if len(at) else None
        self.bits = np.frombuffer(bits.buffers()[2], np.uint8, int(sizes.sum())) if bits is not None else np.zeros(1, np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key; 0 where it was never entered."""
        out = np.zeros(len(keys), np.int64)
        segment = segment_of(keys, self.segments)
        left, level = np.flatnonzero(self.n_bits[segment]), 0
        while len(left):
            level += 1
            bits, begin = self.n_bits[segment[left]], self.begin[segment[left]]
            at, step = _probes(keys[left], level)
            for _ in range(self.probes):
                place = at % bits
                hit = (self.bits[begin + (place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                left, bits, begin, step = left[hit], bits[hit], begin[hit], step[hit]
                at = at[hit] + step
            out[left] = level
        return out


@dataclass
class Model:
    """What scoring needs besides counts: sizes, and a discount and a share for each magnitude of a history."""

    tokens: int
    words: int
    complete: bool  # whether the head has every training word
    discount: np.ndarray
    share: np.ndarray

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.tokens + 0.5 * (self.words + 1)))


_SCORED = "score double, n_tokens long, n_known long, base_score double, rest array<string>"
_NAMES = ["row", "doc_id", "score", "n_tokens", "n_known", "base_score", "rest"]


@dataclass
class Read:
    """The tokens of some texts, their words' counts in the head, and the keys of all else that their scores need."""

    tokens: Tokens
    exact: np.ndarray
    pairs: np.ndarray
    triples: np.ndarray
    words: np.ndarray  # of those that the head has not; none if it has all

    @staticmethod
    def of(text: pa.Array, head: Head, complete: bool) -> Read:
        tokens = Tokens.of(text)
        exact, hashes = head.counts_of(tokens.distinct), _hashes(tokens.distinct)
        return Read(tokens, exact, *pair_keys(tokens, hashes, Head.magnitudes(exact)), word_keys(hashes[exact < 0]) if not complete else np.zeros(0, np.uint64))

    @staticmethod
    def each(text: pa.Array, head: Head, complete: bool) -> list[Read]:
        """The same of many texts, some after the other."""
        return [Read.of(b.column("text"), head, complete) for b in shared.slices([pa.RecordBatch.from_arrays([text], ["text"])], size=shared.SLICE_BYTES // 2)]


def _scored(read: Read, model: Model, words: np.ndarray, pairs: np.ndarray, triples: Callable[[np.ndarray], np.ndarray]) -> list[pa.Array]:
    """The columns of _SCORED for each text, from the counts of words and pairs; triples gives those at some places."""
    tokens, known = read.tokens, read.exact >= 0
    one = read.exact.astype(float)
    one[~known] = 0 if model.complete else words
    history, word = tokens.before(), tokens.codes
    tag, size, two = Head.magnitudes(read.exact)[history].astype(np.int64), one[history], pairs
    lower = 10.0 ** model.base(one)[word]
    p = np.maximum(two - model.discount[tag], 0) / np.maximum(np.maximum(size, two), 1) + np.where(size > 0, model.share[tag], 1.0) * lower
    p = np.minimum(p, 1.0)
    # The pair that ends at the token before is the triple's history.
    inner = np.flatnonzero(~tokens.first())
    times = two[inner - 1]
    often = np.flatnonzero(times >= 2)
    again = triples(often)
    three = np.minimum(np.where(again > 0, again + 1, 0), times[often])
    at = inner[often]
    p[at] = (three + PRIOR * p[at]) / (times[often] + PRIOR)

    later = (~known & (not model.complete))[word]
    ends = np.concatenate([[0], np.cumsum(later)])[tokens.offsets]
    return [
        pa.array(shared.sums(np.log10(p), tokens.offsets)),
        pa.array(np.diff(tokens.offsets)),
        pa.array(shared.sums((read.exact > 0)[word].astype(np.int64), tokens.offsets)),
        pa.array(shared.sums(np.where(later, 0.0, model.base(np.where(known, read.exact, 0))[word]), tokens.offsets)),
        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens.distinct.take(pa.array(word[later]))),
    ]


def _score(batches: Iterable[pa.RecordBatch], model: Model, head, counts) -> Iterator[pa.RecordBatch]:
    def counted(keys: np.ndarray) -> np.ndarray:
        distinct, at = np.unique(keys, return_inverse=True)
        return count_of(counts.value.levels(distinct))[at]

    for batch in shared.slices(batches, size=shared.SLICE_BYTES // 2):
        read = Read.of(batch.column("text"), head.value, model.complete)
        scored = _scored(read, model, counted(read.words), counted(read.pairs), lambda some, triples=read.triples: counted(triples[some]))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *scored], _NAMES)


# Where the filter is larger than what may be broadcast


def _cut(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows with the number of their slice, which is that of its first row."""
    first, left = -1, 0
    for batch in batches:
        rows, n = np.asarray(batch.column("row")), batch.num_rows
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64) + END_BYTES)
        of, begin = np.empty(n, np.int64), 0
        while begin < n:
            if left <= 0:
                first, left = rows[begin], size
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + left, side="right")))
            of[begin:end] = first
            left = left - (ends[end - 1] - done) if end == n else 0
            begin = end
        yield pa.RecordBatch.from_arrays([pa.array(of), *batch.columns], ["slice", *batch.schema.names])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order; the order of all; where in it each distinct one begins."""
    order = np.argsort(keys)
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([[len(keys) > 0], ordered[1:] != ordered[:-1]]))
    return ordered[starts], order, starts


def _spread(values: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The values of distinct keys for all keys, in their own order."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, np.diff(np.append(starts, len(order))))
    return out


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of data between each two bounds."""
    own = np.ascontiguousarray(data[bounds[0] : bounds[-1]]).view(np.uint8)
    width = data.dtype.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(((bounds - bounds[0]) * width).astype(np.int32)), pa.py_buffer(own)])


def _placed(each: list[Read], segments: int) -> np.ndarray:
    """All keys, as numbers whose order is that of segments and then, in up to 2**16 of them, of what a segment knows of a key."""
    keys = np.concatenate([k for read in each for k in (read.pairs, read.triples, read.words)])
    if segments > 1 << (64 - KEY_BITS):
        return keys
    return segment_of(keys, segments).astype(np.uint64) << np.uint64(KEY_BITS) | keys & np.uint64((1 << KEY_BITS) - 1)


def _segment_of_placed(placed: np.ndarray, segments: int) -> np.ndarray:
    return segment_of(placed, segments) if segments > 1 << (64 - KEY_BITS) else (placed >> np.uint64(KEY_BITS)).astype(np.int64)


def _few(bounds: np.ndarray) -> Iterator[slice]:
    """Ranges of rows that have some 2**17 keys; a row's keys are between two bounds."""
    begin = 0
    while begin < len(bounds) - 1:
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + (1 << 17), side="right")) - 1)
        yield slice(begin, end)
        begin = end


_ASKED = "segment int, slice long, part long, keys binary, high binary, n binary, more binary"
_TOLD = f"segment int, slice long, part long, levels binary, {_TAGS}"


def _learnt(each: list[Read], held: np.ndarray) -> Iterator[np.ndarray]:
    """How often each key of each is learnt from, where some of the texts are held out."""
    begin = 0
    for read in each:
        tokens = read.tokens
        end = begin + len(tokens.offsets) - 1
        learnt = np.repeat(~held[begin:end], np.diff(tokens.offsets))
        yield learnt
        yield learnt[~tokens.first()]
        if len(read.words):
            yield np.bincount(tokens.codes[learnt], minlength=len(tokens.distinct))[read.exact < 0]
        begin = end


def _ask(batches: Iterable[pa.RecordBatch], head, complete: bool, segments: int) -> Iterator[pa.RecordBatch]:
    """The keys of each slice, a row for each segment: five bytes of each, a sixth as the difference from the key before, a byte of its count.

    Keys are in order, so that the sixth are mostly 0 or 1, which Spark's codec
    packs. Counts of 255 and more stand apart. A slice of which several tasks read a part asks in as many parts, by
    their first rows.
    """
    for part in _groups(batches, "slice"):
        each = Read.each(part["text"].combine_chunks(), head.value, complete)
        keys, order, starts = _distinct(_placed(each, segments))
        n = np.add.reduceat(np.concatenate([*_learnt(each, np.asarray(part["held"]))]).astype(np.int64)[order], starts)
        del each, order
        segment = _segment_of_placed(keys, segments)
        bounds = np.append(np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])), len(keys))
        large = n >= 255
        ends, counts = np.concatenate([[0], np.cumsum(large)])[bounds], n[large]
        low, small = keys.view(np.uint8).reshape(-1, 8), np.minimum(n, 255).astype(np.uint8)
        high = np.diff(low[:, 5], prepend=np.uint8(0))
        high[bounds[:-1]] = low[bounds[:-1], 5]
        low = np.ascontiguousarray(low[:, :5])
        for some in _few(bounds):
            own, apart = bounds[some.start : some.stop + 1], ends[some.start : some.stop + 1]
            same = [pa.array(np.full(len(own) - 1, part[c][0].as_py(), np.int64)) for c in ("slice", "row")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(segment[own[:-1]].astype(np.int32)), *same, _binary(low, own), _binary(high, own), _binary(small, own), _binary(counts, apart)],
                ["segment", "slice", "part", "keys", "high", "n", "more"],
            )


def _tell(batches: Iterable[pa.RecordBatch], probes: int) -> Iterator[pa.RecordBatch]:
    """The levels of what slices ask, from rows in order of segment, and for each segment a row with its counts of counts."""
    for part in _groups(batches, "segment"):
        keys, high, small, more = (np.frombuffer(b"".join(part[c].to_pylist()), t) for c, t in (("keys", np.uint8), ("high", np.uint8), ("n", np.uint8), ("more", np.int64)))
        n = small.astype(np.int64)
        n[small == 255] = more
        bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(part["n"])).astype(np.int64))])
        low, total = np.zeros((len(n), 8), np.uint8), np.cumsum(high, dtype=np.uint8)
        low[:, :5] = keys.reshape(-1, 5)
        low[:, 5] = total - np.repeat(np.append(np.uint8(0), total)[bounds[:-1]], np.diff(bounds))
        found, order, starts = _distinct(low.view(np.uint64).ravel())
        counts = np.add.reduceat(n[order], starts)
        learnt = np.flatnonzero(counts)
        flags, entered, lists = _entered(found[learnt], counts[learnt], probes)
        # All levels up to the one a key is entered at are there; those above it may be by chance.
        levels, left, n_bits = np.zeros(len(found), np.int64), np.arange(len(found)), np.uint64(len(flags))
        levels[learnt] = entered
        while len(left):
            place, step = _probes(found[left], levels[left] + 1)
            for _ in range(probes):
                hit = flags[place % n_bits]
                left, step = left[hit], step[hit]
                place = place[hit] + step
            levels[left] += 1
        told = _spread(levels.astype(np.uint8), order, starts)
        whole = [part[c].combine_chunks() for c in ("segment", "slice", "part")]
        null = lambda kind, rows=1: pa.nulls(rows, kind)
        names = ["segment", "slice", "part", "levels", "tag", "types", "once", "twice", "tokens"]
        yield pa.RecordBatch.from_arrays([whole[0].slice(0, 1), null(pa.int64()), null(pa.int64()), null(pa.binary()), *lists], names)
        for some in _few(bounds):
            rows = some.stop - some.start
            yield pa.RecordBatch.from_arrays(
                [*(w.slice(some.start, rows) for w in whole), _binary(told, bounds[some.start : some.stop + 1]), *(null(x.type, rows) for x in lists)], names
            )


def _score_told(batches: Iterable[pa.RecordBatch], model: Model, head, segments: int) -> Iterator[pa.RecordBatch]:
    """Scores of the texts of each slice, from rows in order of slice: texts and levels."""
    for part in _groups(batches, "slice"):
        texts = part.filter(pc.is_null(part["levels"])).sort_by("row").combine_chunks()
        told = part.filter(pc.is_valid(part["levels"])).sort_by([("part", "ascending"), ("segment", "ascending")]).combine_chunks()
        of = np.asarray(told["part"])
        starts = np.flatnonzero(np.concatenate([[len(of) > 0], of[1:] != of[:-1]])).tolist()
        begins = np.searchsorted(np.asarray(texts["row"]), of[starts]).tolist()
        if begins[:1] != [0]:
            raise RuntimeError("the levels of a slice's first texts are missing")
        for start, stop, begin, end in zip(starts, [*starts[1:], len(of)], begins, [*begins[1:], texts.num_rows], strict=True):
            own = texts.slice(begin, end - begin).combine_chunks()
            each = Read.each(own["text"].combine_chunks(), head.value, model.complete)
            keys, order, spans = _distinct(_placed(each, segments))
            levels = np.frombuffer(b"".join(told["levels"].slice(start, stop - start).to_pylist()), np.uint8)
            if len(levels) != len(keys):
                raise RuntimeError(f"{len(keys)} keys were asked for, and the levels of {len(levels)} came back")
            levels, at, row = _spread(levels, order, spans), 0, 0
            del keys, order, spans
            for read in each:
                pairs, triples, words = (count_of(x) for x in np.split(levels[at : at + sum(map(len, (read.pairs, read.triples, read.words)))], np.cumsum([len(read.pairs), len(read.triples)])))
                scored = _scored(read, model, words, pairs, lambda some, triples=triples: triples[some])
                rows = own.slice(row, len(scored[0]))
                yield pa.RecordBatch.from_arrays([rows["row"].combine_chunks(), rows["doc_id"].combine_chunks(), *scored], _NAMES)
                at, row = at + len(read.pairs) + len(read.triples) + len(read.words), row + len(scored[0])


def _asked(rows: DataFrame, n_segments: int, sizes: tuple[int, int, bool], head, probes: int, schema: str) -> tuple[Model, DataFrame]:
    """The model, and scores of rows (row, doc_id, text), by what slices ask of segments; sizes: the model's first three."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    cut = rows.withColumn("held", held_out(F.col("doc_id"))).mapInArrow(partial(_cut, size=ASKED_BYTES), f"slice long, row long, doc_id {kind}, text string, held boolean")
    sliced = shared.written(cut, "slices", "zstd")
    asked = sliced.select("slice", "row", "held", "text").mapInArrow(partial(_ask, head=head, complete=sizes[2], segments=n_segments), _ASKED)
    dealt = asked.repartition(min(n_segments, MOST_TASKS), "segment").sortWithinPartitions("segment")
    told = shared.written(dealt.mapInArrow(partial(_tell, probes=probes), _TOLD), "levels", "zstd")
    model = Model(*sizes, *_shares(told.filter("slice IS NULL")))
    levels = told.filter("slice IS NOT NULL").select("slice", "part", "segment", "levels")
    met = sliced.drop("held").unionByName(levels, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice")
    parts = shared.written(met.mapInArrow(partial(_score_told, model=model, head=head, segments=n_segments), schema), "parts")
    shared.drop_written(sliced)
    shared.drop_written(told)
    return model, parts


def _head(words: DataFrame) -> tuple[Head, bool, Column]:
    """The frequent words, whether they are all, and which words of a table are among them.

    The least count that is broadcast follows from how many words have each
    count, so that at most HEAD words do.
    """
    top = 1 << 20
    by = words.groupBy(F.least("n", F.lit(top)).alias("n"), (F.octet_length("word") <= HEAD_BYTES).alias("short")).agg(F.count("*").alias("words"), F.sum("n").alias("total"))
    rows = by.collect()  # two rows for each count below 2**20, at most
    fit = Counter()
    for r in rows:
        fit[r.n] += r.words if r.short else 0
    least, held = top, 0
    for n in sorted(fit, reverse=True):
        held += fit[n]
        if held > HEAD:
            break
        least = n
    complete = all(r.n >= least and r.short for r in rows)
    among = (F.col("n") >= least) & (F.octet_length("word") <= HEAD_BYTES)
    got = words.filter(among).toArrow().combine_chunks()
    held_words = pa.concat_arrays([c.cast(pa.string()) for c in got["word"].chunks] or [pa.array([], pa.string())])
    return Head(held_words, np.asarray(got["n"]).astype(np.int64)), complete, among


def _shares(segments: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Discount and share for each magnitude: Ney's estimate from pairs seen once and twice, and what it frees for each token."""
    each = F.explode(F.arrays_zip("tag", "types", "once", "twice", "tokens")).alias("s")
    by = segments.select(each).groupBy("s.tag").agg(*(F.sum(f"s.{c}").alias(c) for c in ("types", "once", "twice", "tokens"))).collect()
    discount, share = np.zeros(1 << TAG_BITS), np.ones(1 << TAG_BITS)
    for r in by:
        discount[r.tag] = min(0.999, r.once / (r.once + 2 * r.twice)) if r.once else 0.5
        share[r.tag] = discount[r.tag] * r.types / r.tokens
    return discount, share


def score(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, probes: int = PROBES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and score_per_token of every row, repeated rows too.

    The model learns from the documents that are not held out. A null or empty
    text has its end as its one token; a null doc_id stays null and is dealt as
    an empty one; with no training documents nothing is known and both scores
    are those of a uniform guess among one word. Other columns, whatever their
    names, are left out; an empty table gives an empty table. score does not
    depend on broadcast_bytes; probes: of each entry of the filter.
    """
    spark = docs.sparkSession
    shared.ready_workers(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    training = docs.filter(~held_out(F.col("doc_id"))).select("text")
    with shared.shuffles_dropped(spark):
        words = shared.written(training.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    n_tokens, n_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    exact, complete, among = _head(words)
    head = spark.sparkContext.broadcast(exact)

    n_segments, sizes = 1 + int(n_tokens) // SEGMENT, (int(n_tokens), int(n_words), complete)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = f"row long, doc_id {kind}, {_SCORED}"
    parts = None
    if n_tokens * TOKEN_BYTES <= broadcast_bytes:
        counted = training.mapInArrow(partial(_count_pairs, head=head, segments=n_segments), _COUNTED)
        if not complete:
            counted = counted.union(words.filter(~among).mapInArrow(partial(_rest_words, segments=n_segments), _COUNTED))
        dealt = counted.repartition(min(n_segments, MOST_TASKS), "segment").sortWithinPartitions("segment")
        segments = shared.written(dealt.mapInArrow(partial(_build, probes=probes), _STATS), "segments")
        if segments.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0] <= broadcast_bytes:
            model = Model(*sizes, *_shares(segments))
            counts = spark.sparkContext.broadcast(Filter(n_segments, segments.select("segment", "n_bits", "bits").toArrow(), probes))
            parts = shared.written(rows.mapInArrow(partial(_score, model=model, head=head, counts=counts), schema), "parts")
            counts.destroy()  # workers would keep it else
        shared.drop_written(segments)
    if parts is None:
        with shared.shuffles_dropped(spark):
            model, parts = _asked(rows, n_segments, sizes, head, probes, schema)
    head.destroy()
    whole = parts.drop("rest") if complete else _with_rest(parts, words, model)
    return whole.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        (F.col("score") / F.col("n_tokens")).alias("score_per_token"),
    )


def _with_rest(parts: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    """Adds what the joined words contribute to base_score; a word that many rows have is joined in split partitions."""
    rest = parts.select("row", F.explode("rest").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    c = F.coalesce(F.col("n"), F.lit(0))
    log = F.log10((c + 0.5) / F.lit(model.tokens + 0.5 * (model.words + 1)))
    added = rest.join(words, "word", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("_known"), F.sum(F.col("times") * log).alias("_base"))
    return parts.drop("rest").join(added, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), "score"
    )
