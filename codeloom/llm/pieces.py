"""SentencePiece encoding and decoding by a table of prefixes.

For every prefix of a segment the table holds the one last token that the
merges leave at its end. An automaton reports the pieces that end there; the
piece is the right one if it is compatible with the last token of the prefix
before it, that is, if undoing both tokens' merges, latest first, meets no
moment at which a merge across their border would have come first. The ids are
then read backwards. This is exact: the merges of a prefix determine its last
token, so one piece fits.

Texts are split where no merge can cross: before a space, as no piece has a
space after another character, and around characters that no piece has, which
become bytes. Runs of spaces, whose pieces share one priority, are merged from
the left.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from codeloom.llm import shared

SPACE_MARK = "▁"
#: Bytes that are no character become one replacement each.
codecs.register_error("codeloom-bytewise", lambda e: ("\ufffd", e.start + 1))
#: Segments in each of the two generations that a worker remembers, the longest of them, and pairs of tokens.
REMEMBERED, REMEMBERED_CHARS, PAIRS = 250_000, 48, 400_000


class PieceTable:
    """Encodes and decodes as the BPE model at path does, without begin or end ids."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(k) for k in range(n)]
        self.byte_id = {int(pieces[k][3:5], 16): k for k in range(n) if model.is_byte(k)}
        normal = [k for k in range(n) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        scores = {k: model.get_score(k) for k in normal}
        runs = {len(pieces[k]): k for k in normal if set(pieces[k]) == {SPACE_MARK}}
        merging = sorted((k for k in normal if len(pieces[k]) > 1 and set(pieces[k]) != {SPACE_MARK}), key=lambda k: -scores[k])
        self.single = {pieces[k]: k for k in normal if len(pieces[k]) == 1}
        self._check(pieces, merging, scores, runs)
        self.runs = runs
        #: The moment of a piece's last merge; characters have none.
        self.rank = {k: -1 for k in self.single.values()} | {k: at for at, k in enumerate(merging)}
        self.text = {k: pieces[k] for k in self.rank}
        self.merge_rank = {pieces[k]: self.rank[k] for k in merging}
        id_of = {pieces[k]: k for k in self.rank}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        found = ahocorasick.Automaton()
        for piece, k in id_of.items():
            if len(piece) > 1:
                ends = self._last_merge(piece)
                if ends is None:  # merges never leave this piece
                    continue
                self.left[k], self.right[k] = id_of[ends[0]], id_of[ends[1]]
            found.add_word(piece, (len(piece), k))
        found.make_automaton()
        self.found = found
        self.fits: dict[int, bool] = {}
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.foreign = re.compile("[^" + "".join(map(re.escape, self.single)) + "]")
        self.decimal = pa.array([f"{k},".encode() for k in range(n)], pa.binary())
        self.bytes_of = pa.array(
            [bytes([int(pieces[k][3:5], 16)]) if model.is_byte(k) else b"" if model.is_control(k) else b" \xe2\x81\x87 " if model.is_unknown(k) else pieces[k].replace(SPACE_MARK, " ").encode() for k in range(n)],
            pa.binary(),
        )

    def _check(self, pieces: list[str], merging: list[int], scores: dict[int, float], runs: dict[int, int]) -> None:
        """The method rests on these properties of a model."""
        if len({scores[k] for k in merging}) != len(merging):
            raise ValueError("two pieces share a priority")
        if any(SPACE_MARK in pieces[k][1:] for k in merging):
            raise ValueError("a piece has a space after another character")
        if any(c not in self.single for k in merging for c in pieces[k]):
            raise ValueError("a piece has a character that is no piece")
        if runs and max((scores[k] for n, k in runs.items() if n > 1), default=-1e30) >= min(scores[k] for k in merging):
            raise ValueError("a run of spaces comes before other merges")
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte pieces")

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two halves that the merges of piece alone join last; None if they don't end in piece."""
        parts, last = list(piece), None
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda i: self.merge_rank.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[at] + parts[at + 1] not in self.merge_rank:
                return None
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = ["".join(last)]
        return last

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave the border between tokens a and b, which stand side by side."""
        rank, text, merge_rank = self.rank, self.text, self.merge_rank
        until = 1 << 60
        while True:
            if merge_rank.get(text[a] + text[b], 1 << 60) < until:
                return False
            if rank[a] > rank[b]:
                until, a = rank[a], self.right[a]
            elif rank[b] < 0:
                return True
            else:  # of equal merges the left one comes first
                until, b = rank[b] + 1, self.left[b]

    def _table(self, run: str) -> list[int] | None:
        """Ids of a run without runs of spaces; None if it has a character that is no piece."""
        n = len(run)
        last, size, filled, fits = [0] * n, [0] * n, -1, self.fits
        for end, (length, k) in self.found.iter(run):
            if filled == end:
                continue
            before = end - length
            if before >= 0:
                if not size[before]:
                    continue
                key = last[before] << 20 | k
                fit = fits.get(key)
                if fit is None:
                    fit = self.compatible(last[before], k)
                    if len(fits) >= PAIRS:
                        fits.clear()
                    fits[key] = fit
                if not fit:
                    continue
            last[end], size[end], filled = k, length, end
        ids, at = [], n - 1
        while at >= 0:
            if not size[at]:
                return None
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def _word(self, segment: str) -> list[int]:
        """Ids of a segment with a space at most at its begin."""
        ids = self._table(segment)
        if ids is not None:
            return ids
        out: list[int] = []
        at = 0
        for m in self.foreign.finditer(segment):
            if m.start() > at:
                out += self._run(segment[at : m.start()])
            out += [self.byte_id[x] for x in m[0].encode()]
            at = m.end()
        if at < len(segment):
            out += self._run(segment[at:])
        return out

    def _run(self, run: str) -> array:
        """Ids of a run between characters that are no pieces."""
        ids = array("i")
        ids.frombytes(self._remembered(run, self._table))
        return ids

    def _remembered(self, segment: str, encode: Callable[[str], list[int]]) -> bytes:
        """What encode gives for a segment, as int32; of two generations the older is dropped when the newer is full."""
        got = self.recent.get(segment)
        if got is None:
            got = self.older.get(segment)
            if got is None:
                got = array("i", encode(segment)).tobytes()
            if len(segment) <= REMEMBERED_CHARS:
                if len(self.recent) >= REMEMBERED:
                    self.older, self.recent = self.recent, {}
                self.recent[segment] = got
        return got

    def spaces(self, n: int) -> list[int]:
        """Ids of n spaces: of the parts that can be joined the first are, so a part grows until longer runs are no pieces."""
        top = max(self.runs, default=1)
        if n > top and self._grown(top) == [top]:  # a part of this length never grows again
            return [self.runs[top]] * (n // top) + self.spaces(n % top)
        return [self.runs[x] for x in self._grown(n)]

    def _grown(self, n: int) -> list[int]:
        """Lengths of the parts of n spaces. All parts but the last are settled, so each space meets the last one only."""
        parts: list[int] = []
        for _ in range(n):
            parts.append(1)
            while len(parts) > 1 and parts[-2] + parts[-1] in self.runs:
                last = parts.pop()
                parts[-1] += last
        return parts

    def segment(self, segment: str) -> bytes:
        """Ids (int32) of some spaces followed by other characters."""
        return self._remembered(segment, self._segment)

    def _segment(self, segment: str) -> list[int]:
        rest = segment.lstrip(SPACE_MARK)
        n = len(segment) - len(rest)
        if not rest:
            return self.spaces(n)
        if n < 2:
            return self._word(segment)
        ids = self._word(SPACE_MARK + rest)
        alone = ids[0] == self.single[SPACE_MARK]
        return self.spaces(n) + ids[1:] if alone else self.spaces(n - 1) + ids

    def encode_all(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text's ids (one more than texts), and the ids."""
        marked = pc.replace_substring(pc.fill_null(text, ""), SPACE_MARK, " ")
        split = pc.split_pattern(marked, " ")
        flat, offsets = split.flatten(), np.asarray(split.offsets).astype(np.int64)
        offsets = offsets - offsets[0]
        empty = np.asarray(pc.equal(pc.binary_length(flat), 0))
        gaps = shared.sums(empty.astype(np.int64), offsets) > 0
        coded = pc.dictionary_encode(flat)
        codes, begun = np.asarray(coded.indices), [b"" if not w else self.segment(SPACE_MARK + w) for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, begun), np.int64, len(begun)) // 4
        each = pa.array(begun, pa.binary())
        if not gaps.any():
            ids = np.frombuffer(self._joined(each.take(pa.array(codes))), np.int32)
            return np.concatenate([[0], np.cumsum(sizes[codes])])[offsets], ids
        parts, counts = [], []
        for k, gap in enumerate(gaps):
            if gap:
                whole = marked[k].as_py()
                found = [self.segment(s) for s in re.findall(f"{SPACE_MARK}+[^{SPACE_MARK}]*", SPACE_MARK + whole.replace(" ", SPACE_MARK))] if whole else []
                parts.append(np.frombuffer(b"".join(found), np.int32))
            else:
                parts.append(np.frombuffer(self._joined(each.take(pa.array(codes[offsets[k] : offsets[k + 1]]))), np.int32))
            counts.append(len(parts[-1]))
        return np.concatenate([[0], np.cumsum(counts)]), np.concatenate(parts) if parts else np.zeros(0, np.int32)

    @staticmethod
    def _joined(values: pa.Array) -> memoryview:
        """The bytes of a binary array's values, one behind the other."""
        if not len(values):
            return memoryview(b"")
        bounds = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4)
        data = values.buffers()[2]
        return memoryview(data)[bounds[0] : bounds[-1]] if data is not None else memoryview(b"")

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text]))[1].tolist()

    def decode_bytes(self, offsets: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
        """The UTF-8 text of each list of ids: bytes of pieces, without the space that encoding puts first."""
        sizes = np.asarray(pc.binary_length(self.bytes_of)).astype(np.int64)[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        joined = self._joined(self.bytes_of.take(pa.array(ids)))
        raw = np.frombuffer(self.byte_flags(), bool)[ids]
        bytewise = shared.sums(raw.astype(np.int64), offsets) > 0
        for k in range(len(offsets) - 1):
            part = bytes(joined[ends[k] : ends[k + 1]])
            if part[:1] == b" " and not raw[offsets[k]]:
                part = part[1:]
            yield part.decode("utf-8", "codeloom-bytewise").encode() if bytewise[k] else part

    @lru_cache(maxsize=1)  # noqa: B019  one table lives as long as its worker
    def byte_flags(self) -> bytes:
        flags = np.zeros(len(self.bytes_of), bool)
        flags[list(self.byte_id.values())] = True
        return flags.tobytes()

    def decode(self, ids: list[int]) -> str:
        return next(self.decode_bytes(np.array([0, len(ids)]), np.asarray(ids, np.int32))).decode()


@lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


def _round_trip(batches: Iterable[pa.RecordBatch], path: str, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    table = piece_table(path)
    for batch in shared.slices(batches):
        offsets, ids = table.encode_all(batch.column("text"))
        held = pa.array(ids)
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(table.decimal)).astype(np.int64)[ids])])[offsets]
        listed = table._joined(table.decimal.take(held))
        digests = [hashlib.sha256(listed[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        del listed
        texts = list(table.decode_bytes(offsets, ids))
        own = {
            "n_tokens": pa.array(np.diff(offsets)),
            "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), held),
            "decoded": pa.array(texts, pa.binary()).cast(pa.string()) if "decoded" in keep else None,
            "ids_sha256": pa.array(digests, pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
        }
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(own[c] for c in keep)], ["doc_id", *keep])


_TYPES = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_decode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """doc_id and the columns named in keep of every row, repeated rows too.

    keep: any of n_tokens, ids, decoded, ids_sha256 (of the decimal ids with
    commas) and decoded_sha256 (of the decoded text). path: a SentencePiece BPE
    model that each worker can open. A null or empty text has no ids and decodes
    to the empty text; a null doc_id stays null; other columns, whatever their
    names, are left out; an empty table gives an empty table.
    """
    shared.ready_workers(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{c} {_TYPES[c]}" for c in keep)])
    return docs.select("doc_id", "text").mapInArrow(partial(_round_trip, path=path, keep=tuple(keep)), schema)
