"""Token counts: batch encoding in Arrow functions that return lengths only.

Where a tokenizer's pre-tokenizer drops white space and its special tokens hold
none, the ends of words are safe boundaries: a text's count is the sum of its
words' counts. `parts_at_space` reads off the file whether that holds; with any
other tokenizer texts are encoded whole, which is always right. Long texts
are thus split without a change of the result, and a word that comes again in
a slice or was just seen is not encoded again. A long word is split further:
after a Latin letter before a digit or one of some marks, and after a digit
before a Latin letter, as the pre-tokenizer always parts those, no special token
holds such a pair, and no normal form or case depends on what stands across.
Words go to the tokenizer in batches of about equal bytes. Only lengths leave
the function.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import shared

#: Bytes of words in one call of the tokenizer.
BATCH_BYTES = 256 << 10
#: Words that a worker remembers, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 400_000, 48
#: Characters from which a word is split.
LONG_WORD = 1 << 14
_SAFE = re.compile(r"(?<=[A-Za-z])(?=[0-9,.;:()\[\]{}\"!?])|(?<=[0-9])(?=[A-Za-z])")


#: Normal forms that look at no white space but to even it out, and a pattern that takes letters, digits one by one and marks, apart.
PLAIN_FORMS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
PARTING = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


@lru_cache(maxsize=2)
def parts_at_space(path: str) -> bool:
    """Whether no token of a tokenizers file reaches over white space or over a boundary of `pieces_of`."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    forms, before = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}
    forms = forms.get("normalizers", [forms] if forms else [])
    first = (before.get("pretokenizers") or [before])[0]
    parted = first.get("type") == "Split" and first.get("pattern") == {"Regex": PARTING} and (first.get("behavior"), first.get("invert")) == ("Removed", True)
    words = all(not re.search(r"\s", t["content"]) and not _SAFE.search(t["content"]) and not any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized")) for t in told.get("added_tokens", []))
    return parted and words and all(f in PLAIN_FORMS for f in forms)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded, {}


def pieces_of(word: str, size: int = LONG_WORD) -> list[str]:
    """Parts of a word whose tokens are the word's: at least size characters each, but for the last, and longer without a safe boundary."""
    out, begin = [], 0
    while len(word) - begin > size:
        cut = _SAFE.search(word, begin + size)
        if cut is None:
            break
        out.append(word[begin : cut.start()])
        begin = cut.start()
    return [*out, word[begin:]]


def _by_bytes(texts: list[str], size: int) -> Iterator[list[str]]:
    """Lists of texts with about size bytes (UTF-8) each."""
    lengths = np.asarray(pc.binary_length(pa.array(texts, pa.large_string()))).astype(np.int64)
    ends, begin = np.cumsum(lengths), 0
    while begin < len(texts):
        done = ends[begin - 1] if begin else 0
        end = min(len(texts), int(np.searchsorted(ends, done + size)) + 1)
        yield texts[begin:end]
        begin = end


def word_lengths(path: str, distinct: pa.Array) -> np.ndarray:
    """Tokens of each word, from what the worker remembers or in byte-balanced batches."""
    tokenizer, known = _tokenizer(path)
    long = np.flatnonzero(np.asarray(pc.greater(pc.binary_length(distinct), LONG_WORD))).tolist()
    words = distinct.to_pylist()
    split = {k: pieces_of(words[k]) for k in long}
    wanted = [w for w in words if w not in known] if not split else [w for k, w in enumerate(words) if k not in split and w not in known]
    wanted += sorted({p for parts in split.values() for p in parts if p not in known} - set(wanted) if split else ())
    fresh: dict[str, int] = {}
    for batch in _by_bytes(wanted, BATCH_BYTES):
        fresh.update(zip(batch, map(len, tokenizer.encode_batch(batch, add_special_tokens=False)), strict=True))
    length = lambda w: known[w] if w in known else fresh[w]
    out = np.fromiter((sum(map(length, split[k])) if k in split else length(w) for k, w in enumerate(words)), np.int64, len(words))
    if len(known) + len(fresh) > REMEMBERED:
        known.clear()
    known.update((w, n) for w, n in fresh.items() if len(w) <= REMEMBERED_CHARS)
    return out


def text_lengths(path: str, text: pa.Array) -> np.ndarray:
    """Tokens of each whole text, in byte-balanced batches."""
    tokenizer, _ = _tokenizer(path)
    return np.fromiter((len(e) for batch in _by_bytes(text.to_pylist(), BATCH_BYTES) for e in tokenizer.encode_batch(batch, add_special_tokens=False)), np.int64, len(text))


def _count(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in shared.slices(batches):
        text = pc.fill_null(batch.column("text"), "")
        if parts_at_space(path):
            offsets, codes, distinct = shared.words(text)
            counts = shared.sums(word_lengths(path, distinct)[codes], offsets)
        else:
            counts = text_lengths(path, text)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.asarray(pc.binary_length(text)).astype(np.int64)), pa.array(counts)],
            ["doc_id", "n_bytes", "n_tokens"],
        )


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row, repeated rows too.

    path: a tokenizers .json file that each worker can open, of any tokenizer;
    texts are split where that is safe, else encoded whole. A null or empty
    text has 0 bytes and 0 tokens; a null doc_id stays null; other columns,
    whatever their names, are left out; an empty table gives an empty table.
    """
    shared.ready_workers(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(partial(_count, path=path), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
