"""License scans: MinHash bands over overlapping windows, then exact containment.

A text's five-word shingles are cut into windows of 2 * B shingles that begin
every B shingles from its first word, for B in powers of two. A template of m shingles is looked for
in the windows with the smallest B >= 1.25 * m, so that a copy, even with a
quarter of its length put in between, lies whole in one of them. Such a window
has a Jaccard similarity of at least 0.15 with the template. Bands of one hash
each collide with just that probability, so of BANDS = 64 bands at least one
does but for a chance of 2e-5 (6e-7 for a whole copy, whose similarity is 0.2 or
more). Windows without a shingle of a template never collide with it.

Each window that collides is verified by its full shingles, with a block more
on both sides: the share of the template's shingles that it contains decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from codeloom.llm import shared

SHINGLE, BANDS, CONTAINMENT = 5, 64, 0.8
#: Characters of templates that are sent to every worker at once; more are looked for in parts.
MOST_TEMPLATES = 4 << 20

#: Public license notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 (short)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the "
        "License."
    ),
    "MIT (short)": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer."
    ),
    "BSD-3-Clause (endorsement)": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, '
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all "
        "subject to the following:"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non- "
        "commercial, and by any means."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
        "available at"
    ),
    "GPL-3.0 (short)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0": (
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version."
    ),
    "AGPL-3.0": (
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0 (short)": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": (
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the "
        "public domain worldwide."
    ),
}


@lru_cache(maxsize=1)
def _factors() -> np.ndarray:
    return (shared.mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of each text's words, the shingle that begins at each word, and whether it ends in the same text.

    Words are compared without case of A-Z and without marks at their ends.
    """
    offsets, codes, distinct = shared.words(pc.ascii_lower(pc.fill_null(text, "")))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(re.sub(r"^\W+|\W+$", "", w)) for w in distinct.to_pylist()), np.uint64, len(distinct))[codes]
    n, counts = len(codes), np.diff(offsets)
    valid = np.repeat(offsets[1:], counts) - np.arange(n) >= SHINGLE
    found = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for step in range(SHINGLE):
            following = np.zeros(n, np.uint64)
            following[: max(0, n - step)] = hashes[step:]
            found = shared.mixed(found * np.uint64(0x100000001B3) + following)
    return offsets, found, valid


class Index:
    """Templates with their full sets, and by B the bands of those that are looked for in windows of 2 * B shingles."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = list(templates)
        self.sets: list[np.ndarray] = []
        self.bands: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by: dict[int, list[int]] = {}
        for k, name in enumerate(self.names):
            _, found, valid = shingles(pa.array([templates[name]]))
            own = np.unique(found[valid])
            if not len(own):
                raise ValueError(f"template {name!r} has fewer than {SHINGLE} words")
            self.sets.append(own)
            by.setdefault(1 << int(np.ceil(np.log2(1.25 * len(own)))), []).append(k)
        for size, numbers in by.items():
            least = np.stack([((self.sets[k] >> np.uint64(32)).astype(np.uint32)[:, None] * _factors()).min(axis=0) for k in numbers])
            self.bands[size] = np.array(numbers), least

    def candidates(self, offsets: np.ndarray, found: np.ndarray, valid: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """B, template, text and first shingle (in all) of each window that collides; a text's windows don't depend on others."""
        nothing = np.uint32(0xFFFFFFFF)
        x = (found >> np.uint64(32)).astype(np.uint32)
        out = np.append(~valid, True)
        levels = _levels(offsets, max(self.bands))
        hits: set[tuple[int, int, int, int]] = set()
        for band, factor in enumerate(_factors()):
            least = np.append(x * factor, nothing)  # the last one stands where a text has no more
            least[out] = nothing
            for size, left, right, following, text_of, place in levels:
                if size > 1:
                    least = np.append(np.minimum(least[left], least[right]), nothing)
                if size in self.bands:
                    numbers, values = self.bands[size]
                    window = np.minimum(least[:-1], least[following])
                    # One pass finds the few windows whose value is any template's.
                    some = np.flatnonzero(np.isin(window, values[:, band]))
                    for number, value in zip(numbers, values[:, band], strict=True):
                        hits.update((size, int(number), int(text_of[w]), int(offsets[text_of[w]] + place[w] * size)) for w in some[window[some] == value])
        return iter(sorted(hits))


def _levels(offsets: np.ndarray, top: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block size B in powers of two up to top: where the two halves of each text's blocks stand among the blocks
    of the size before, the block that follows each in its text, its text, and its number in the text.

    A place past the last block stands for what a text doesn't have.
    """
    counts = np.diff(offsets)
    out, size, before = [], 1, None
    while size <= top:
        begin = np.concatenate([[0], np.cumsum(counts)])
        text_of = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(begin[-1]) - begin[:-1][text_of]
        more = place + 1 < counts[text_of]
        following = np.where(more, np.arange(begin[-1]) + 1, begin[-1])
        if before is None:
            left = right = following
        else:
            old_counts, old_begin = before
            left = old_begin[:-1][text_of] + 2 * place
            right = np.where(2 * place + 1 < old_counts[text_of], left + 1, old_begin[-1])
        out.append((size, left, right, following, text_of, place))
        before, counts, size = (counts, begin), -(-counts // 2), size * 2
    return out


@lru_cache(maxsize=4)
def _index(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(templates))


def matches(text: pa.Array, index: Index, containment: float) -> Iterator[tuple[int, str, float, int, int, int]]:
    """Number of the text, template, best containment, first and last word of the best window's match, windows that match."""
    offsets, found, valid = shingles(text)
    if not len(found):
        return
    best: dict[tuple[int, int], list] = {}
    for size, number, doc, first in index.candidates(offsets, found, valid):
        wanted = index.sets[number]
        a, b = max(int(offsets[doc]), first - size), min(int(offsets[doc + 1]), first + 3 * size)
        part = found[a:b]
        at = np.flatnonzero(np.isin(part, wanted) & valid[a:b])
        share = len(np.unique(part[at])) / len(wanted)
        if share < containment:
            continue
        entry = best.setdefault((doc, number), [0.0, 0, 0, 0])
        entry[3] += 1
        if share > entry[0]:
            entry[:3] = share, int(a + at[0] - offsets[doc]), int(a + at[-1] - offsets[doc]) + SHINGLE - 1
    for (doc, number), (share, first, last, windows) in sorted(best.items()):
        yield doc, index.names[number], share, first, last, windows


def _scan(batches: Iterable[pa.RecordBatch], templates: tuple[tuple[str, str], ...], containment: float) -> Iterator[pa.RecordBatch]:
    index = _index(templates)
    for batch in shared.slices(batches, size=shared.SLICE_BYTES // 2):
        rows = list(matches(batch.column("text"), index, containment))
        docs, names, shares, first, last, windows = zip(*rows, strict=True) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(docs, pa.int64())),
                pa.array(names, pa.string()),
                pa.array(shares, pa.float64()),
                pa.array(first, pa.int64()),
                pa.array(last, pa.int64()),
                pa.array(windows, pa.int64()),
            ],
            ["doc_id", "license", "containment", "first_word", "last_word", "n_windows"],
        )


def _parts(templates: dict[str, str], most: int) -> list[tuple[tuple[str, str], ...]]:
    """The templates in parts of up to `most` characters; a longer one is a part of its own."""
    out: list[list[tuple[str, str]]] = []
    held = most
    for name, text in templates.items():
        if held + len(text) > most or not out:
            out.append([])
            held = 0
        out[-1].append((name, text))
        held += len(text)
    return [tuple(p) for p in out]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment, first_word, last_word and n_windows for each text and template that it contains.

    templates: notices by name, five words each at least. A worker holds
    MOST_TEMPLATES characters of them at a time: where there are more, all texts
    are scanned once for each part, and as no template's matches depend on
    another, the rows are the same. Of a text's windows the one with the largest
    share counts, the first of equals. Null, empty and shorter texts have no
    row; a null doc_id stays null; repeated rows give repeated results; other
    columns, whatever their names, are left out; an empty table gives an empty
    table.
    """
    shared.ready_workers(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, license string, containment double, first_word long, last_word long, n_windows long"
    texts = docs.select("doc_id", "text")
    each = (texts.mapInArrow(partial(_scan, templates=part, containment=containment), schema) for part in _parts(templates or TEMPLATES, MOST_TEMPLATES))
    return reduce(DataFrame.union, each)
