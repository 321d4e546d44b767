"""Brute-force twins of what the operators compute, in plain Python."""

import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}

#: Texts with every awkward case: null, empty, white space, ties, repeats, long ones, marks, other scripts.
AWKWARD = [
    None, "", " \t\r\n ", "one", "one two", "one two three", "ONE two three", "one  two\tthree", "a" * 5000, "word " * 3000,
    "é́ ﬁ 中文 \U0001f600 ▁▁ x", " lead and trail  ", "tabs\tand\x0bother\x0cspaces\x1cnot", "<|endoftext|> <s> </s> <unk>", "\x00nul\x00",
]


def words(text):
    return WORD.findall(text or "")


def shingles(text, size):
    w = words((text or "").translate(LOWER))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


class Groups:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def near_groups(docs, size, percent):
    """doc_id -> smallest doc_id that links reach."""
    sets = {i: shingles(t, size) for i, t in docs.items()}
    groups, holders = Groups(docs), defaultdict(list)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                groups.join(i, j)
        for x in s:
            holders[x].append(i)
    return {i: groups.root(i) for i in docs}


def repeat_words(w, size=5):
    at = defaultdict(list)
    for k in range(len(w) - size + 1):
        at[tuple(w[k : k + size])].append(k)
    return len({k + j for v in at.values() if len(v) > 1 for k in v for j in range(size)})


def quality(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat_words(w),
        "n_lines": len(lines),
        "n_exclamations": text.count("!"),
    }


def good(text):
    q = quality(text)
    return not (
        q["n_words"] < 10
        or 100 * q["n_repeat_words"] > 20 * q["n_words"]
        or 20 * q["n_symbols"] > q["word_chars"]
        or 2 * q["n_dup_lines"] > q["n_lines"]
        or 20 * q["n_exclamations"] > q["word_chars"]
        or q["word_chars"] > 40 * q["n_words"]
    )


def held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def _holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(digits[::-1])]
        return 13 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def private(text):
    return [(k, m.start(), m.end()) for k, p in KINDS for m in re.finditer(p, text or "") if _holds(k, m[0])]


_SECRET = re.compile(r"""(token|secret|password|passwd|key)["']? {0,3}[=:] {0,3}["']?(?![A-Za-z_/+.-]+(?![A-Za-z0-9_/+.-]))([A-Za-z0-9_/+.-]{16,}={0,2})""", re.I)


def _contexts(text, start, stop):
    before, after = words(text[:start].lower())[-2:], words(text[stop:].lower())[:1]
    return ([" ".join(before)] if len(before) == 2 else []) + ([f"{before[-1]} _ {after[0]}"] if before and after else [])


def all_private(texts, support=5, confidence=0.8, accept=0.9, rounds=3):
    """For each text its sorted spans: seeds, and what contexts discover."""
    order = [k for k, _ in KINDS] + ["secret"]
    seeds = [private(t) + [("secret", *m.span(2)) for m in _SECRET.finditer(t or "")] for t in texts]
    open_ = [[m.span() for m in re.finditer(r"\S*[0-9@]\S*", t or "") if all(m.end() <= a or m.start() >= b for _, a, b in s)] for t, s in zip(texts, seeds, strict=True)]
    around, known = defaultdict(set), defaultdict(set)  # surfaces of a context, kinds of a surface
    for t, s, o in zip(texts, seeds, open_, strict=True):
        for a, b in [(a, b) for _, a, b in s] + o:
            for c in _contexts(t, a, b):
                around[c].add(t[a:b].lower())
        for k, a, b in s:
            known[t[a:b].lower()].add(k)
    scores = {(x, k): 1.0 for x, ks in known.items() for k in ks}
    for _ in range(rounds):
        trusted = {}
        for c, surfaces in around.items():
            for k in order:
                own = sum(scores.get((x, k), 0) for x in surfaces)
                if own >= support and own / len(surfaces) >= confidence:
                    trusted[c, k] = min(own / len(surfaces), 0.999)
        wrong = defaultdict(lambda: 1.0)
        for (c, k), share in trusted.items():
            for x in around[c]:
                wrong[x, k] *= 1 - share
        scores = {(x, k): 1.0 for x, ks in known.items() for k in ks} | {xk: max(1 - w, 1.0 if xk[1] in known.get(xk[0], ()) else 0) for xk, w in wrong.items() if 1 - w >= accept}
    best = {}
    for (x, k), s in scores.items():
        if x not in known:
            best[x] = max(best.get(x, (0, "")), (s, k))
    out = []
    for t, s, o in zip(texts, seeds, open_, strict=True):
        new = [(best[x][1], a, b) for a, b in o if (x := t[a:b].lower()) in best and any((c, best[x][1]) in trusted for c in _contexts(t, a, b))]
        out.append(sorted(s + new, key=lambda v: (order.index(v[0]), v[1], v[2])))
    return out
