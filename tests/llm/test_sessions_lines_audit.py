"""Late sessions, repeated lines and the filter audit against brute force, on driver tables and on awkward ones."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import filter_audit, late_sessions, line_dedup, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, lost int, hashes string, final string, part string, first long"


def table(spark, texts, ids=None, sources=None):
    """Documents with extra columns whose names clash with what operators use."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["a"] * len(texts) if sources is None else sources
    return spark.createDataFrame([(i, t, "en", s, None, "k", 7, "h", "f", "p", 3) for i, t, s in zip(ids, texts, sources, strict=True)], SCHEMA)


# Late sessions


def sessions(events, gap):
    """Every version, by forming all sessions anew after each batch."""
    out = []
    for user in {e[0] for e in events}:
        own = [e for e in events if e[0] == user]
        standing = []
        for batch in sorted({e[1] for e in own}):
            held = sorted((e[2], e[1], e[3]) for e in own if e[1] <= batch)
            parts = [[held[0]]]
            for e in held[1:]:
                if e[0] - parts[-1][-1][0] > gap:
                    parts.append([])
                parts[-1].append(e)
            for p in parts:
                if any(e[1] == batch for e in p):
                    v = {"key": (user, batch, p[0][0], p[-1][0]), "n": len(p), "new": sum(e[1] == batch for e in p), "h": sum(e[2] for e in p), "by": (None, None)}
                    gone = [s for s in standing if s["key"][2] >= p[0][0] and s["key"][3] <= p[-1][0]]
                    for s in gone:
                        s["by"] = (batch, p[0][0])
                        standing.remove(s)
                    v["retracted"] = len(gone)
                    standing.append(v)
                    out.append(v)
    return sorted((*v["key"], v["n"], v["new"], v["retracted"], v["h"], *v["by"]) for v in out)


def conversation_event(conv, turn):
    c, h = zlib.crc32(str(conv).encode()), zlib.crc32(f"{conv}:{turn}".encode())
    g, at = h // 600, c // 2 % 7200 + 300 * turn + h % 600
    return 2 * (conv // 8) + c % 2, at // 1800 + (g % 4 if g % 5 == 0 else 0), at, h


def test_sessions_of_conversations(spark):
    talks = spark.read.parquet(f"{DATA}/conversations.parquet")
    odd = spark.createDataFrame([(-9, 3, "user", "x"), (-9, 3, "user", "x"), (4, None, "user", "y"), (None, 1, "user", "z"), (70, 2, None, None), (71, 250, "user", "")], talks.schema)
    every = talks.union(odd)
    want = sessions([conversation_event(r.conv_id, r.turn) for r in every.collect() if r.turn is not None and r.conv_id is not None], 240)
    assert sorted(map(tuple, late_sessions.of_conversations(every).collect())) == want
    assert {v[6] for v in want} >= {0, 1}


def test_sessions_of_one_user_with_most_events(spark):
    rnd = random.Random(5)
    events = [(1 if k % 3 else rnd.randint(2, 9), rnd.randint(0, 6), rnd.randint(-500, 6000), rnd.randint(0, 99)) for k in range(400)]
    events += events[:30] + [(7, 0, 0, 1), (7, 2, 480, 1), (7, 3, 240, 1), (7, 5, 241, 1)]
    frame = spark.createDataFrame([(*e, "x") for e in events], "user long, batch long, at_s long, h long, n string").union(spark.createDataFrame([(None, 1, 1, 1, ""), (3, None, 1, 1, ""), (3, 1, None, 1, "")], "user long, batch long, at_s long, h long, n string"))
    got = sorted(map(tuple, late_sessions.merged(frame, gap=60).collect()))
    assert got == sessions(events, 60)
    assert {v[6] for v in got} >= {0, 1, 2}
    # A user's rows that the state takes are cells of time, not events.
    assert late_sessions.cells_of(spark.createDataFrame([(1, 0, k % 50, 1) for k in range(5000)], "user long, batch long, at_s long, h long"), 60).count() == 1


def test_no_events_no_sessions(spark):
    found = late_sessions.of_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert found.count() == 0
    assert found.columns == ["user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracted_batch", "retracted_start_s"]


# Repeated lines


def key_of(line):
    return line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(helpers.LOWER)


def stripped(rows):
    """(doc_id, n_lines, n_dropped, text) of (doc_id, text)."""
    holders = defaultdict(set)
    order = lambda i: (i is None, 0 if i is None else i)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 10:
                holders[key_of(line)].add(i)
    keeper = {k: min(h, key=order) for k, h in holders.items() if len(h) > 1}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if keeper.get(key_of(x), i) == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


REPEATED = ["This line is held by many\nand this is not 1\n  THIS line is held by many \t\nshort\nshort", "this line is held by many\r\n\nshort\n0123456789\n\n", "0123456789\n012345678\n", "This line is held by many", "İSTANBUL ÄÖÜ ß line\nx", "i̇stanbul Äöü ß line\ny", "İSTANBUL ÄÖÜ ß LINE\n", "\n\n\n", "0123456789\n" * 50]


@pytest.mark.parametrize("shard_keys", [3, 1 << 20])
def test_lines_of_awkward_texts(spark, shard_keys):
    rnd = random.Random(2)
    pool = [f"a line of the pool with number {k}" for k in range(40)] + ["", "x", " \t"]
    texts = helpers.AWKWARD + REPEATED + ["\n".join(rnd.choices(pool, k=rnd.randint(0, 30))) for _ in range(60)] + ["the hot line of all\nown %d line here" % k for k in range(50)]
    ids = list(range(100, 100 + len(texts)))
    ids[3] = ids[4] = None
    ids[-1] = ids[-2] = ids[-3]
    got = sorted(map(tuple, line_dedup.without_repeats(table(spark, texts, ids), shard_keys=shard_keys).collect()), key=repr)
    assert got == stripped(list(zip(ids, texts, strict=True)))


def test_lines_of_unknown_and_of_named_documents(spark):
    rows = [("b", "a line that two share\none of b"), ("a", "A line that two share"), (None, "a line that two share\nonly unknown ones"), (None, "only unknown ones"), ("", "x")]
    got = line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == stripped(rows)
    assert line_dedup.without_repeats(table(spark, [])).count() == 0


def test_perfect_hash():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 1000, 50_000):
        first, second = (rnd.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
        first[n // 2 :] = 7  # one half of the hash may repeat
        made = line_dedup.PerfectHash.of(first, second)
        assert sorted(made.slots(first, second).tolist()) == list(range(n))
        assert len(made.words) * 64 < 6 * n + 700
        own = line_dedup.Shard(*line_dedup.Shard.row(first, second, np.arange(n) % 3, np.arange(n)))
        several, keeper = own.repeated(first, second)
        assert several.tolist() == [k % 3 == 2 for k in range(n)]
        assert keeper.tolist() == [k for k in range(n) if k % 3 == 2]
        assert own.repeated(first + np.uint64(1), second ^ np.uint64(1 << 40))[0].sum() <= 1


def test_line_dedup_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in stripped([(r.doc_id, r.text) for r in docs]))
    assert sorted(map(tuple, queries.op12_line_dedup(spark, DATA).collect())) == want


# Filter audit


def fails(text):
    w = helpers.words(text)
    rules = len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text)
    return {f for f, r in zip("ABCD", rules, strict=True) if r}


def audited(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({i for i, *flags in labels if flags[k] == 1 and i is not None} for k in (0, 1))
    docs = [(s or "", fails(t or "") | ({"E"} if i is not None and i > least[t or ""] else set()), i in good, i in toxic) for i, t, s in rows]
    out, share = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                hit = [d for d in left if f in d[1]]
                every = [d for d in docs if d[0] == part and f in d[1]]
                left = [d for d in left if f not in d[1]]
                out[part, order, step] = [len(left), len(hit), len(every) - len(hit), sum(d[1] == {f} for d in every), sum(d[2] for d in hit), sum(d[3] for d in hit)]
                share[part, f] += len(hit)
    return sorted((*k, *v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def nothing(text):
    """A hash that tells no texts apart."""
    return F.array(F.lit(0).cast("long"))


@pytest.mark.parametrize("hashes", [filter_audit.block_hashes, nothing])
def test_audit_of_awkward_texts(spark, hashes):
    rnd = random.Random(4)
    texts = helpers.AWKWARD + ["".join(rnd.choice("aAb #\n") for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    texts += ["w" * 70 + "x", "w" * 70 + "y", "w" * 70 + "x", " ".join(f"word{k}" for k in range(250)), " ".join(f"word{k}" for k in range(250))] + ["copy of the hot text"] * 40
    texts += [t * 9 for t in ("abcdefgh" * 10, "abcdefgh" * 10, "abcdefgx" * 10)] + ["a" * 600 + "b", "a" * 600 + "c"]
    ids = list(range(len(texts)))[::-1]
    ids[0] = ids[1] = None
    ids[-1] = ids[-2]
    ids[20:26] = [77] * 6
    sources = [rnd.choice(["a", "b", None, ""]) for _ in texts]
    labels = [(k, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for k in range(0, len(texts), 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (10_000, 1, 1)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.interactions(table(spark, texts, ids, sources), told, hashes)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == audited(list(zip(ids, texts, sources, strict=True)), labels)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(table(spark, []), labels).count() == 0
    found = filter_audit.interactions(table(spark, ["a", "a", "b"]), labels).filter("filter_order = 'EABCD' and step = 1").first()
    assert tuple(found)[3:] == (2, 1, 0, 0, 0, 0, 60)
