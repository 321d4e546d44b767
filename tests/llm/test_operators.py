"""The ten operators against brute force, on driver tables and on awkward ones."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import helpers
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import exact_dedup, language_model, licenses, mixing, near_dedup, personal_data, pieces, quality, queries, revisits, shared, token_counts

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, kept int, size string"


def table(spark, texts, ids=None, sources=None):
    """Documents with extra columns whose names clash with results."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["a"] * len(texts) if sources is None else sources
    rows = [(i, t, "en", s, None, "x", 7, "y") for i, t, s in zip(ids, texts, sources, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def fuzz(n, alphabet, longest, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


def test_filters_keep_columns_of_any_name(spark):
    """Names with dots, and names that operators use themselves."""
    names = ["doc_id", "text", "lang", "source", "n_chars", "_own_id", "a.b", "_own_n_words", "keep_id", "size", "_own_source"]
    given = [(k, f"{'word ' if k % 2 else 'other '} text of many words that number {k // 2} repeats here now", "en", "s", 1, "i", "d", 7, "k", "z", "o") for k in range(6)]
    frame = spark.createDataFrame(given, names)
    for kept in (quality.good_documents(frame), exact_dedup.kept_documents(frame), near_dedup.distinct_documents(frame), mixing.mixed_documents(frame)):
        assert kept.columns == names
        assert {tuple(r) for r in kept.collect()} <= set(given)


# Token counts


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    every = [*helpers.AWKWARD, *texts.values(), *fuzz(400, "aA bé'sİΣ1<|endoftext|>  ́\n\t\u0085中", 60, 1)]
    got = {r.doc_id: r for r in token_counts.count_tokens(table(spark, every), path, limit=50).collect()}
    for k, text in enumerate(every):
        n = len(own.encode(text or "", add_special_tokens=False))
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((text or "").encode()), n, n > 50)
    assert token_counts.count_tokens(table(spark, []), path).count() == 0
    assert token_counts.count_tokens(table(spark, ["a b"] * 2, [None, None]), path).count() == 2


def test_token_counts_of_long_words():
    """Texts without white space are split only where no token reaches over."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    rnd = random.Random(13)
    every = ["".join(rnd.choice("abcXYZ0123.,;:()[]{}!?'sdtm<|>\u0338\u0301éΣσ中") for _ in range(n)) for n in (10, 300, 70_000, 200_000)]
    every += ["abc1<|endoftext|>def'll.<|startoftext|>" * 3000, "7" * 1_000_000, "a" * 1_000_000, "<|endoftext|>" * 9000]
    got = token_counts.word_lengths(path, pa.array(every))
    assert got.tolist() == [len(own.encode(t, add_special_tokens=False)) for t in every]
    assert token_counts.pieces_of("a" * 200 + "1" + "b" * 200, 100) == ["a" * 200, "1" + "b" * 200] or token_counts.pieces_of("a" * 200 + "1" + "b" * 200, 100) == ["a" * 200, "1", "b" * 200]


def test_templates_in_parts(spark, texts, monkeypatch):
    """More templates than a worker holds at once give the same rows."""
    every = [*texts.values()][:60] + list(licenses.TEMPLATES.values()) + ["x " * 30 + t for t in licenses.TEMPLATES.values()]
    docs = table(spark, every)
    whole = sorted(map(tuple, licenses.scan(docs).collect()))
    monkeypatch.setattr(licenses, "MOST_TEMPLATES", 900)
    parts = licenses._parts(licenses.TEMPLATES, 900)
    assert len(parts) > 3 and [p for part in parts for p in part] == list(licenses.TEMPLATES.items())
    assert sorted(map(tuple, licenses.scan(docs).collect())) == whole and len(whole) >= 2 * len(licenses.TEMPLATES)


def test_token_counts_of_another_tokenizer(spark, texts):
    """One whose tokens hold white space is told from the file, and texts are encoded whole."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.parts_at_space(public_tokenizers.path("word_bpe_49k.json")) and not token_counts.parts_at_space(path)
    own = Tokenizer.from_file(path)
    every = [*helpers.AWKWARD, *[*texts.values()][:40], *fuzz(100, "aA bé's1<|endoftext|>  \n\t中", 60, 1)]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table(spark, every), path).collect()}
    assert got == {k: len(own.encode(t or "", add_special_tokens=False)) for k, t in enumerate(every)}


# SentencePiece


def test_pieces_of_very_long_texts():
    """Each in linear time: a million spaces, letters, digits, characters that are no piece."""
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, model = pieces.piece_table(path), SentencePieceProcessor(model_file=path)
    for text in (" " * 1_000_000, "x" + " " * 1_000_001 + "y", "a" * 300_000, "7" * 300_000, "\U0001f600" * 100_000, "word " * 200_000):
        assert own.encode(text) == model.encode(text), text[:3]


def test_pieces_equal_the_library():
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, model = pieces.piece_table(path), SentencePieceProcessor(model_file=path)
    every = [t or "" for t in helpers.AWKWARD]
    every += fuzz(3000, "aaabcde  \n\t\r▁é中\U0001f600\x00'\"(){};.,:/*-=0123theinß", 60, 2) + [" " * n for n in range(100)] + ["x" + " " * n + "\r" for n in range(40)]
    offsets, ids = own.encode_all(pa.array(every))
    decoded = list(own.decode_bytes(offsets, ids))
    for k, (text, want) in enumerate(zip(every, model.encode(every, num_threads=1), strict=True)):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == want, text
        assert decoded[k].decode() == model.decode(want)
    rnd = random.Random(4)
    for _ in range(500):
        listed = [rnd.randint(3, 600) for _ in range(rnd.randint(0, 12))]
        assert own.decode(listed) == model.decode(listed)


def test_encode_decode_digests(spark, docs, texts):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    every = [*helpers.AWKWARD, *texts.values()]
    got = {r.doc_id: r for r in pieces.encode_decode(table(spark, every), path, ("n_tokens", "ids", "ids_sha256", "decoded_sha256", "decoded")).collect()}
    for k, text in enumerate(every):
        ids = model.encode(text or "")
        assert got[k].ids == ids and got[k].n_tokens == len(ids) and got[k].decoded == model.decode(ids)
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    assert pieces.encode_decode(table(spark, []), path).count() == 0


# Quality rules


def test_quality_ledger(spark, texts):
    every = [*helpers.AWKWARD, *texts.values(), *fuzz(300, "ab! #|\n", 80, 5), "x y z v w " * 4, "a\n a\na\n\n\n"]
    got = {r.doc_id: r for r in quality.verdicts(quality.ledger(table(spark, every))).collect()}
    for k, text in enumerate(every):
        want = helpers.quality(text)
        assert {m: got[k][m] for m in quality.MEASURES} == want, text
        assert got[k].kept == helpers.good(text)
        assert got[k].base_failed == (want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"])
    assert quality.ledger(table(spark, [])).count() == 0
    kept = quality.good_documents(table(spark, every))
    assert kept.columns == table(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {k for k, t in enumerate(every) if helpers.good(t)}


def test_ledger_is_stored_and_policies_are_named(spark, texts):
    """One stored ledger serves every policy; its rows say which was applied."""
    rows = quality.stored(table(spark, [*helpers.AWKWARD, "! " * 40 + "words of a text that shouts but is long enough to stay otherwise"]))
    assert rows.inputFiles()
    for policy, mask in quality.POLICIES.items():
        for r in quality.verdicts(rows, policy).collect():
            assert r.policy == policy and r.kept == (r.failed & (mask | quality.BASE) == 0)
        assert {r.rule for r in quality.ablations(rows, policy).collect()} == {n for n, b in quality.BIT.items() if b & mask}


def test_ablations(spark, texts):
    rows = quality.ledger(table(spark, list(texts.values())))
    failed = [r.failed for r in rows.collect()]
    for r in quality.ablations(rows).collect():
        bit = quality.BIT[r.rule]
        assert r.n_failed == sum(bool(f & bit) for f in failed)
        assert r.n_failed_alone == sum(f == bit for f in failed)
        assert r.n_kept_without == sum(f & ~bit == 0 for f in failed)


# Exact dedup


def _kept(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i))
    return {k: (min(v, key=lambda x: (x[0], x[1], x[2] or 0))[2], len(v)) for k, v in groups.items()}


def test_exact_dedup(spark, texts):
    every = [*helpers.AWKWARD, *helpers.AWKWARD, *texts.values(), "abc", "a b c", "ab c", " a bc"]
    ids = [None if k == 3 else k for k in range(len(every))]
    want = _kept(list(zip(ids, every, strict=True)))
    got = exact_dedup.deduplicate(table(spark, every, ids)).collect()
    assert len(got) == len(every)
    by_id = {r.doc_id: r for r in got}
    for i, t in zip(ids, every, strict=True):
        plain = re.sub("[\x20\x09-\x0d]", "", t or "")
        r = by_id[i]
        assert (r.keep_id, r.group_size) == want[plain]
        assert r.kept == (r.keep_id == i) and r.text_sha256 == hashlib.sha256(plain.encode()).hexdigest()
    stay = exact_dedup.kept_documents(table(spark, every, ids).union(table(spark, every, ids)))
    assert sorted(r.doc_id for r in stay.collect()) == sorted(k for k, _ in want.values())
    assert stay.columns == table(spark, []).columns
    assert exact_dedup.deduplicate(table(spark, [])).count() == 0


def test_exact_dedup_with_ids_of_any_type_and_many_runs(spark):
    rnd = random.Random(3)
    given = [(rnd.choice(["x", "y", "é", "", None, "10", "9"]), " " * rnd.randint(0, 3) + rnd.choice("abcdefgh") * rnd.randint(0, 2)) for _ in range(400)]
    want = {}
    for i, t in given:
        plain, now = t.strip(" "), (-len(t), i is None, (i or "").encode(), i)
        best, n = want.get(plain, (now, 0))
        want[plain] = (min(best, now, key=lambda x: x[:3]), n + 1)
    for parts in (1, 7, 70):
        frame = spark.createDataFrame(given, "doc_id string, text string").repartition(parts)
        got = exact_dedup.deduplicate(frame).collect()
        by = {hashlib.sha256(k.encode()).hexdigest(): (b[3], n) for k, (b, n) in want.items()}
        assert len(got) == 400 and all((r.keep_id, r.group_size) == by[r.text_sha256] for r in got)
        kept = Counter((r.doc_id, r.text.strip(" "), len(r.text)) for r in exact_dedup.kept_documents(frame).collect())
        assert kept == Counter((b[3], k, -b[0]) for k, (b, _) in want.items())


def test_a_digest_is_no_proof(spark):
    """Rows whose digests agree meet only if the length and the second hash do, too."""
    rows = spark.createDataFrame([(k, 1, "ab" * 32, 1 + k % 2, k // 2 % 2, k % 5) for k in range(20)], "id long, n_chars int, text_sha256 string, n_bytes int, check long, run int")
    got = {(r.n_bytes, r.check): (r.keep_id, r.group_size) for r in exact_dedup.merge_runs(rows, 2).collect()}
    assert got == {(1, 0): (0, 5), (2, 0): (1, 5), (1, 1): (2, 5), (2, 1): (3, 5)}


# Near-dedup


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(spark, texts, size, percent):
    rnd = random.Random(6)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(120)]
    copies = []
    for _ in range(60):  # copies of copies, some within reach only of each other
        own = list(rnd.choice([base, *copies[-5:]]))
        for _ in range(rnd.randint(0, 4)):
            own[rnd.randrange(len(own))] = f"x{rnd.randint(0, 10**6)}"
        copies.append(own)
    every = [*helpers.AWKWARD, *texts.values(), *map(" ".join, copies), "one TWO three", "One two"]
    found = {r.doc_id: r for r in near_dedup.near_components(table(spark, every), size, percent).collect()}
    want = helpers.near_groups(dict(enumerate(every)), size, percent)
    assert {k: r.component_id for k, r in found.items()} == want
    for k, r in found.items():
        assert r.n_shingles == len(helpers.shingles(every[k], size)) and r.kept == (want[k] == k)
    stay = near_dedup.distinct_documents(table(spark, every), size, percent)
    assert sorted(r.doc_id for r in stay.collect()) == sorted(set(want.values()))
    assert near_dedup.near_components(table(spark, []), size, percent).count() == 0


def test_near_dedup_large_regions_and_components(spark, monkeypatch):
    """Regions and components beyond their limits are split and still joined."""
    rnd = random.Random(8)
    base = [f"w{k}" for k in range(200)]
    every = []
    for _ in range(80):
        own = list(base)
        own[rnd.randrange(200)] = f"x{rnd.random()}"
        every.append(" ".join(own))
    every += ["something else entirely with other words here", None]
    monkeypatch.setattr(near_dedup, "UNIT_SHINGLES", 500)
    monkeypatch.setattr(near_dedup, "REGION", 30)
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(table(spark, every), 3, 85).collect()}
    assert got == helpers.near_groups(dict(enumerate(every)), 3, 85)


def _hanging(rnd):
    """100 near copies of a text, and 40 texts that one link each, near the threshold, joins to them."""
    every = []
    for _ in range(100):
        own = [f"w{k}" for k in range(200)]
        for at in rnd.sample(range(200), 2):
            own[at] = f"x{rnd.random()}"
        every.append(own)
    for own in [list(x) for x in every[:40]]:
        for at in rnd.sample([k for k in range(200) if own[k][0] == "w"], 5):
            own[at] = f"y{rnd.random()}"
        every.append(own)
    return list(map(" ".join, every))


def test_near_dedup_single_links_of_a_crowded_region(spark, monkeypatch):
    every = _hanging(random.Random(12))
    monkeypatch.setattr(near_dedup, "REGION", 10)
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(table(spark, every), 3, 85).collect()}
    assert got == helpers.near_groups(dict(enumerate(every)), 3, 85)


def test_near_dedup_finds_clean_pairs_among_noisy_copies(spark, monkeypatch):
    """Pairs whose common part a whole crowd shares, while none of the crowd is linked with anything."""
    rnd = random.Random(1)
    every, pairs = [], []
    for t in range(8):
        base = [f"t{t}w{k}" for k in range(200)]
        for _ in range(90):
            own = list(base)
            for at in rnd.sample(range(200), 12):
                own[at] = f"x{rnd.random()}"
            every.append(" ".join(own))
        near = list(base)
        for k in range(5):
            near[10 + 30 * k] = f"y{t}{k}"
        pairs.append((len(every), len(every) + 1))
        every += [" ".join(base), " ".join(near)]
    monkeypatch.setattr(near_dedup, "REGION", 6)
    monkeypatch.setattr(near_dedup, "UNIT_SHINGLES", 5000)
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(table(spark, every).repartition(4), 3, 85).collect()}
    assert [got[a] == got[b] for a, b in pairs] == [True] * 8 and got == helpers.near_groups(dict(enumerate(every)), 3, 85)


def test_near_dedup_keeps_texts_that_share_only_a_short_prefix_with_a_crowd(spark, monkeypatch):
    """Every second five values of the last signature are the crowd's, so no two trees' starts in a row are."""
    import numpy as np

    crowd = np.arange(160, dtype=np.uint32)
    edge = np.where(np.arange(160) // 5 % 2 == 0, crowd, crowd + 1000).astype(np.uint32)
    rows = [(k, crowd.tobytes()) for k in range(60)] + [(60, edge.tobytes()), (61, (crowd + 5000).astype(np.uint32).tobytes())]
    signed = spark.createDataFrame(rows, "node long, signature binary")
    monkeypatch.setattr(near_dedup, "REGION", 10)
    assert {r.node for r in near_dedup._regions(signed).collect()} == set(range(61))
    assert {r.node: r.group for r in near_dedup._groups(signed, 50).collect()} == dict.fromkeys(range(61), 0)


def test_near_dedup_large_components_are_compared_whole(spark, monkeypatch):
    """Texts whose only link is to one that the likely forest joins in another way, at a similarity that regions miss."""
    rnd = random.Random(3)
    every = [[f"w{k}" for k in range(100)] for _ in range(60)]
    for own in every:
        for at in rnd.sample(range(100), 21):
            own[at] = f"x{rnd.random()}"
    every = list(map(" ".join, every))
    want = helpers.near_groups(dict(enumerate(every)), 1, 50)
    assert 1 < len(set(want.values())) < 60
    monkeypatch.setattr(near_dedup, "UNIT_SHINGLES", 700)
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(table(spark, every), 1, 50).collect()}
    assert got == want


def test_near_dedup_null_ids_and_repeats(spark):
    text = "the same text of more than a few words in all"
    rows = near_dedup.near_components(table(spark, [text, text, text, "x y z"], [5, 5, None, None]), 3, 85).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (-1, 5, False), (5, 5, True), (5, 5, True)]


def test_near_dedup_links_the_rows_of_one_id(spark):
    """(5, a) is a copy of (3, a), and (5, b) is like nothing else: 5 is one document with both texts."""
    a, b = "one text of quite a few words here", "some other words that nothing else has at all"
    frame = table(spark, [a, a, b, "", b + " x"], [3, 5, 5, 5, 9])
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_components(frame, 3, 85).collect())
    assert [(i, c, k) for i, _, c, k in got] == [(3, 3, True), (5, 3, False), (5, 3, False), (5, 3, False), (9, 3, False)]
    assert [r.doc_id for r in near_dedup.distinct_documents(frame, 3, 85).collect()] == [3]


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(300) if k != 150] + [(9, 9)], "a long, b long")
    got = {r.id: r.component for r in shared.components(path).collect()}
    assert got == {k: 0 if k <= 150 else 151 for k in range(301)}


# Mixing


def _targets(sizes, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            target.update({s: left * weight[s] / total for s in open_})
            break
        for s in full:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def test_mixing(spark, docs, texts):
    sources = [None, "b", "ä", "a", "Z", ""]
    every = [*helpers.AWKWARD, *texts.values()]
    given = [sources[(k * k) % 6] for k in range(len(every))]
    frame = table(spark, every, None, given)
    got = {r.doc_id: r for r in mixing.mix(frame).collect()}
    sizes = Counter()
    for t, s in zip(every, given, strict=True):
        sizes[s] += len(helpers.words(t))
    want = _targets(sizes)
    for k, (t, s) in enumerate(zip(every, given, strict=True)):
        r = got[k]
        assert r["size"] == len(helpers.words(t)) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s], rel=1e-9)
        rate = r.target / sizes[s] if sizes[s] else 0
        assert r.taken in {math.floor(rate) * r["size"], (math.floor(rate) + 1) * r["size"]} and r.taken <= 2 * r["size"]
    copies = Counter(r.doc_id for r in mixing.mixed_documents(frame).collect())
    assert copies == Counter({k: r.copies for k, r in got.items() if r.copies})
    assert mixing.mixed_documents(frame).columns == frame.columns
    assert mixing.mix(table(spark, [])).count() == 0
    assert [r.target for r in mixing.mix(table(spark, [None, ""])).collect()] == [0.0, 0.0]


def test_mix_comes_near_its_targets(spark):
    frame = spark.range(30000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    for r in mixing.mix(frame).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.03)


# Language model


def _quantised(n):
    level = 1 + math.floor(math.log(n) / math.log(language_model.BASE) + 1e-9) if n else 0
    inside = [x for x in range(1, 3 * n + 3) if 1 + math.floor(math.log(x) / math.log(language_model.BASE) + 1e-9) == level]
    return sum(inside) / len(inside) if n else 0


def _trigram_scores(tokens, training, head):
    """Each text's log10 probability by counts in plain dictionaries; head: words whose counts are exact."""
    one, two, three = Counter(), Counter(), Counter()
    for k in training:
        ws = ["", *tokens[k]]
        one.update(tokens[k])
        two.update(zip(ws, ws[1:]))  # noqa: B905
        three.update(zip(ws, ws[1:], ws[2:]))  # noqa: B905
    n, v = sum(one.values()), len(one)
    magnitude = lambda w: 1 + int(math.log2(one[w])) if w in head else 0
    stats = defaultdict(lambda: [0, 0, 0, 0])
    for (h, _), c in two.items():
        s = stats[magnitude(h)]
        s[0], s[1], s[2], s[3] = s[0] + 1, s[1] + (c == 1), s[2] + (c == 2), s[3] + c
    discount = {m: min(0.999, s[1] / (s[1] + 2 * s[2])) if s[1] else 0.5 for m, s in stats.items()}
    share = {m: discount[m] * s[0] / s[3] for m, s in stats.items()}
    exact = lambda w: one[w] if w in head or not one[w] else _quantised(one[w])
    out = []
    for own in tokens:
        ws, total = ["", *own], 0.0
        for k in range(1, len(ws)):
            h, w = ws[k - 1], ws[k]
            c, size, m = _quantised(two[h, w]), exact(h), magnitude(h)
            p = max(c - discount.get(m, 0.0), 0) / max(size, c, 1) + (share.get(m, 1.0) if size else 1) * (exact(w) + 0.5) / (n + 0.5 * (v + 1))
            p = min(p, 1)
            times = _quantised(two[ws[k - 2], h]) if k > 1 else 0
            if times >= 2:
                t = three[ws[k - 2], h, w]
                p = ((min(1 + _quantised(t - 1), times) if t > 1 else 0) + language_model.PRIOR * p) / (times + language_model.PRIOR)
            total += math.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize(("head", "broadcast"), [(1 << 20, 96 << 20), (1 << 20, 0), (40, 96 << 20), (40, 0)])
def test_language_model(spark, texts, monkeypatch, head, broadcast):
    """All columns by brute force, with counts exact or in the filter, and the filter broadcast or asked."""
    monkeypatch.setattr(language_model, "HEAD", head)
    monkeypatch.setattr(language_model, "SEGMENT", 5000)
    every = [*helpers.AWKWARD, *texts.values()]
    got = {r.doc_id: r for r in language_model.score(table(spark, every), broadcast, probes=50).collect()}  # so many that none errs
    tokens = [[*helpers.words((t or "").translate(helpers.LOWER)), ""] for t in every]
    training = [k for k in range(len(every)) if not helpers.held_out(k)]
    c = Counter(w for k in training for w in tokens[k])
    n, v = sum(c.values()), len(c)
    least = next((x for x in sorted(set(c.values())) if sum(y >= x and len(w.encode()) <= 64 for w, y in c.items()) <= head), None)
    want = _trigram_scores(tokens, training, {w for w, y in c.items() if y >= least and len(w.encode()) <= 64})
    score = base = 0.0
    for k, ws in enumerate(tokens):
        r = got[k]
        own = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (helpers.held_out(k), len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(own, rel=1e-9) and r.score <= 0
        assert r.score == pytest.approx(want[k], rel=1e-6, abs=1e-6), every[k]
        assert r.score_per_token == pytest.approx(r.score / len(ws))
        score, base = (score + r.score, base + own) if r.held_out else (score, base)
    assert score > base  # held-out texts are likelier than by words alone


def test_counts_beside_keys():
    import numpy as np

    keys, n = np.array([5, 1 << 60 | 7, 1 << 63 | 9, 11], np.uint64), np.array([1, 2, 200_000, 1])
    once, more = language_model._packed(keys, n)
    back, counts = language_model._unpacked([once, once], [more])
    assert dict(zip(back.tolist(), counts.tolist(), strict=True)) == {5: 2, 7: 2, 9: 200_000, 11: 2}
    assert [len(x) for x in language_model._unpacked([], [])] == [0, 0]


def test_what_is_asked_equals_what_is_broadcast(spark, texts, monkeypatch):
    """With the filter's own errors, and nulls, repeats and long texts."""
    monkeypatch.setattr(language_model, "SEGMENT", 3000)
    frame = table(spark, [*helpers.AWKWARD, *texts.values()] * 2, [None, *range(len(texts) + len(helpers.AWKWARD) - 1)] * 2).repartition(3)
    rows = [sorted((r.doc_id or -1, r.n_tokens, round(r.score, 6)) for r in language_model.score(frame, b).collect()) for b in (1 << 30, 0)]
    assert rows[0] == rows[1]


def test_what_is_asked_in_parts_and_by_a_filter_found_too_large(spark, texts, monkeypatch):
    """Slices that several tasks read ask in parts; a filter that turns out too large to broadcast is asked."""
    monkeypatch.setattr(language_model, "SEGMENT", 3000)
    frame = table(spark, [*helpers.AWKWARD, *texts.values()] * 2).repartition(2)
    rows = lambda bound: sorted((r.doc_id, r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in language_model.score(frame, bound).collect())
    want = rows(1 << 30)
    names = {"parquet.block.size": "20000", "parquet.page.size": "5000", "spark.sql.files.maxPartitionBytes": "30000", "spark.sql.files.openCostInBytes": "0"}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        assert rows(0) == want
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    monkeypatch.setattr(language_model, "TOKEN_BYTES", 0)
    assert rows(0) == want


@pytest.mark.parametrize(("segments", "n_texts"), [(3, 120), (1 << 17, 6)])
def test_segments_tell_what_the_filter_tells(texts, monkeypatch, segments, n_texts):
    """Levels of all keys, of texts held out too, by as many probes whatever the number of slices."""
    from types import SimpleNamespace

    import numpy as np

    probed, probes = [], language_model._probes
    monkeypatch.setattr(language_model, "_probes", lambda keys, level: (probed.append(len(keys)), probes(keys, level))[1])
    every = ["to be or not to be " * 200, *texts.values(), "to be or not to be " * 9][-n_texts:]
    every[0] = "to be or not to be " * 200
    head = SimpleNamespace(value=language_model.Head(pa.array(["the", "to"]), np.array([500, 300])))

    def run(slices):
        of = np.sort(np.arange(len(every)) % slices)
        rows = pa.RecordBatch.from_pydict({"slice": of, "row": np.arange(len(every)), "held": [helpers.held_out(k) for k in range(len(every))], "text": pa.array(every)})
        asked = pa.Table.from_batches(language_model._ask([rows], head, False, segments)).sort_by("segment")
        probed.clear()
        told = pa.Table.from_batches(language_model._tell(asked.to_batches(), 6))
        return {(r["slice"], r["segment"]): r["levels"] for r in told.to_pylist() if r["slice"] is not None}, told.filter(pa.compute.is_null(told["slice"])).num_rows, len(probed), of

    levels, stats, calls, of = run(n_texts // 2)
    counts = Counter()
    for k, text in enumerate(every):
        if not helpers.held_out(k):
            read = language_model.Read.of(pa.array([text]), head.value, False)
            counts.update([*read.pairs.tolist(), *read.triples.tolist()])
            counts.update(dict(zip(read.words.tolist(), np.bincount(read.tokens.codes)[read.exact < 0].tolist(), strict=True)))
    keys = np.sort(np.array(list(counts), np.uint64))
    given = pa.Table.from_batches(language_model._given_out(keys, np.array([counts[k] for k in keys.tolist()]), segments))
    filter = language_model.Filter(segments, pa.Table.from_batches(language_model._build(given.to_batches(), 6)), 6)
    for k in range(n_texts // 2):
        each = language_model.Read.each(pa.array([t for t, s in zip(every, of, strict=True) if s == k]), head.value, False)
        all_keys = np.concatenate([x for r in each for x in (r.pairs, r.triples, r.words)])
        placed, order, starts = language_model._distinct(language_model._placed(each, segments))
        mine = b"".join(levels[k, s] for s in sorted(s for j, s in levels if j == k))
        assert len(mine) == len(placed)
        assert (language_model._spread(np.frombuffer(mine, np.uint8), order, starts) == filter.levels(all_keys)).all()
    assert max(counts.values()) > 255 and stats == len({s for _, s in levels})
    assert calls <= run(1)[2] * 1.1


def test_cut_slices():
    rows = [pa.RecordBatch.from_pydict({"row": pa.array(range(k, k + 5)), "text": pa.array(["x" * 12, None, "", "x" * 90, "x" * 12])}) for k in (0, 5, 10)]
    assert pa.Table.from_batches(language_model._cut(rows, 100))["slice"].to_pylist() == [0, 0, 0, 3, 4, 4, 4, 4, 8, 9, 9, 9, 9, 13, 14]
    assert [len(x) for x in ([*language_model._cut([], 5)], [*language_model._cut([rows[0].slice(0, 0)], 5)][0])] == [0, 0]


def test_language_model_of_nothing(spark):
    assert language_model.score(table(spark, [])).count() == 0
    only = language_model.score(table(spark, ["a b"], [next(k for k in range(50) if helpers.held_out(k))])).collect()
    assert (only[0].train_tokens, only[0].n_known, only[0].n_tokens) == (0, 0, 3)


def test_word_hashes_are_distinct_and_agree(texts):
    import numpy as np

    every = sorted({w for t in texts.values() for w in helpers.words(t)} | {"a", "b", "ab", "ba", "", "aa", "a" * 3_000_000, "b" * 1_100_000, "é", "中"})
    found = language_model._hashes(pa.array(every))
    assert found.dtype == np.uint64 and len(np.unique(found)) == len(every)
    assert (language_model._hashes(pa.array(every[7:90])) == found[7:90]).all()
    assert (language_model._hashes(pa.array(every).slice(7, 83)) == found[7:90]).all()


def test_pairs_are_told_apart(spark):
    """A pair that was learned often is likelier than one of words as frequent that was not."""
    train = [k for k in range(400) if not helpers.held_out(k)][:300]
    test = [k for k in range(400, 500) if helpers.held_out(k)][:2]
    texts = ["north star west wind" if k % 2 else "west wind north star" for k in train] + ["north star", "north wind"]
    got = {r.doc_id: r for r in language_model.score(table(spark, texts, train + test)).collect()}
    assert got[test[0]].base_score == pytest.approx(got[test[1]].base_score)
    assert got[test[0]].score > got[test[1]].score + 1


def test_quantised_counts():
    import numpy as np

    n = np.arange(1, 5000)
    assert (abs(language_model.count_of(language_model.level_of(n)) / n - 1) < 0.25).all()
    assert language_model.count_of(language_model.level_of(np.array([1, 2, 3]))).tolist() == [1, 2, 3]


# License scans


def _shares(text):
    norm = [re.sub(r"^\W+|\W+$", "", w) for w in helpers.words((text or "").translate(helpers.LOWER))]
    got = [tuple(norm[k : k + 5]) for k in range(len(norm) - 4)]
    out = {}
    for name, template in licenses.TEMPLATES.items():
        t = [re.sub(r"^\W+|\W+$", "", w) for w in helpers.words(template.translate(helpers.LOWER))]
        wanted = {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
        span = 2 * len(wanted)
        best = max((len(wanted & set(got[k : k + span])) / len(wanted) for k in range(len(got))), default=0)
        if best >= 0.8:
            out[name] = best
    return out


def _windows_of(text, templates):
    """(license, containment, first_word, last_word, n_windows) of one text, by plain loops over its windows."""
    import numpy as np

    _, found, valid = licenses.shingles(pa.array([text]))
    own = [int(x) if ok else None for x, ok in zip(found, valid, strict=True)]
    least = lambda xs: [min(((x >> 32) * int(f)) % (1 << 32) for x in xs) if xs else None for f in licenses._factors()]
    for name, template in templates.items():
        _, t, ok = licenses.shingles(pa.array([template]))
        wanted = {int(x) for x in t[ok]}
        size = 1
        while size < 1.25 * len(wanted):
            size *= 2
        bands, best, n = least(wanted), None, 0
        for at in range(0, len(own), size):
            inside = [x for x in own[at : at + 2 * size] if x is not None]
            if not any(a == b for a, b in zip(least(inside), bands, strict=True)):
                continue
            begin = max(0, at - size)
            places = [k for k in range(begin, min(len(own), at + 3 * size)) if own[k] in wanted]
            share = len({own[k] for k in places}) / len(wanted)
            if share >= 0.8:
                n += 1
                if best is None or share > best[0]:
                    best = share, places[0], places[-1] + 4
        if best:
            yield name, *best, n


def test_license_scan_columns_do_not_depend_on_neighbours(spark):
    """All columns, ties too, of a text that stands among others of any number and length."""
    rnd = random.Random(2)
    templates = {k: licenses.TEMPLATES[k] for k in ("MIT (short)", "MIT", "GPL-3.0")} | {"twice": "a b c d e f a b c d e f"}
    texts = ["a b c d e f a b c d e f " * 9, "", None, "x " * 700 + licenses.TEMPLATES["MIT"], (licenses.TEMPLATES["MIT"] + " y ") * 3]
    for _ in range(12):
        texts.append("n " * rnd.randint(0, 90) + licenses.TEMPLATES[rnd.choice(["MIT (short)", "GPL-3.0"])] + " m" * rnd.randint(0, 90))
    want = {t: sorted(_windows_of(t, templates)) for t in texts if t}
    for _ in range(3):
        rnd.shuffle(texts)
        got = defaultdict(list)
        for r in licenses.scan(table(spark, texts).coalesce(1), templates).collect():
            got[texts[r.doc_id]].append((r.license, r.containment, r.first_word, r.last_word, r.n_windows))
        assert {t: sorted(v) for t, v in got.items()} == {t: v for t, v in want.items() if v}


def test_license_scan(spark, texts):
    rnd = random.Random(9)
    every = [*helpers.AWKWARD, *texts.values(), *licenses.TEMPLATES.values()]
    for template in licenses.TEMPLATES.values():
        w = template.split()
        pad = [f"p{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 300))]
        every.append(" ".join([*pad, *w, *pad]))
        w[len(w) // 2] = "changed"
        every.append(" ".join([*pad, *w]).upper())
    got = defaultdict(dict)
    for r in licenses.scan(table(spark, every)).collect():
        got[r.doc_id][r.license] = r.containment
    want = {k: s for k, t in enumerate(every) if (s := _shares(t))}
    assert set(got) == set(want)
    for k, shares in want.items():
        assert got[k] == pytest.approx(shares)
    assert licenses.scan(table(spark, [])).count() == 0
    with pytest.raises(ValueError, match="fewer than 5 words"):
        licenses.Index({"short": "three words only"})


# Personal data


def test_personal_data(spark, texts):
    every = [*helpers.AWKWARD, *texts.values(), "a@b.c_x@y.z 1.2.3.4.5.6.7.8 999.1.1.1 +1 (555) 123-4567 4111 1111 1111 1111"]
    every += fuzz(800, "ab1234567890..@@--++()  %_é\U0001f600\n", 80, 3)
    got = {r.doc_id: r for r in personal_data.find(table(spark, every)).collect()}
    for k, text in enumerate(every):
        want = helpers.private(text)
        told = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        assert [got[k][f"n_{a}"] for a, _ in helpers.KINDS] == [sum(x[0] == a for x in want) for a, _ in helpers.KINDS]
        assert got[k].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) - {""} <= set(got[k].spans.split(",")) and got[k].n_spans == len(got[k].spans.split(",")) - (got[k].spans == "")
    assert personal_data.find(table(spark, [])).count() == 0


def test_personal_data_in_long_runs_of_digits(spark):
    """Runs that a recursive pattern would overflow the stack on; the first is of 100,000 digits."""
    every = ["1-" * 100_000, "1 " * 5_000, "7" * 50_000, "1 " * 5_000 + ", 4111 1111 1111 1111"]
    got = {r.doc_id: r for r in personal_data.find(table(spark, every)).collect()}
    for k, text in enumerate(every):
        want = helpers.private(text)
        told = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        assert got[k].n_card == len(want) and got[k].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
    assert got[3].n_card == 1


def test_personal_data_in_texts_of_a_million_characters(spark):
    """Each text with the number of emails, addresses, cards and phones in it."""
    m = 1_000_000
    every = {"7" * m: (0, 0, 0, 0), "a" * m: (0, 0, 0, 0), "@" * m: (0, 0, 0, 0), "a." * m: (0, 0, 0, 0), "1." * m: (0, m // 4, 0, 0), "+1" * m: (0, 0, 0, 0), "+1 (" * (m // 4): (0, 0, 0, 0)}
    every |= {"token=" * m: (0, 0, 0, 0), "a" * m + "@b.c": (1, 0, 0, 0), " " * m + "1.2.3.4": (0, 1, 0, 0)}
    got = {r.doc_id: r for r in personal_data.find(table(spark, list(every))).collect()}
    for k, (text, want) in enumerate(every.items()):
        assert (got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone) == want, text[:20]


def test_contexts_discover_identifiers(spark):
    every = [f"some words reachable via mobile +1 555 {k:03d} 45{k:02d} during the day" for k in range(10, 40)]
    every += ["some words reachable via mobile 0171-23456 during the day", "a clean text with 12 apples via 3 shops", "the number 0171-23456 elsewhere"]
    got = {r.doc_id: r for r in personal_data.find(table(spark, every)).collect()}
    assert got[30].spans == "phone:32:42" and got[31].spans == "" and got[32].spans == ""
    assert [got[k].n_discovered for k in (0, 30, 31)] == [0, 1, 0] and got[0].n_spans == 1


def test_what_contexts_add_equals_brute_force(spark):
    """Contexts in the middle of long words, lists of numbers, digits in contexts, several kinds and rounds."""
    rnd = random.Random(11)
    noise = lambda n: [rnd.choice(["red", "blue", "x" * 300, "room 12", "9", "the", "call:"]) for _ in range(n)]
    values = {"ip": lambda: f"{rnd.randint(1, 9)}.2.{rnd.randint(1, 99)}.4", "email": lambda: f"u{rnd.randint(1, 99)}@a.b", "odd": lambda: f"q{rnd.randint(0, 30)}z"}
    every = ['token = "0123456789abcdef0123" and key: abcdefghijklmnop']
    for k in range(240):
        lead = ["host address", "mail " + "y" * 150, "room 12 call", "tel 030 1234567"][k % 4]
        kind = "odd" if k % 5 == 4 else ["ip", "email", "ip", "ip"][k % 4]
        own = " ".join([*noise(2), lead, values[kind](), "ends", *noise(3)])
        every.append(own + (" host address " + values["odd"]() + " ends" if k % 7 == 0 else ""))
    got = {r.doc_id: r for r in personal_data.find(table(spark, every)).collect()}
    want = helpers.all_private(every)
    for k in range(len(every)):
        assert got[k].spans == ",".join(f"{a}:{b}:{c}" for a, b, c in want[k]), every[k]
    assert got[0].spans == "secret:9:29" and got[0].n_secret == 1
    assert sum(r.n_discovered for r in got.values()) > 20


# Revisits


def test_revisits(spark):
    capture = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, payload_digest string, url_key int"
    rows = [
        (1, "http://www.Ex.com:80/a/?b=2&a=1#f", 10, "response", 200, {"ETag": '"x"', "Content-Type": "text/html", "X": "1"}, "d1", 0),
        (2, "https://ex.com/a?a=1&utm_source=z&b=2", 20, "revisit", 304, {"etag": 'W/"x"', "content-type": "image/png", "x": "2", "Date": "t"}, None, 0),
        (3, "ex.com/a?a=1&b=2", 30, "response", 404, {"ETag": '"x"'}, "d3", 0),
        (4, "ex.com/a?a=1&b=2", 40, "response", 200, {"Last-Modified": "m"}, "d4", 0),
        (5, "ex.com/a?a=1&b=2", 40, "revisit", 304, {"ETag": '"x"'}, None, 0),
        (6, "ex.com/a?a=1&b=2", 50, "revisit", 304, {"Last-Modified": "n"}, None, 0),
        (7, "ex.com/a?a=1&b=2", 60, "revisit", 304, None, "d4", 0),
        (8, "ex.com/a?a=1&b=2", 70, "revisit", 304, None, None, 0),
        (9, "other.com", 70, "revisit", 304, None, None, 0),
        (10, None, 70, "revisit", 304, None, None, 0),
        (11, "ex.com/a?a=1&b=2", 5, "revisit", 304, {"ETag": '"x"'}, None, 0),
        (12, "ex.com/a?a=1&b=2", None, "revisit", 304, {"ETag": '"x"'}, None, 0),
    ]
    for parts in (1, 3, 64):
        got = {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, capture), parts).collect()}
        assert {k: (r.outcome, r.referent_id) for k, r in got.items()} == {
            2: ("resolved", 1), 5: ("resolved", 1), 6: ("last_modified_differs", None), 7: ("resolved", 4), 8: ("no_validator", None),
            9: ("no_response", None), 10: ("no_response", None), 11: ("no_response", None), 12: ("no_response", None),
        }
        assert got[2].headers == {"etag": 'W/"x"', "content-type": "text/html", "x": "2", "date": "t"}
        assert got[7].payload_digest == "d4"
    assert revisits.resolve(spark.createDataFrame([], capture)).count() == 0


def test_revisits_equal_brute_force_on_skewed_time(spark):
    """A hot URL, most of whose captures lie in a few seconds far from the first, with ties, repeats and nulls."""
    rnd = random.Random(5)
    rows = []
    for k in range(1500):
        ts = rnd.choice([None, 0, *([1_700_000_000 + rnd.randint(0, 300)] * 30)])
        url = rnd.choice(["hot.org/x"] * 9 + ["b.org", None])
        headers = rnd.choice([None, {"ETag": rnd.choice("ab")}, {"etag": 'W/' + rnd.choice("ab"), "Last-Modified": rnd.choice("mn")}, {"last-modified": "m"}])
        rows.append((k // 2 if k % 50 == 1 else k, url, ts, rnd.choice(["response", "revisit"]), rnd.choice([200, 200, 304, None]), headers, rnd.choice([None, "d1", "d2"])))
    rows += rows[:40]
    full = defaultdict(dict)
    for i, url, ts, kind, status, headers, digest in rows:
        if kind == "response" and status == 200 and url and ts is not None:
            at = full[url].setdefault((ts, i), (headers, digest))
            full[url][ts, i] = max(at, (headers, digest), key=lambda x: x[1] or "")
    want = Counter()
    for i, url, ts, kind, _, headers, digest in rows:
        if kind != "revisit":
            continue
        earlier = [x for x in full.get(url, ()) if ts is not None and x[0] < ts]
        if not earlier:
            want[i, ts, None, "no_response"] += 1
            continue
        stored, held = full[url][max(earlier)]
        low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
        ours, theirs = low(stored), low(headers)
        for tag in ("etag", "last-modified"):
            a, b = (h[tag].removeprefix("W/") if tag in h else None for h in (ours, theirs))
            if a is not None and b is not None:
                outcome = "resolved" if a == b else tag.replace("-", "_") + "_differs"
                break
        else:
            outcome = "no_validator" if held is None or digest is None else "resolved" if held == digest else "digest_differs"
        want[i, ts, max(earlier)[1] if outcome == "resolved" else None, outcome] += 1
    frame = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, headers map<string,string>, payload_digest string")
    for parts in (None, 17):
        got = Counter((r.record_id, r.ts, r.referent_id, r.outcome) for r in revisits.resolve(frame, parts).collect())
        assert got == want


# Queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, str(DATA)).select(*columns).collect()
    tidy = lambda rows: sorted(repr(tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r)) for r in rows)
    assert tidy(got) == tidy(want.fetchall())
