"""The corpus pipeline against the same steps in plain Python."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
import helpers
import public_tokenizers
import pyarrow.parquet as pq
from test_operators import _kept, _targets


def _draw(doc_id):
    return int(hashlib.md5(f"42:{doc_id}".encode()).hexdigest()[:13], 16) / 2**52


def test_pipeline(spark):
    from sentencepiece import SentencePieceProcessor

    sf = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    good = [r for r in rows if helpers.good(r["text"])]
    keep = {k for k, _ in _kept([(r["doc_id"], r["text"]) for r in good]).values()}
    unique = [r for r in good if r["doc_id"] in keep]
    groups = helpers.near_groups({r["doc_id"]: r["text"] for r in unique}, 5, 80)
    apart = [r for r in unique if groups[r["doc_id"]] == r["doc_id"]]
    sizes = Counter()
    for r in apart:
        sizes[r["source"]] += len(helpers.words(r["text"]))
    targets = _targets(sizes)
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for r in apart:
        rate = targets[r["source"]] / sizes[r["source"]]
        copies = math.floor(rate) + (_draw(r["doc_id"]) < rate - math.floor(rate))
        if copies:
            want[r["doc_id"], tuple(model.encode(r["text"]))] = copies
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want


def test_stages_keep_the_columns_of_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    empty = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, "")
        assert out.columns == documents.columns and out.count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "source_mixing", "sentencepiece"]
