"""Each stage of the pipeline on its own input, against a restatement."""

import zlib

import brute as B
import public_tokenizers as P
from conftest import SF_SMALL

import corpus_pipeline
from tagloom.llm import packing
from tagloom.llm.common import staged, table


def test_stages(spark):
    docs = table(spark, SF_SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text", "source", "lang").collect()] if name != "packing" else \
            docs.select("doc_id", "text").collect()
        got = staged(stage(spark, docs, SF_SMALL), f"test-{name}")
        after = got.collect()
        ids = {r["doc_id"] for r in after}
        texts = {r["doc_id"]: r["text"] for r in after} if name != "packing" else {}
        if name != "packing":
            assert got.columns == docs.columns
        if name == "quality_rules":
            exp = B.quality([(i, t, s) for i, t, s, _ in before], 20, 0.3)
            assert ids == {r[0] for r, e in zip(before, exp) if e[6]}
        elif name == "language_id":
            assert len(ids) >= 0.95 * len(before) and ids <= {r[0] for r in before}
        elif name == "line_dedup":
            exp = B.line_dedup([r[1] for r in before], 10)
            assert ids == {r[0] for r in before}
            assert all(B.sha(texts[r[0]]) == e[2] for r, e in zip(before, exp))
        elif name == "simhash":
            exp = B.simhash_groups([r[0] for r in before], [r[1] for r in before])
            assert ids == {c for _, c in exp}
        else:
            assert ids == {r[0] for r in before}
        docs = got


def test_run_and_empty_table(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "line_dedup", "simhash", "packing"]
    docs = table(spark, SF_SMALL, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF_SMALL), f"empty-{name}")
    assert docs.count() == 0


def test_packed_rows_make_whole_sequences(spark):
    docs = table(spark, SF_SMALL, "documents")
    got = staged(corpus_pipeline.packing_stage(spark, docs, SF_SMALL), "test-sequences")
    ids = {(r["doc_id"], r["piece"]): bytes(r["ids"]) for r in packing.pieces(docs, P.path("word_bpe_49k.json")).collect()}
    exp = {}
    for r in sorted(got.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        part = ids.pop((r["doc_id"], r["piece"]))
        assert bytes(r["ids"]) == part and r["ids_crc32"] == zlib.crc32(part) and len(part) == 4 * r["length"]
        exp[r["sequence_id"]] = exp.get(r["sequence_id"], b"") + part
    assert not ids
    assert {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(got).collect()} == exp
