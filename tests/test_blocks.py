"""Documents in blocks of word counts: the rows of the long forms, without a row per document and word in any shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import blocks as BK
from tagloom.operators import terms
from tagloom.operators import topics as TP


@pytest.fixture(params=["unique", "repeated"])
def corpus(spark, request):
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(d, " ".join(r.choice(words[: r.choice((9, 60))]) for _ in range(r.randrange(0, 30)))) for d in range(70)] + [(None, "w1 w2"), (90, None)]
    topics = [(d, d % 4 - 1) for d in range(0, 70)]
    if request.param == "repeated":
        rows += [(3, "w1 w1 other"), (None, "w4"), (5, "w9")]
        topics += [(4, 0), (4, 2), (5, -1), (3, 2)]
    return (spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(topics, "doc_id long, topic int"))


def _rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_blocks_hold_every_count(corpus):
    docs, _ = corpus
    b = BK.WordBlocks(docs, block_words=90)
    want = {(r["doc_id"], r["term"]): r["n"] for r in terms.document_counts(docs, "doc_id", "text").collect()}
    got = {}
    for p in b.packed.collect():
        assert p["df"] == [p["at"].count(i) for i in range(len(p["words"]))]
        for i, (lo, hi) in enumerate(zip(p["starts"], [*p["starts"][1:], len(p["at"])])):
            got.update({(p["keys"][i], p["words"][a]): n for a, n in zip(p["at"][lo:hi], p["n"][lo:hi])})
    assert got == want and b.packed.count() > 4 and b.n_docs == docs.count()
    f = {(r["block"], r["at"]): (r["id"], r["df"]) for r in b.frequencies().collect()}
    of = {(r["block"], r["at"]): r["term"] for r in b.words().collect()}
    df = {r["term"]: r["docs"] for r in terms.vocabulary(terms.document_counts(docs, "doc_id", "text")).collect()}
    assert {k: v[1] for k, v in f.items()} == {k: df[t] for k, t in of.items()}
    assert len({(of[k], v[0]) for k, v in f.items()}) == len(df) == len({v[0] for v in f.values()})
    b.drop()


def test_class_counts_scores_and_representatives(corpus):
    docs, assign = corpus
    b = BK.WordBlocks(docs, block_words=90)
    want = terms.class_counts(docs, assign)
    assert _rows(TP.block_counts(b, TP.block_classes(b, assign))) == _rows(want)
    left = docs.join(assign, "doc_id", "left").select("doc_id", "text", F.coalesce("topic", F.lit(-1)).alias("topic"))
    assert _rows(TP.block_counts(b, TP.block_classes(b, assign, default=-1))) == _rows(terms.term_counts(left, "topic", "text"))
    w = terms.ctfidf(want)
    long = TP.doc_class_vectors(terms.document_counts(docs, "doc_id", "text"), w)
    out = assign.filter("topic = -1")
    assert _rows(TP.block_candidates(b, w, out).select("doc_id", "topic", "score")) == \
        _rows(TP.ctfidf_candidates(long, w, out).select("doc_id", "topic", "score"))
    cols = ["topic", "rank", "doc_id", "cosine"]
    assert _rows(TP.block_representatives(b, w, assign, n=5).select(*cols)) == _rows(TP.representative_docs(long, w, assign, n=5).select(*cols))
    b.drop()


def test_queries_of_topic_vectors_shuffle_no_row_per_document_and_word(spark, tmp_dir, monkeypatch):
    """The long counts are not built at all."""
    import __spark_entry__ as E

    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(1, 30)), "en", "s", 0) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([(i, [float(i), 1.0], i % 3) for i in range(25)], "vec_id long, embedding array<float>, label int") \
         .write.parquet(f"{tmp_dir}/embeddings.parquet")
    monkeypatch.setattr(terms, "document_counts", lambda *a, **k: pytest.fail("counts as rows"))
    for name, n in (("reassign_outliers", 40), ("reassigned_words", 40), ("fit_budget", 1), ("build_prompts", 1)):
        assert E.queries()[name](spark, tmp_dir).count() >= min(n, 3)


def test_nmf_reads_weights_from_blocks_and_stores_values_once(spark, tmp_dir, monkeypatch):
    """No long counts, and no table of values as rows beside the blocks."""
    import __spark_entry__ as E
    from tagloom.session import Rounds

    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(1, 20)), "en", "s", 0) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_dir}/documents.parquet")
    monkeypatch.setattr(terms, "document_counts", lambda *a, **k: pytest.fail("counts as rows"))
    kept, keep = [], Rounds.keep
    monkeypatch.setattr(Rounds, "keep", lambda self, df: kept.append(df.columns) or keep(self, df))
    assert E.queries()["nmf"](spark, tmp_dir).count() == 100
    assert kept and ["r", "c", "x"] not in kept
