"""Terms are not dealt by class, nor the corpus's words shuffled for a few topic words."""

import pytest
from pyspark.sql import functions as F

from tagloom.operators import clean as CL
from tagloom.operators import dedupe as DD
from tagloom.operators import terms


@pytest.fixture()
def no_small_joins(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin")


def test_ctfidf_sends_the_class_totals_to_the_terms(spark, no_small_joins):
    counts = spark.createDataFrame([(0, "a", 3), (0, "b", 1), (1, "a", 2), (1, "c", 4)], "topic int, term string, n long")
    w = terms.ctfidf(counts)
    assert _joins(w) == (0, 1)
    assert w.count() == 4


def test_fill_oov_meets_the_topic_words_where_the_corpus_lies(spark, no_small_joins):
    top = spark.createDataFrame([(0, 1, "b"), (0, 2, "x y"), (1, 1, None), (1, 2, "b")], "topic int, rank int, term string")
    corpus = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "term string")
    out = CL.fill_oov(top, corpus, "a")
    assert _joins(out)[1] == 1
    assert sorted(map(tuple, out.select("topic", "rank", F.col("term")).collect())) == [(0, 1, "b"), (0, 2, "a"), (1, 1, "a"), (1, 2, "b")]


ODD_TEXTS = [(1, "red blue red"), (1, "blue Green"), (2, None), (3, ""), (None, "red"), (None, "red the sky"), (4, "sky")]


def test_document_counts_join_the_texts_of_a_key(spark):
    docs = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string")
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "term", "n").collect()), key=str)
    got = terms.document_counts(docs, "doc_id", "text")
    assert rows(got) == rows(terms.term_counts(docs, "doc_id", "text"))
    assert rows(got) == sorted([(1, "blue", 2), (1, "green", 1), (1, "red", 2), (4, "sky", 1), (None, "red", 2), (None, "sky", 1)], key=str)


def test_tfidf_shuffles_texts_and_not_terms(spark):
    """texts go by document, once; neither counts nor weights by term."""
    docs = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string")
    plan = terms.document_counts(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(doc_id" in plan
    w = DD.vectors(docs)
    assert "hashpartitioning(term" not in w._jdf.queryExecution().executedPlan().toString()
    assert w.count() == 6


def test_word_vectors_one_row_a_word(spark):
    """means by component, with one row per word (not per component) in the
    shuffle, over documents with a vector; short, null and empty vectors."""
    from tagloom.operators import cluster as CU
    occ = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "a"), (4, "c"), (5, "d"), (9, "e")], "doc_id long, term string")
    points = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, None]), (3, [5.0]), (4, []), (5, None)], "doc_id long, embedding array<float>")
    words = CU.word_vectors(occ, points)
    assert {r["term"]: r["vector"] for r in words.collect()} == {"a": [3.0, 2.0], "b": [1.0, 2.0]}
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "collect_list" not in plan
    assert CU.word_vectors(occ, points.filter("doc_id > 3")).count() == 0
