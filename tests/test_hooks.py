"""Plugged-in models, tokenizers, representations and metrics."""

from pyspark.sql import functions as F

from tagloom.operators import hooks as HK
from tagloom.operators import terms

TEXTS = [(1, "red red apple"), (2, "red apple pear"), (3, "blue boat"), (4, "blue sail boat The"), (5, None), (6, "")]


def _docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def _model(docs):
    return docs.select("doc_id", F.when(F.col("doc_id") <= 2, 0).when(F.col("doc_id") <= 4, 1).otherwise(-1).alias("topic"))


def test_row_tokenizer_equals_the_column_tokenizer(spark):
    d = _docs(spark).unionByName(spark.createDataFrame([(7, "Größe naïve_x 42 a b"), (8, "x " * 2000 + "end")],
                                                       "doc_id long, text string"))
    got = sorted(map(tuple, HK.term_rows(d, HK.WordRows).collect()))
    assert got == sorted(map(tuple, terms.positions(d, "doc_id", "text").collect()))


def test_own_tokenizer(spark):
    @F.udtf(returnType="pos: int, term: string")
    class Letters:
        def eval(self, text: str):
            for i, c in enumerate(text or ""):
                yield i, c
    d = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, HK.term_rows(d, Letters).collect())) == [(1, 0, "a"), (1, 1, "b")]


def test_representations_run_in_order_and_metrics_see_their_outcome(spark):
    seen = []

    def shout(words, rows, topics):
        seen.append("shout")
        return words.withColumn("term", F.upper("term"))

    def mark(words, rows, topics):
        seen.append("mark")
        return words.withColumn("term", F.concat("term", F.lit("!")))

    def count(words, rows):
        return words.agg(F.count(F.lit(1)).alias("n"))
    words, scores = HK.evaluate(_docs(spark), _model, [shout, mark], {"n": count, "diversity": HK.diversity}, k=2)
    assert seen == ["shout", "mark"]
    assert {r["term"] for r in words.collect()} <= {"RED!", "APPLE!", "PEAR!", "BLUE!", "BOAT!", "SAIL!"}
    assert {r["metric"]: r["value"] for r in scores.collect()} == {"n": 4.0, "diversity": 1.0}


def test_built_in_steps(spark):
    words, scores = HK.evaluate(_docs(spark), _model, [HK.spread_words(0.9), HK.own_words(1)],
                                {"coverage": HK.coverage, "npmi": HK.coherence})
    got = {(r["topic"], r["rank"]): r["term"] for r in words.collect()}
    # pear and sail stand in half of their topics' documents only
    assert {got[0, 1], got[0, 2]} == {"red", "apple"} and {got[1, 1], got[1, 2]} == {"blue", "boat"} and len(got) == 4
    value = {r["metric"]: r["value"] for r in scores.collect()}
    assert value["coverage"] == 1.0 and abs(value["npmi"] - 1) < 1e-6
    rows = HK.term_rows(_docs(spark), HK.WordRows)
    both = spark.createDataFrame([(0, 1, "x", 1.0), (0, 2, "y", .5), (1, 1, "x", 1.0)], "topic int, rank int, term string, weight double")
    assert [tuple(r) for r in HK.own_words(1)(both, rows, None).collect()] == [(0, 1, "y", .5)]


def test_empty_table(spark):
    words, scores = HK.evaluate(_docs(spark).limit(0), _model, [HK.spread_words(0.5)], {"diversity": HK.diversity})
    assert words.count() == 0 and scores.collect()[0]["value"] is None
