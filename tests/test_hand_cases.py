"""Hand-made cases (FIXTURES.md section 4) and small exact checks."""

import math
import json

import pytest
from pyspark.sql import functions as F

from tagloom.operators import augment as AU
from tagloom.operators import clean as CL
from tagloom.operators import dedupe as DD
from tagloom.operators import quality as QU
from tagloom.operators import tags as TG
from tagloom.operators import agreement as AG
from tagloom.sources import files as SF


def test_dedupe_chain_keeps_a_and_c(spark):
    # a~b and b~c above the threshold, a and c below it
    docs = spark.createDataFrame([
        (1, "alpha beta gamma delta epsilon zeta"),
        (2, "alpha beta gamma delta epsilon zeta eta theta"),
        (3, "gamma delta epsilon zeta eta theta"),
    ], "doc_id long, text string")
    w = DD.vectors(docs)
    pairs = {(r["a"], r["b"]): r["cosine"] for r in DD.similar_pairs(w, 0.1).collect()}
    t = (pairs[(1, 2)] + pairs[(2, 3)]) / 2
    assert pairs[(1, 3)] < min(pairs[(1, 2)], pairs[(2, 3)])
    thr = max(pairs[(1, 3)], 0) + 1e-6 if pairs[(1, 3)] < min(pairs[(1, 2)], pairs[(2, 3)]) else t
    kept, similar = DD.drop_similar(docs, threshold=thr)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert sorted((r["kept_id"], r["similar_id"]) for r in similar.collect()) == [(1, 2), (3, 2)]


def test_empty_and_stopword_text_never_duplicate(spark):
    docs = spark.createDataFrame([(1, ""), (2, "the and of"), (3, ""), (4, "the of and")],
                                 "doc_id long, text string")
    kept, similar = DD.drop_similar(docs, threshold=0.5)
    assert kept.count() == 4
    assert similar.count() == 0


def test_exact_copies_collapse(spark):
    docs = spark.createDataFrame([(i, "same words here again") for i in range(5)] + [(9, "other text entirely")],
                                 "doc_id long, text string")
    kept, similar = DD.drop_similar(docs, threshold=0.99)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 9]
    assert sorted(r["similar_id"] for r in similar.collect()) == [1, 2, 3, 4]


def test_features_suffix(spark):
    df = spark.createDataFrame([(1, "d", [(0, "x"), (1, "y"), (2, "z")])],
                               "dataset_id long, description string, features array<struct<idx:int,name:string>>")
    out = df.transform(AU.with_features(max_features=2)).first()["augmented_description"]
    assert out == "d\n\nFeatures: x, y, and 1 more..."


def test_tags_removed_keep_order(spark):
    df = spark.createDataFrame([(1, "d", ["a", "b", "a", "c"])], "dataset_id long, description string, tag array<string>")
    rm = spark.createDataFrame([(1, "b")], "dataset_id long, tag string")
    out = df.transform(AU.with_tags(removals=rm)).first()["augmented_description"]
    assert out == "Tags: a, a, c\n\nd"


def test_label_choice_all_below_keeps_best(spark):
    s = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.4), (2, "a", 0.9), (2, "b", 0.6), (2, "c", 0.1)],
                              "doc_id long, label string, score double")
    got = sorted((r["doc_id"], r["label"]) for r in TG.select_labels(s, 0.5, True).collect())
    assert got == [(1, "b"), (2, "a"), (2, "b")]
    single = sorted((r["doc_id"], r["label"]) for r in TG.select_labels(s, 0.5, False).collect())
    assert single == [(1, "b"), (2, "a")]


def test_token_budget_stops_at_first_overflow(spark):
    r = spark.createDataFrame([(0, 1, 5), (0, 2, 4), (0, 3, 3)], "topic int, rank int, tokens int")
    assert [x["rank"] for x in TG.fit_budget(r, 8).collect()] == [1]


def test_diversity_two_identical_topics(spark):
    tw = spark.createDataFrame([(t, i + 1, w) for t in (0, 1) for i, w in enumerate(["a", "b", "c"])],
                               "topic int, rank int, term string")
    assert QU.diversity(tw, k=3).first()["diversity"] == 0.5


def test_chunk_without_break_is_hard_cut(spark):
    df = spark.createDataFrame([("abcdefghij",), ("ab cd. ef gh",)], "t string")
    got = [r[0] for r in df.select(CL.chunks("t", 4).alias("c")).collect()]
    assert got[0] == ["abcd", "efgh", "ij"]
    assert "".join(got[1]).replace(" ", "") == "abcd.efgh"


def _ref_chunks(text, size):
    # plain restatement of the chunk rule for comparison
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            e = end
            while e > start and text[e] not in " .!?":
                e -= 1
            end = e if e > start else start + size
        else:
            end = len(text)
        out.append(text[start:end].strip())
        start = end
    return out


def test_chunks_match_rule_on_corpus(spark):
    from conftest import SF_SMALL
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").limit(200)
    for r in d.select("text", CL.chunks("text", 300).alias("c")).collect():
        assert r["c"] == _ref_chunks(r["text"], 300)


def test_dirty_payloads(spark):
    rows = [(1, '{"topic": {"themes": ["a"'),
            (2, json.dumps({"topic": {"themes": ["a"], "overarching_themes": ["b"]},
                            "texts": {"abc": {"a": 0.9}, "7": {"a": 0.8, "b": 0.6, "z": 0.3}}})),
            (3, json.dumps({"topic": {"themes": ["g"], "overarching_themes": []},
                            "texts": {"8": {"themes": {"g": 0.95}, "overarching_themes": {"o": 0.7}}}})),
            (4, json.dumps({"topic": {"themes": ["a"], "overarching_themes": []}, "texts": {"7": {"a": 0.85}}}))]
    raw = spark.createDataFrame(rows, "topic_id int, raw string").withColumn("payload", SF.parse_payload("raw"))
    ok = raw.filter(F.col("payload.texts").isNotNull())
    assert ok.count() == 3
    got = sorted((r["dataset_id"], r["kind"], r["tag"], r["score"]) for r in TG.classify_tags(ok).collect())
    assert got == [(7, "overarching_themes", "b", 0.6), (7, "themes", "a", 0.85), (7, "themes", "z", 0.3),
                   (8, "overarching_themes", "o", 0.7), (8, "themes", "g", 0.95)]


def test_agreement_complete(spark):
    r = spark.createDataFrame([(rt, it, 1 + it % 3) for rt in range(4) for it in range(6)],
                              "rater int, item int, rating int")
    assert abs(AG.fleiss_kappa(r).first()["kappa"] - 1.0) < 1e-12
    for lev in ("nominal", "ordinal", "interval"):
        assert abs(AG.krippendorff_alpha(r, lev).first()["alpha"] - 1.0) < 1e-12


def test_krippendorff_missing_allowed(spark):
    # textbook-style small case with one missing rating
    r = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (0, 1, 2), (1, 1, 2), (0, 2, 3), (1, 2, None),
                               (0, 3, 1), (1, 3, 2)], "rater int, item int, rating int")
    a = AG.krippendorff_alpha(r, "nominal").first()["alpha"]
    # units 0,1 agree, unit 3 disagrees, unit 2 is not pairable
    # o: (1,1)=2,(2,2)=2,(1,2)=1,(2,1)=1 ; n=6, n1=3, n2=3 -> alpha = 1 - 5*2/(2*9) = 0.4444
    assert abs(a - (1 - 5 * 2 / 18)) < 1e-9


@pytest.mark.parametrize("level", ["nominal", "ordinal", "interval"])
def test_krippendorff_missing_ratings(spark, level):
    raters = ["1233214 1   ", "12332 2412 3", " 3332 34251 "]
    rows = [(u, i, float(c)) for u, r in enumerate(raters) for i, c in enumerate(r) if c != " "]
    df = spark.createDataFrame(rows, "rater int, item int, rating double")
    got = AG.krippendorff_alpha(df, level).first()
    assert got["level"] == level and got["alpha"] == pytest.approx(_alpha(rows, level), abs=1e-9)


def _alpha(rows, level):
    """Straight from pairs of values within and over units."""
    units = {}
    for _, item, v in rows:
        units.setdefault(item, []).append(v)
    units = [x for x in units.values() if len(x) > 1]
    every = [v for x in units for v in x]

    def d2(a, b):
        if level == "nominal":
            return float(a != b)
        if level == "interval":
            return (a - b) ** 2
        lo, hi = min(a, b), max(a, b)
        return 0.0 if a == b else (sum(lo <= v <= hi for v in every) - (every.count(a) + every.count(b)) / 2) ** 2
    seen = sum(d2(a, b) / (len(x) - 1) for x in units for a in x for b in x) / len(every)
    due = sum(d2(a, b) for a in every for b in every) / (len(every) * (len(every) - 1))
    return 1 - seen / due


def test_krippendorff_without_variation(spark):
    same = spark.createDataFrame([(1, 1, 2.0), (2, 1, 2.0)], "rater int, item int, rating double")
    for level in ("nominal", "ordinal", "interval"):
        assert math.isnan(AG.krippendorff_alpha(same, level).first()["alpha"])
        assert math.isnan(AG.krippendorff_alpha(same.limit(0), level).first()["alpha"])
