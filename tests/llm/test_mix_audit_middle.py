"""Source mixing, filter audit and fill-in-middle against plain restatements:
nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import random
from collections import Counter, defaultdict

import brute as B
import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import fill_middle, filter_audit, mixing

SCHEMA = "doc_id long, text string, lang string, source string, size long, h long, part string, n long, target double, k int"


def _rows():
    rng = random.Random(9)
    rows = []
    for i in range(900):
        source = rng.choice(["big", "big", "big", "Zed", "a", "é", None])
        words = [rng.choice(["alpha", "Beta", "gam#ma", "DELTA", "épée", "x1", f"own{i}"]) for _ in range(int(rng.paretovariate(0.9) * 5))]
        text = "".join(w + rng.choice([" ", "\n", "\n\n", "\t"]) for w in words)[:60000]
        rows.append((i, text, rng.choice(["en", "fr", None]), source))
    rows += [(1000 + i, "the very same text\nof many copies", "en", "big") for i in range(300)]
    rows += [(5, "the same row", "fr", "a")] * 400  # repeated rows
    rows += [(2000, None, None, None), (2001, "", "en", "a"), (2002, " \n\t\n", "en", "void"), (None, "no id <S>", "fr", "é"),
             (None, "no id <S>", "fr", "é"), (2003, "w\n" * 30000, "en", "a"), (2004, "one line", "en", "tiny"), (2005, "<P", "en", "a"),
             (2006, "x" * 100000 + "\n" + "ü" * 5000, "de", "a"), (2007, "<P>", "en", "big"), (2008, "\n\n<S\n>", "en", "big")]
    return [(i, t, lang, s, 1, 2, "part", 3, 0.5, 4) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_mix_meets_the_targets(docs, rows):
    exp = B.source_sizes_and_targets([(r[0], r[1], r[3]) for r in rows])
    got = mixing.mix(docs, bucket=16).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    words, longest = defaultdict(int), defaultdict(int)
    for r in got:
        source = None if r["none"] else r["src"]
        assert (r["source_size"], r["target"]) == pytest.approx(exp[source])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        words[source] += r["taken"]
        longest[source] = max(longest[source], r["size"])
        assert r["copies"] >= int(r["target"] / r["source_size"]) if r["source_size"] else r["taken"] == 0
    for s, (_, target) in exp.items():  # nearest: off by half the document at the end at most
        assert abs(words[s] - target) <= longest[s] / 2
    again = mixing.mix(docs.repartition(3), bucket=64).collect()  # reruns agree, whatever the layout
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mix_draws_with_unequal_probabilities(spark):
    """Inclusion follows min(1, c * size ** power); the sample has the fixed size."""
    sizes = [1] * 2000 + [16] * 1000
    df = spark.createDataFrame([(i, " ".join(["w"] * n), "s") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    share = 0.25
    hits = Counter()
    for seed in range(4):
        got = mixing.mix(df, share=share, seed=seed).collect()
        assert abs(sum(r["taken"] for r in got) - share * sum(sizes)) <= 8
        for r in got:
            hits[r["size"]] += r["copies"]
    c = share * sum(sizes) / sum(n ** 1.5 for n in sizes)
    for n, count in ((1, 2000), (16, 1000)):
        assert hits[n] / (4 * count) == pytest.approx(c * n ** 0.5, rel=0.15)


def test_mix_many_sources_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 7)
    rows = [(i, "w " * (i % 13 + 1), None if i % 41 == 0 else f"s{i % 40:02}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    exp = B.source_sizes_and_targets(rows)
    got = {(None if r["none"] else r["src"]): (r["source_size"], r["target"]) for r in mixing.mix(df).collect()}
    assert got.keys() == exp.keys() and all(got[s] == pytest.approx(exp[s]) for s in exp)


def test_emit_writes_what_the_mix_takes(docs, rows):
    mixed = mixing.mix(docs, bucket=16)
    out = mixing.emit(docs, mixed)
    assert out.columns == docs.columns
    want = Counter()
    for r in mixed.collect():
        want[r["doc_id"], None if r["none"] else r["src"]] += r["copies"]
    assert Counter((r["doc_id"], r["source"]) for r in out.collect()) == +want


def test_mix_of_nothing(docs):
    assert mixing.mix(docs.limit(0)).count() == 0
    none = mixing.mix(docs.filter("text is null")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in none] == [(0, 0.0, 0)]


def test_mix_is_native(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 1200, 2)] + [(4, 0, 0), (5, None, 1), (None, 1, 1)]


def test_filter_audit(spark, docs, rows):
    labels = {}
    for i, q, t in LABELS:
        if i is not None:
            old = labels.get(i, (0, 0))
            labels[i] = (max(old[0], int(q == 1)), max(old[1], int(t == 1)))
    exp = B.audit([(r[0], r[1], r[2]) for r in rows], labels)
    marks = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    for segment in (1 << 18, 64):  # one segment and many
        got = filter_audit.audit(filter_audit.masks(docs, marks, segment))
        names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(exp)
    assert filter_audit.audit(filter_audit.masks(docs.limit(0), marks)).count() == 0
    assert filter_audit.masks(docs, marks.limit(0)).filter("good or toxic").count() == 0


def test_sketches_clear_unique_texts_and_no_repeat(spark):
    rng = np.random.default_rng(2)
    once = np.unique(rng.integers(-2**63, 2**63 - 1, 60_000))
    twice = once[:500]
    df = spark.createDataFrame([(int(x),) for x in np.concatenate([once, twice, np.repeat(once[500], 3000)])], "h long").repartition(7)
    got = {r["h"] for r in filter_audit.possible_repeats(df, segment=1 << 13).collect()}
    assert set(map(int, once[:501])) <= got
    assert len(got) - 501 < 0.03 * len(once)  # the others are cleared


def test_shuffled_repeats_give_the_same(spark, docs, monkeypatch):
    marks = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    want = sorted(map(tuple, filter_audit.masks(docs, marks).collect()))
    monkeypatch.setattr(filter_audit, "BROADCAST", 0)
    assert sorted(map(tuple, filter_audit.masks(docs, marks).collect())) == want


def test_fill_middle(docs, rows):
    exp = [(r[0], *B.fill_middle(r[0], r[1]), r[1] or "") for r in rows]
    got = fill_middle.transform(docs).withColumn("back", fill_middle.restore("output", "form"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(exp, key=repr)
    assert {"plain", "psm", "spm"} == {e[2] for e in exp}
    assert fill_middle.transform(docs.limit(0)).count() == 0
    assert {r["form"] for r in fill_middle.transform(docs, rate=0).collect()} == {"plain"}


def test_rank_index_is_exact_and_bounded():
    rng = np.random.default_rng(0)
    for steps in (rng.integers(1, 80, 5000), np.ones(3000, int), rng.pareto(0.5, 3000).astype(int) + 1, [10**9] * 5, [1], []):
        offsets = np.concatenate([[0], np.cumsum(np.asarray(steps, np.int64))])
        for error in (0, 3, 1023):
            index = fill_middle.RankIndex(offsets, error)
            ranks = rng.integers(0, len(offsets), 200)
            assert (index.offset(ranks) == offsets[ranks]).all()
            assert np.abs(index.residual.astype(np.int64)).max() <= error + 1
    assert len(fill_middle.RankIndex(np.arange(0, 10**6, 40)).first) == 1  # a straight run is one segment
    assert len(fill_middle.RankIndex(np.zeros(0, np.int64)).offset(np.zeros(0, np.int64))) == 0
