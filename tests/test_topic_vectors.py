"""Window distributions, the hierarchy of topics and merging by vectors,
against plain restatements."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tagloom.operators import distributions as DI
from tagloom.operators import vector_topics as VT


def _plain_scores(texts, weights, idf, window, stride, least):
    """{doc: [(positions, {topic: cosine})]}"""
    topics = sorted({t for t, _ in weights if t != -1})
    norm = {t: math.sqrt(sum(w * w for (s, _), w in weights.items() if s == t)) for t in topics}
    out = {}
    for d, toks in texts.items():
        starts = [0] if len(toks) < window else [s for s in range(0, len(toks), stride) if s + window <= len(toks)]
        out[d] = []
        for s in starts if toks else []:
            n = Counter(toks[s:s + window])
            length = math.sqrt(sum((c * idf.get(w, 0)) ** 2 for w, c in n.items()))
            cos = {t: sum(c * idf.get(w, 0) * weights.get((t, w), 0) for w, c in n.items()) / (length * norm[t]) if length else 0 for t in topics}
            out[d].append((range(s, min(s + window, len(toks))), {t: c for t, c in cos.items() if round(c, 9) >= least}))
    return out


@pytest.mark.parametrize("window,stride", [(4, 1), (3, 2), (1, 1)])
def test_distributions(spark, window, stride):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    weights = {(t, w): rng.random() for t in range(-1, 20) for w in rng.sample(vocab, 8)}
    idf = {w: rng.random() + 0.5 for w in vocab}
    texts = {i: [rng.choice(vocab + ["the", "oov"]) for _ in range(rng.choice([0, 1, 2, 3, 5, 40]))] for i in range(60)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()] + [(99, None)], "doc_id long, text string")
    model = spark.createDataFrame([(t, w, x, idf[w]) for (t, w), x in weights.items()], "topic int, term string, weight double, idf double")
    seen = {w for _, w in weights}
    exp = _plain_scores(texts, weights, {w: v for w, v in idf.items() if w in seen}, window, stride, 0.1)
    want, token = {}, {}
    for d, windows in exp.items():
        sums = Counter()
        for places, cos in windows:
            for t, c in cos.items():
                sums[t] += c
                for p in places:
                    token[d, p, t] = token.get((d, p, t), 0) + c
        want |= {(d, t): s / sum(sums.values()) for t, s in sums.items()}
    args = {"window": window, "stride": stride, "block_tokens": 200}
    got = {(r["doc_id"], r["topic"]): r["prob"] for r in DI.topic_distributions(docs, model, **args).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    got = {(r["doc_id"], r["pos"], r["topic"]): r["score"] for r in DI.topic_distributions(docs, model, per_token=True, **args).collect()}
    assert got.keys() == token.keys() and all(got[k] == pytest.approx(token[k]) for k in token)
    assert DI.topic_distributions(docs.limit(0), model).count() == 0
    assert DI.topic_distributions(docs, model.limit(0)).count() == 0


def test_distribution_texts_are_shuffled_once(spark):
    """a block's words are listed where its texts lie."""
    docs = spark.createDataFrame([(i, "red green blue red") for i in range(9)], "doc_id long, text string")
    model = spark.createDataFrame([(0, "red", 0.5, 1.0), (1, "blue", 0.5, 1.0)], "topic int, term string, weight double, idf double")
    plan = DI.topic_distributions(docs, model, block_tokens=4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not re.search(r"hashpartitioning\(of#\d+L?, term", plan)
    assert not re.search(r"hashpartitioning\(block#\d+L?, \d+\), ENSURE", plan)


def test_windows_over_several_runs(monkeypatch):
    """Windows that begin in one run of places and end in the next."""
    rng = np.random.default_rng(2)
    docs = pa.array([[f"w{i}" for i in rng.integers(0, 9, n)] for n in (0, 3, 50, 4, 1, 33)])
    idf, model = rng.random(8) + 0.5, rng.random((8, 3))
    made = DI.Windows(docs, pa.array([f"w{i}" for i in range(8)]), idf, 4, 1)
    whole = [s for _, s in made.scores(model, 0.1)]
    monkeypatch.setattr(DI, "RUN", 5)
    parts = list(made.scores(model, 0.1))
    assert len(whole) == 1 and len(parts) > 1 and len(whole[0]) == len(made.doc)
    assert np.array_equal(np.concatenate([s for _, s in parts]), whole[0])


def _plain_agglomeration(cosine, ids):
    """Greedy average linkage over a full matrix: (left, right, distance, size)."""
    groups, out = {i: [i] for i in ids}, []
    while len(groups) > 1:
        d, x, y = min((round(1 - sum(cosine.get((min(a, b), max(a, b)), 0) for a in groups[x] for b in groups[y])
                             / (len(groups[x]) * len(groups[y])), 12), x, y) for x in groups for y in groups if x < y)
        groups[x] += groups.pop(y)
        out.append((x, y, d, len(groups[x])))
    return out


def test_hierarchy_equals_a_greedy_one(spark):
    rng = random.Random(2)
    ids = list(range(0, 46, 2))
    cosine = {(a, b): rng.random() for a in ids for b in ids if a < b and rng.random() < 0.5 and a < 40}  # the last share nothing
    cosine = {k: v for k, v in cosine.items() if k[1] < 40}
    sims = spark.createDataFrame([(*k, v) for k, v in cosine.items()], "t1 int, t2 int, cosine double")
    topics = spark.createDataFrame([(i,) for i in ids], "topic int")
    rows = VT.agglomerate(sims, topics).orderBy("step").collect()
    exp = _plain_agglomeration(cosine, ids)
    assert [(r["left"], r["right"], r["size"]) for r in rows] == [(x, y, n) for x, y, _, n in exp]
    assert [r["distance"] for r in rows] == pytest.approx([d for _, _, d, _ in exp])
    assert [r["step"] for r in rows] == list(range(1, len(ids)))
    assert VT.agglomerate(sims.limit(0), topics.limit(0)).count() == 0


def _unit(v):
    return np.array(v, float) / np.linalg.norm(v)


def _topics(spark, seed=0):
    rng = np.random.default_rng(seed)
    base = [_unit(v) for v in rng.standard_normal((5, 6))]
    centre = [base[0], _unit(base[0] + 0.2 * base[1]), _unit(base[0] + 0.4 * base[1]), base[2], base[3], _unit(base[3] + 0.1 * base[4]), base[4]]
    points = [(i, (i * 7) % 7, (centre[i % 7] + 0.05 * rng.standard_normal(6)).tolist()) for i in range(70)]
    points = [(i, i % 7 if i % 10 else (i + 1) % 7, v) for i, _, v in points]
    df = spark.createDataFrame([(i, v) for i, _, v in points], "doc_id long, embedding array<double>")
    assign = spark.createDataFrame([(i, t) for i, t, _ in points], "doc_id long, topic int")
    size = Counter(t for _, t, _ in points)
    cents = spark.createDataFrame([(t, size[t], c.tolist()) for t, c in enumerate(centre)], "topic int, size long, centroid array<double>")
    return points, centre, size, df, assign, cents


def test_close_topics_merge_to_the_fixed_point(spark):
    points, centre, size, df, assign, cents = _topics(spark)
    cur, name = {t: (size[t], c) for t, c in enumerate(centre)}, {t: t for t in range(7)}
    while True:
        close = [(a, b) for a in cur for b in cur if a < b and round(float(_unit(cur[a][1]) @ _unit(cur[b][1])), 12) >= 0.9]
        if not close:
            break
        low = {t: t for t in cur}
        for _ in cur:
            for a, b in close:
                low[a] = low[b] = min(low[a], low[b])
        cur = {r: (sum(cur[t][0] for t in cur if low[t] == r),
                   _unit(sum(cur[t][0] * cur[t][1] for t in cur if low[t] == r))) for r in set(low.values())}
        name = {t: low[n] for t, n in name.items()}
    new, names = VT.merge_close(cents, 0.9)
    got = {r["topic"]: (r["size"], r["centroid"]) for r in new.collect()}
    assert got.keys() == cur.keys() and len(cur) == 4
    assert all(got[t][0] == cur[t][0] and got[t][1] == pytest.approx(cur[t][1].tolist()) for t in cur)
    assert {r["topic"]: r["new"] for r in names.collect()} == name
    moved = {t for t, n in name.items() if list(name.values()).count(n) > 1}
    order = sorted(cur)
    best = {i: order[int(np.argmax([_unit(v) @ _unit(cur[t][1]) for t in order]))] if topic in moved else topic for i, topic, v in points}
    out = {r["doc_id"]: r["topic"] for r in VT.reassign_merged(df, assign, new, names).collect()}
    assert out == best


def test_reduction_by_vectors(spark):
    points, centre, size, df, assign, cents = _topics(spark)
    cur, own, vec = dict(enumerate(centre)), {i: t for i, t, _ in points}, {i: np.array(v) for i, _, v in points}
    while len(cur) > 3:
        n = {t: sum(o == t for o in own.values()) for t in cur}
        small = min(cur, key=lambda t: (n[t], t))
        other = min((t for t in cur if t != small), key=lambda t: (-round(float(_unit(cur[t]) @ cur[small]), 12), t))
        merged = _unit((max(n[small], 1) * cur[small] + max(n[other], 1) * cur[other]) / (max(n[small], 1) + max(n[other], 1)))
        del cur[small]
        cur[other] = merged
        order = sorted(cur)
        own |= {i: order[int(np.argmax([_unit(vec[i]) @ cur[t] for t in order]))] for i, t in own.items() if t in (small, other)}
    got, left = VT.reduce_by_vectors(df, assign, cents, 3)
    assert {r["doc_id"]: r["topic"] for r in got.collect()} == own
    rows = {r["topic"]: (r["size"], r["centroid"]) for r in left.collect()}
    assert rows.keys() == cur.keys()
    assert all(rows[t][0] == sum(o == t for o in own.values()) and rows[t][1] == pytest.approx(cur[t].tolist()) for t in cur)
