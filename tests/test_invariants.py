"""Invariants for operators without an exact SQL oracle."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tagloom.operators import cluster as CU
from tagloom.operators import dedupe as DD
from tagloom.operators import models as MO
from tagloom.operators import quality as QU
from tagloom.operators import terms
from tagloom.sources import tables as T


def test_dedupe_invariants(spark):
    docs = T.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    t = 0.9
    kept, similar = DD.drop_similar(docs, threshold=t)
    kept_ids = {r["doc_id"] for r in kept.collect()}
    w = DD.vectors(docs)
    pairs = [(r["a"], r["b"]) for r in DD.similar_pairs(w, t).collect()]
    # no two kept documents are similar
    assert not any(a in kept_ids and b in kept_ids for a, b in pairs)
    # every dropped document has a smaller kept neighbour
    all_ids = {r["doc_id"] for r in docs.collect()}
    for d in all_ids - kept_ids:
        assert any((a in kept_ids and b == d and a < d) for a, b in pairs)


def test_similar_pairs_equal_brute_force(spark):
    docs = T.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    w = DD.vectors(docs)
    fast = {(r["a"], r["b"]) for r in DD.similar_pairs(w, 0.5).collect()}
    rows = w.select("doc_id", "term", "weight").collect()
    vec = {}
    for r in rows:
        vec.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    brute = set()
    for a, b in itertools.combinations(sorted(vec), 2):
        va, vb = vec[a], vec[b]
        if sum(x * vb.get(k, 0.0) for k, x in va.items()) > 0.5:
            brute.add((a, b))
    assert fast == brute


def test_npmi_and_diversity_ranges(spark):
    docs = T.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    assign = T.topic_assignments(spark, SF_SMALL)
    top = terms.top_words(terms.ctfidf(terms.class_counts(docs, assign)), k=10).filter("topic != -1")
    pos = terms.positions(docs, "doc_id", "text")
    for r in QU.npmi(top, pos).collect():
        assert -1.0 <= r["npmi"] <= 1.0
    d = QU.diversity(top, k=10).first()["diversity"]
    assert 0 < d <= 1


def test_nmf_loss_falls(spark):
    docs = T.table(spark, SF_SMALL, "documents").select("doc_id", "text").limit(60)
    w = DD.vectors(docs).select("doc_id", "term", "weight")
    _, _, losses = MO.nmf(w, 4, tol=2e-2)
    assert len(losses) > 1 and all(b <= a * (1 + 1e-9) for a, b in zip(losses, losses[1:]))
    assert losses[-2] - losses[-1] <= 2e-2 * losses[-2]


def test_nmf_of_nothing_and_of_weights_that_are_no_number(spark):
    schema = "doc_id long, term string, weight double"
    W, H, losses = MO.nmf(spark.createDataFrame([], schema), 2)
    assert W.count() == H.count() == 0 and losses == []
    rows = [(1, "a", float("nan")), (2, "b", None), (3, "c", float("inf")), (4, "d", 1.0), (4, "e", 2.0), (5, "d", 0.0)]
    W, H, losses = MO.nmf(spark.createDataFrame(rows, schema), 2)
    assert {r["doc_id"] for r in W.collect()} == {4} and {r["term"] for r in H.collect()} == {"d", "e"} and losses[-1] < 0.1


def test_nmf_by_blocks_is_the_dense_fit_and_sends_no_row_per_value(spark):
    """Blocks give what one dense fit gives, null keys included, and what is
    sent in a step is summed by column within a block."""
    rng = np.random.default_rng(3)
    rows = [(d, f"t{t}", float(rng.random())) for d in range(300) for t in rng.choice(12, 6, replace=False)]
    rows += [(None, "t1", 0.5), (7, None, 0.25)]
    df = spark.createDataFrame(rows, "doc_id long, term string, weight double").repartition(3)
    W, H, losses = MO.nmf(df, 2, tol=1e-2, block_cells=400)
    hashed = {(kind, r["id"]): np.array(r["v"]) for kind, key, salt in (("w", "doc_id", "w"), ("h", "term", "h")) for r in
              df.select(key).distinct().select(F.col(key).alias("id"), F.array(*MO._init(key, 2, salt)).alias("v")).collect()}
    wk, hk = sorted({d for d, _, _ in rows if d is not None}) + [None], sorted({t for _, t, _ in rows if t}) + [None]
    w, h = np.array([hashed["w", d] for d in wk]), np.array([hashed["h", t] for t in hk])
    v = np.zeros((len(wk), len(hk)))
    for d, t, x in rows:
        if d is not None and t is not None:
            v[wk.index(d), hk.index(t)] += x
    vv, want = sum(x * x for _, _, x in rows), []
    by_col = v.copy()
    by_col[wk.index(7), -1] = 0
    for _ in losses:
        h = h * (by_col.T @ w) / (h @ (w.T @ w) + 1e-9)
        w = w * (by_col @ h) / (w @ (h.T @ h) + 1e-9)
        want.append(vv - 2 * (by_col * (w @ h.T)).sum() + np.trace(w.T @ w @ h.T @ h))
    assert losses == pytest.approx(want, rel=1e-9)
    got = {r["doc_id"]: r["v"] for r in W.collect()}
    assert len(got) == 301 and all(got[d] == pytest.approx(list(x), abs=1e-9) for d, x in zip(wk, w))
    got = {r["term"]: r["v"] for r in H.collect()}
    assert len(got) == 13 and all(got[t] == pytest.approx(list(x), abs=1e-9) for t, x in zip(hk, h))
    cells = pa.table({"block": pa.array([0] * 4, pa.int32()), "r": ["1", "2", "1", "3"], "c": ["a", "a", "b", "a"], "x": [1.0, 2, 3, 4]})
    given = pa.table({"kind": list("hhwww"), "block": [0] * 5, "at": [0, 1, 0, 1, 2], "s0": [1.0] * 5})
    sent = MO._block_step(1, np.ones((1, 1)), 1e-9)(MO._packed(cells), given).to_pylist()
    assert sorted(r["name"] for r in sent if r["kind"] == "h") == ["a", "b"] and len(sent) == 2 + 3 + 1 + 1


def test_density_clusters_partition_ids(spark):
    v = T.vectors(spark, SF_SMALL)
    c = CU.density_clusters(v, min_samples=4, min_cluster_size=3, block_rows=64)
    ids = [r["doc_id"] for r in c.collect()]
    assert len(ids) == len(set(ids)) == v.count()


def test_knn_blocks_agree(spark):
    v = T.vectors(spark, SF_SMALL)
    a = {(r["a"], r["b"]) for r in CU.knn(v, 3, block_rows=50).collect()}
    b = {(r["a"], r["b"]) for r in CU.knn(v, 3, block_rows=10_000).collect()}
    assert a == b


def test_same_result_any_partitioning(spark):
    import __spark_entry__ as E
    q = E.queries()["ctfidf_top_words"]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = sorted(tuple(r) for r in q(spark, SF_SMALL).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    many = sorted(tuple(r) for r in q(spark, SF_SMALL).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == many


def test_members_and_bins_equal_the_general_forms(spark):
    """The one-join forms give the rows of the general ones, texts without terms and outliers included."""
    from tagloom.operators import overtime as OT
    from tagloom.operators import topics as TP
    docs = T.table(spark, SF_SMALL, "documents").select("doc_id", "text") \
        .unionByName(spark.createDataFrame([(-5, ""), (-6, None)], "doc_id long, text string"))
    assign = docs.select("doc_id", (F.pmod("doc_id", F.lit(4)) - 1).cast("int").alias("topic"))
    counts, w = terms.term_counts(docs, "doc_id", "text"), terms.ctfidf(terms.class_counts(docs, assign))
    a = TP.representative_docs(TP.doc_class_vectors(counts, w), w, assign).collect()
    b = TP.representative_members(counts, w, assign).collect()
    assert {(r["topic"], r["rank"], r["doc_id"]) for r in a} == {(r["topic"], r["rank"], r["doc_id"]) for r in b}
    timed = docs.join(assign, "doc_id").withColumn("bin", F.pmod("doc_id", F.lit(3)))
    idf = w.select("term", "idf").distinct()
    old = OT.topics_over_time(counts.join(timed.drop("text"), "doc_id"), idf).collect()
    new = OT.topics_over_time(OT.bin_counts(timed), idf).collect()
    key = ["bin", "topic", "frequency", "words"]
    assert sorted(tuple(r[k] for k in key) for r in old) == sorted(tuple(r[k] for k in key) for r in new)
    assert len(new) == 9


def _npmi(texts, topics, window):
    """NPMI by units as lists of sets; ``window`` None: a unit is a document."""
    import math
    units = [set(t[i:i + (window or len(t) + 1)]) for t in texts for i in range(max(len(t) - (window or len(t)), 0) + 1)]
    p = lambda *ws: sum(all(w in u for w in ws) for u in units) / len(units)
    out = {}
    for t, words in topics.items():
        v = [math.log((p(a, b) + 1e-12) / (p(a) * p(b))) / -math.log(p(a, b) + 1e-12) if p(a) and p(b) else 0.0
             for a, b in itertools.combinations(words, 2)]
        out[t] = sum(v) / len(v)
    return out


def test_npmi_equals_brute_force(spark):
    import random
    rnd = random.Random(3)
    texts = [[rnd.choice(["ant", "bee", "cat", "dog", "elk", "fox"]) for _ in range(rnd.choice([0, 1, 4, 25]))] for _ in range(30)]
    topics = {0: ["ant", "bee", "cat"], 1: ["cat", "dog", "absent"], 2: ["fox", "bee"]}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    top = spark.createDataFrame([(t, w) for t, ws in topics.items() for w in ws], "topic int, term string")
    lengths = spark.createDataFrame([(i, len(t)) for i, t in enumerate(texts)], "doc_id long, L int")
    for mode, window in (("window", 4), ("document", None)):
        for length in (True, False):
            pos = terms.positions(docs, "doc_id", "text", stop_words=[], length=length)
            got = {r["topic"]: r["npmi"] for r in QU.npmi(top, pos, mode, window or 10, lengths=lengths).collect()}
            want = _npmi(texts, topics, window)
            assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want), (mode, length, got, want)


def _reduced(counts, sizes, n):
    """The rule of reduce_topics on dicts: {topic: {term: n}}, {topic: size} -> {old: new}."""
    import math
    counts, sizes, new = {t: dict(c) for t, c in counts.items()}, dict(sizes), {t: t for t in sizes}
    while len(sizes) > n:
        small = min(sizes, key=lambda t: (sizes[t], t))
        f = {}
        for c in counts.values():
            for w, x in c.items():
                f[w] = f.get(w, 0) + x
        a = sum(f.values()) // max(len(counts), 1)
        wt = {t: {w: x * math.log(a / f[w] + 1) for w, x in c.items()} for t, c in counts.items()}
        sim = {t: sum(x * wt[small][w] for w, x in v.items() if w in wt[small]) / math.sqrt(sum(x * x for x in v.values()))
               for t, v in wt.items() if t != small and small in wt and set(v) & set(wt[small])}
        others = [t for t in sizes if t != small]
        into = min(sim, key=lambda t: (-sim[t], t)) if sim else min(others, key=lambda t: (-sizes[t], t))
        for w, x in counts.pop(small, {}).items():
            counts.setdefault(into, {})[w] = counts.get(into, {}).get(w, 0) + x
        sizes[into] += sizes.pop(small)
        new = {o: into if t == small else t for o, t in new.items()}
    return new


def test_reduce_topics_equals_brute_force(spark, monkeypatch):
    import random
    monkeypatch.setattr(MO, "COMPACT", 3)
    rnd = random.Random(5)
    counts = {t: {f"w{rnd.randrange(30)}": rnd.randint(1, 9) for _ in range(rnd.randint(1, 8))} for t in range(12)}
    counts[3] = {"alone": 4}   # shares no word with another
    del counts[7]              # has documents and no word
    sizes = {t: rnd.randint(1, 6) for t in range(12)}
    sizes[3] = sizes[7] = 1
    rows = [(t, w, x) for t, c in counts.items() for w, x in c.items()] + [(-1, "w1", 50)]
    docs = [(100 * t + i, t) for t, s in [*sizes.items(), (-1, 3)] for i in range(s)]
    mapping, new = MO.reduce_topics(spark.createDataFrame(rows, "topic int, term string, n long"),
                                    spark.createDataFrame(docs, "doc_id long, topic int"), 3)
    want = _reduced(counts, sizes, 3) | {-1: -1}
    assert {r["old"]: r["new"] for r in mapping.collect()} == want
    assert {r["doc_id"]: r["topic"] for r in new.collect()} == {d: want[t] for d, t in docs}


def test_reduce_topics_keeps_one(spark):
    """Topics of one size without a common word, and a target of none."""
    counts = spark.createDataFrame([(0, "a", 1), (1, "b", 1), (2, "c", 1)], "topic int, term string, n long")
    assign = spark.createDataFrame([(i, i) for i in range(3)], "doc_id long, topic int")
    mapping, _ = MO.reduce_topics(counts, assign, 0)
    assert len({r["new"] for r in mapping.collect()}) == 1
    mapping, new = MO.reduce_topics(counts.limit(0), assign.limit(0), 2)
    assert mapping.count() == 0 and new.count() == 0


def test_similar_documents_counts_links(spark):
    """Copies, a near copy, a text without terms, repeated ids of none."""
    docs = spark.createDataFrame([(1, "red fox jumps"), (2, "jumps red fox"), (3, "red fox jumps"), (4, "red fox jumps high"),
                                  (5, ""), (6, None), (7, "unrelated words")], "doc_id long, text string")
    pairs, groups = DD.representative_pairs(docs, 0.5)
    got = {r["doc_id"]: (r["rep"], r["n_links"]) for r in DD.similar_documents(docs, pairs, groups).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 3), 5: (5, 0), 6: (6, 0), 7: (7, 0)}


def test_reduce_topics_reaches_target(spark):
    docs = T.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    assign = T.topic_assignments(spark, SF_SMALL)
    mapping, new = MO.reduce_topics(terms.class_counts(docs, assign), assign, 4)
    assert new.filter("topic != -1").select("topic").distinct().count() == 4
    assert new.count() == assign.count()


def test_greedy_keep_equals_sequential_greedy(spark):
    """Random graphs: the join-round solution equals the in-order greedy
    (keep a node unless a smaller kept neighbour exists)."""
    import random
    rnd = random.Random(3)
    for _ in range(3):
        n = 40
        edges = {(a, b) for a, b in ((rnd.randrange(n), rnd.randrange(n)) for _ in range(70)) if a < b}
        got = {r["node"]: r["kept"] for r in DD.greedy_keep(
            spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
        kept = set()
        nodes = sorted({x for e in edges for x in e})
        for v in nodes:
            if not any((u, v) in edges and u in kept for u in range(v)):
                kept.add(v)
        assert {v for v, k in got.items() if k} == kept
        assert set(got) == set(nodes)


def test_tag_pipeline_stages(spark):
    import __spark_entry__ as E
    from tagloom.plans import registry as R
    from tagloom.plans import tag_pipeline as PL
    ok, _ = R._payloads(spark, SF_SMALL)
    out = PL.run(R._docs(spark, SF_SMALL), T.topic_assignments(spark, SF_SMALL), ok)
    prompts = out["prompts"].collect()
    assert prompts and all("[KEYWORDS]" not in r["prompt"] and "[DOCUMENTS]" not in r["prompt"] for r in prompts)
    sel = out["selected"].collect()
    assert all((r["kind"] == "themes" and r["score"] > 0.7) or (r["kind"] == "overarching_themes" and r["score"] > 0.5)
               for r in sel)
    assert out["missing"].count() + out["tags"].select("dataset_id").distinct().join(
        R._docs(spark, SF_SMALL).select(F.col("doc_id").alias("dataset_id")), "dataset_id").count() \
        == R._docs(spark, SF_SMALL).count()
