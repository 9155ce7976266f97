"""kNN by inverted lists: recall against the exact scan, copies, small and
empty inputs; scoring points against centres in tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import vectors as V
from tagloom.operators import ann, tiles
from tagloom.operators import topics as TP

SCHEMA = "doc_id long, embedding array<double>"


def _clustered(n=3000, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((40, dims)) * 4
    return centre[rng.integers(0, 40, n)] + rng.standard_normal((n, dims))


def _exact(x, ids, k):
    out = {}
    for q in ids:
        d = np.round(np.sqrt(((x - x[q]) ** 2).sum(1)), 9)
        order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q]
        out[q] = [(int(i), float(d[i])) for i in order[:k]]
    return out


def _frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4)


def test_index_reaches_the_recall_with_few_lists(spark):
    x = _clustered()
    df = _frame(spark, x)
    asked = df.filter("doc_id % 50 = 0")
    got, probes, measured = ann.knn_index(df, asked, 5, leaf=32, tile=256)
    rows = {}
    for r in got.collect():
        rows.setdefault(r["a"], []).append((r["rank"], r["b"], round(r["dist"], 9)))
    exact = _exact(x, range(0, 3000, 50), 5)
    assert rows.keys() == exact.keys() and all(len(v) == 5 for v in rows.values())
    hit = sum(len({b for _, b, _ in rows[q]} & {b for b, _ in exact[q]}) for q in exact)
    assert hit / 300 >= 0.9 and measured >= 0.93
    for q, v in rows.items():  # distances are those of the vectors
        assert all(d == pytest.approx(np.linalg.norm(x[q] - x[b])) for _, b, d in v)
        assert [d for _, _, d in sorted(v)] == sorted(d for _, _, d in v)
    assert probes * 32 < 3000 / 4  # a few of the lists


def test_work_grows_less_than_n_to_the_power_of_three_halves(spark, monkeypatch):
    """Distances per query: coarse cells, their centres and the visited lists."""
    per_query = []
    for n in (1000, 4000):
        df = _frame(spark, _clustered(n))
        index = ann.build(df, 5, leaf=16)
        sizes = [r["count"] for r in index.members.groupBy("list").count().collect()]
        per_query.append(len(index.coarse) + ann.WIDE * index.n_lists / len(index.coarse) + 8 * sum(s * s for s in sizes) / n)
    assert per_query[1] / per_query[0] < 4 ** 0.5


def test_every_list_is_exact_and_copies_are_one_vector(spark):
    x = _clustered(200)
    x[120:180] = x[7]  # a large group of copies
    df = _frame(spark, x)
    index = ann.build(df, 4, leaf=8, tile=16)
    assert index.members.count() == 140  # all rows, copies once
    got = {}
    for r in ann.search(index, df, 4, index.n_lists).collect():
        got.setdefault(r["a"], []).append((r["b"], round(r["dist"], 9)))
    exact = _exact(x, range(200), 4)
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in exact.items()}
    assert sorted(got[7]) == [(120, 0.0), (121, 0.0), (122, 0.0), (123, 0.0)]
    again = {(r["a"], r["b"]) for r in ann.scan(index, df.filter("doc_id < 20"), 4).collect()}
    assert again == {(q, b) for q in range(20) for b, _ in exact[q]}


def test_small_and_empty_inputs(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (None, [1.0, 2.0])], SCHEMA)
    assert ann.knn_index(one, one, 3)[0].count() == 0
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [4.0, 6.0])], SCHEMA)
    got = {(r["a"], r["b"], r["dist"], r["rank"]) for r in ann.knn_index(two, two, 3)[0].collect()}
    assert got == {(1, 2, 0.0, 1), (1, 3, 5.0, 2), (2, 1, 0.0, 1), (2, 3, 5.0, 2), (3, 1, 5.0, 1), (3, 2, 5.0, 2)}
    assert ann.knn_index(two.limit(0), two.limit(0), 3)[0].count() == 0


def test_tiles_give_what_the_broadcast_gives(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = _frame(spark, rng.standard_normal((300, 6)))
    cents = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(rng.standard_normal((37, 6)))], "topic int, centroid array<double>")
    ask = lambda: ([(r["doc_id"], r["topic"], round(r["cosine"], 9)) for r in TP.nearest(points, cents).orderBy("doc_id").collect()],
                   [(r["doc_id"], r["topic"], round(r["prob"], 9)) for r in TP.membership(points, cents).orderBy("doc_id", "topic").collect()])
    whole = ask()
    monkeypatch.setattr(V, "MAX_BROADCAST_CELLS", 10)
    monkeypatch.setattr(tiles.scored, "__defaults__", ("centroid", 16))
    assert ask() == whole and len(whole[0]) == 300 and len(whole[1]) == 300 * 37
    assert TP.nearest(points, cents).filter(F.col("cosine") > 1 + 1e-9).count() == 0
