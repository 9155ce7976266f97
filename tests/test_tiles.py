"""Tiles of distances against plain all-pairs numbers, chunked and not."""

import numpy as np
import pytest

from tagloom.operators import tiles as TI


@pytest.fixture(params=[4_000_000, 1000])
def points(request, monkeypatch):
    monkeypatch.setattr(TI, "CELLS", request.param)
    monkeypatch.setattr(TI, "PAIRS", max(7, request.param // 1000))
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 64)).astype("f4").astype(float)
    x[100:140], x[200:230] = x[0], x[1] + 1e-7  # copies, and points so close that products lose the distance
    return r.permutation(300) * 3, x, np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def test_nearest_pairs_are_exact_with_ties_by_id(points):
    ids, x, d = points
    d = np.where(ids[:, None] == ids, np.inf, d)
    i, j, got = TI.nearest_pairs(ids, x, ids, x, 5)
    want = [(ids[a], ids[b], d[a, b]) for a in range(len(x)) for b in np.lexsort((ids, d[a]))[:5]]
    assert want == list(zip(ids[i], ids[j], got))
    broken = x.copy()
    broken[7, 3] = np.nan  # no neighbour of any, and more neighbours asked for than there are
    i, j, _ = TI.nearest_pairs(ids, broken, ids[:9], broken[:9], 20)
    assert 7 not in i and 7 not in j and len(i) == 8 * 7 + (len(x) - 9) * 8


def test_pairs_within_and_sums_by_label_are_exact(points):
    ids, x, d = points
    eps = float(np.median(d))
    got = set()
    for i, j in TI.pairs_within(x, x[:99], eps):
        got |= set(zip(i, j))
    assert got == set(zip(*np.nonzero(np.round(d[:, :99], 9) <= eps)))
    labels = ids[:230] % 7
    names, counts, sums = TI.sums_by_label(x, x[:230], labels)
    assert counts.tolist() == [(labels == n).sum() for n in names]
    assert np.allclose(sums, np.stack([d[:, :230][:, labels == n].sum(1) for n in names], 1), rtol=1e-10, atol=0)


def test_copies_of_a_point_grow_slowly():
    assert TI.block_count(10) == 1 and TI.block_count(10_000) == 8
    assert TI.block_count(615_000) < 40  # 4,805 blocks of 128 rows before


def test_sums_of_either_side_come_from_one_distance(points, monkeypatch):
    ids, x, d = points
    labels, seen = ids % 7, []
    monkeypatch.setattr(TI, "squares", lambda a, b, keep=TI.squares: seen.append(len(a) * len(b)) or keep(a, b))
    one, two = TI.sums_by_label(x[:200], x[200:], labels[200:], labels[:200])
    for (names, counts, sums), full, of in ((one, d[:200, 200:], labels[200:]), (two, d[:200, 200:].T, labels[:200])):
        assert counts.tolist() == [(of == n).sum() for n in names]
        assert np.allclose(sums, np.stack([full[:, of == n].sum(1) for n in names], 1), rtol=1e-10, atol=0)
    assert seen == [200 * 100]
