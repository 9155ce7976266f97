"""Points against a table of centres, at any number of centres.

Up to ``MAX_BROADCAST_CELLS`` numbers the centres are sent to every task and a
point meets all of them at once. Above, points and centres are dealt into
blocks and each pair of blocks is a task of its own: a point then gets a
partial row per block of centres, which the caller merges by point.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

TILE_ROWS = 2048


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


BLOCK_ROWS = 16384  # rows of a block where every pair of blocks is a task
CELLS = 4_000_000  # cells of a distance matrix in memory at a time
PAIRS = 200_000  # pairs of vectors subtracted at a time
SLACK = 1e-11  # of |x|^2 + |y|^2: more than the rounding errors of a squared distance


def block_count(n: int, block_rows: int = BLOCK_ROWS) -> int:
    """Blocks of n points: a point is sent to as many tasks, so they are large;
    few points still give some tasks."""
    return max(1, -(-n // block_rows), min(8, n // 512))


def distances(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of the pairs (x[i], y[j]) from differences: equal
    vectors have equal distances, in whatever tile they lie."""
    out = np.empty(len(i))
    for s in range(0, len(i), PAIRS):
        diff = x[i[s:s + PAIRS]] - y[j[s:s + PAIRS]]
        out[s:s + PAIRS] = np.sqrt((diff * diff).sum(-1))
    return out


def squares(x: np.ndarray, y: np.ndarray):
    """(first row, squared distances of some rows of x to all y, |x|^2 + the
    largest |y|^2), by products: fast, right to ``SLACK`` of that sum."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    step = max(1, CELLS // max(1, len(y)))
    for s in range(0, len(x), step):
        d2 = x[s:s + step] @ y.T
        d2 *= -2
        d2 += xx[s:s + step, None]
        d2 += yy
        yield s, d2, xx[s:s + step] + yy.max()


def nearest_pairs(ia: np.ndarray, x: np.ndarray, ib: np.ndarray, y: np.ndarray, k: int) -> tuple:
    """(i, j, distance): the k nearest y of every x by (distance, ib), those of
    the same id left out. Squared distances find who can be among them,
    differences decide."""
    found, same = [], np.isin(ia, ib).any()
    kk = min(k, len(y))
    for s, d2, most in squares(x, y):
        if same:
            d2[ia[s:s + len(d2), None] == ib] = np.inf
        last = np.partition(d2, kk - 1, axis=1)[:, kk - 1]
        last = np.where(np.isnan(last), np.inf, last) + 2 * SLACK * most
        i, j = np.nonzero(~(d2 > last[:, None]))
        d = distances(x, y, s + i, j)
        good = np.isfinite(d) & (ia[s + i] != ib[j])
        i, j, d = i[good], j[good], d[good]
        order = np.lexsort((ib[j], d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((s + i[first], j[first], d[first]))
    return tuple(np.concatenate(c) for c in zip(*found))


def pairs_within(x: np.ndarray, y: np.ndarray, eps: float, digits: int = 9):
    """(i, j) of pairs whose distance, to ``digits`` digits, is at most eps."""
    reach = eps + 10.0 ** -digits
    for s, d2, most in squares(x, y):
        i, j = np.nonzero(~(d2 > (reach * reach + 2 * SLACK * most)[:, None]))
        near = np.round(distances(x, y, s + i, j), digits) <= eps
        yield s + i[near], j[near]


def sums_by_label(x: np.ndarray, y: np.ndarray, labels: np.ndarray, back: np.ndarray | None = None) -> tuple:
    """(labels, their counts, per x the sum of distances to the y of each);
    with ``back``, the labels of x, also the same per y, from the same
    distances."""
    order = np.argsort(labels, kind="stable")
    y, (names, starts, counts) = y[order], np.unique(labels[order], return_index=True, return_counts=True)
    out = np.empty((len(x), len(names)))
    if back is not None:
        own = np.argsort(back, kind="stable")
        x, (names_x, starts_x, counts_x) = x[own], np.unique(back[own], return_index=True, return_counts=True)
        turned = np.zeros((len(names_x), len(y)))
    for s, d2, most in squares(x, y):
        # short distances lose digits in products: differences give those
        i, j = np.nonzero(~(d2 > 1e-6 * most[:, None]))
        d2[i, j] = 0
        d = np.sqrt(d2, out=d2)
        d[i, j] = distances(x, y, s + i, j)
        out[s:s + len(d)] = np.add.reduceat(d, starts, axis=1)
        if back is not None:
            lo, hi = np.searchsorted(starts_x, s, "right") - 1, np.searchsorted(starts_x, s + len(d))
            turned[lo:hi] += np.add.reduceat(d, np.maximum(starts_x[lo:hi] - s, 0), axis=0)
    if back is None:
        return names, counts, out
    put = lambda rows, at: rows[np.argsort(at, kind="stable")]
    return (names, counts, put(out, own)), (names_x, counts_x, put(turned.T, order))


def scored(points: DataFrame, cents: DataFrame, cls: str, score, kind: str, centre: str = "centroid",
           tile_rows: int = TILE_ROWS) -> tuple[DataFrame, bool]:
    """Rows of ``score(points pdf, centre keys, centre matrix)`` (schema
    ``kind``) and whether a point can have several (its centres were tiled).
    Keys come in ascending order."""
    n, d = cents.agg(F.count(F.lit(1)), F.max(F.size(centre))).first()
    empty = pd.DataFrame({f.split()[0]: [] for f in kind.split(", ")})
    if (n or 0) * max(d or 0, 1) <= V.MAX_BROADCAST_CELLS:
        keys, mat = V.collect_matrix(cents, cls, centre)
        sent = points.sparkSession.sparkContext.broadcast((np.array(keys), mat))

        def run(parts):
            ks, m = sent.value
            for pdf in parts:
                if len(pdf) and len(ks):
                    yield score(pdf, ks, m)

        return points.mapInPandas(run, kind), False

    def tile(p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if p.empty or c.empty:
            return empty
        c = c.sort_values("k_")
        return score(p.drop(columns=["i_", "j_"]), c["k_"].to_numpy(), matrix(c["v_"]))

    rows = max(1, -(-points.count() // tile_rows))
    cols = -(-n // tile_rows)
    hashed = F.xxhash64(*[F.to_json(F.struct(F.col(c))) if t.startswith(("map", "struct")) else F.col(c) for c, t in points.dtypes])
    left = points.withColumn("i_", F.pmod(hashed, F.lit(rows))) \
        .withColumn("j_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))))
    right = cents.select(F.col(cls).alias("k_"), F.col(centre).alias("v_")) \
        .withColumn("j_", F.pmod(F.xxhash64("k_"), F.lit(cols))) \
        .withColumn("i_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))))
    return left.groupBy("i_", "j_").cogroup(right.groupBy("i_", "j_")).applyInPandas(lambda p, c: tile(p, c), kind), True
