"""J11 by an index: inverted lists in two levels, all rows indexed.

Vectors that are equal are one (a group of copies is never compared within
itself). Of the distinct vectors one in ``LEAF`` is a list centre and of these
one in the square root of their number is a coarse centre, both drawn by a
hash. A vector looks for its centre only among those of its nearest coarse
centres, so building costs n * (coarse + a few cells of centres) distances, and
belongs to the list of the nearest. A search visits the ``probes`` nearest
lists of a query, each list cut into tiles; k neighbours a tile go on and are
merged by query. Large cells and lists are split, so no task holds more than a
tile of each side.

The number of probes is set by measurement: it doubles until the recall of a
sample of the queries, against a scan of all rows, reaches ``recall``. When all
lists are visited the search is exact. Vectors without structure need many
probes (no index helps them); clustered ones a few.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import top_k
from ..functions.vectors import MAX_BROADCAST_CELLS
from ..session import cut_lineage
from .tiles import matrix

LEAF = 64
TILE = 2048
SAMPLE = 128
WIDE = 3
SEED = 13


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances; near ones are worked out from differences, so
    that equal vectors have exactly 0."""
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    near = np.argwhere(d < 1e-6 * ((x * x).sum(1)[:, None] + 1e-300))
    if len(near):
        d[near[:, 0], near[:, 1]] = ((x[near[:, 0]] - y[near[:, 1]]) ** 2).sum(1)
    return np.sqrt(np.maximum(d, 0))


def _best(ids: np.ndarray, others: np.ndarray, d: np.ndarray, k: int, a: str, b: str) -> pd.DataFrame:
    """The k nearest of each row by (distance, id)."""
    order = np.argsort(others, kind="stable")
    others, d = others[order], d[:, order]
    k = min(k, d.shape[1])
    # all that is as near as the k-th, then by (distance, id)
    limit = np.partition(d, k - 1, axis=1)[:, k - 1]
    row, col = np.nonzero(d <= limit[:, None])
    o = np.lexsort((col, d[row, col], row))
    row, col = row[o], col[o]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    keep = nth < k
    return pd.DataFrame({a: ids[row[keep]], b: others[col[keep]], "dist": d[row[keep], col[keep]]})


def _in_tiles(left: DataFrame, right: DataFrame, by: str, k: int, a: str, b: str, tile: int) -> DataFrame:
    """(a, b, dist): for each row (a, va, by) of ``left`` its k nearest rows
    (b, vb, by) of ``right`` with the same ``by`` (several times k if they are
    in several tiles). Both sides are cut into tiles by their size."""
    def dealt(df: DataFrame, n_name: str, i_name: str, id_name: str) -> DataFrame:
        n = df.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / tile).alias(n_name))
        return n, df.join(n, by).withColumn(i_name, F.pmod(F.xxhash64(id_name, F.lit(1)), F.col(n_name))).drop(n_name)

    n_left, rows = dealt(left, "nl", "i", a)
    n_right, cols = dealt(right, "nr", "j", b)
    one = F.lit(1).cast("long")
    rows = rows.join(n_right, by).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nr") - one))).drop("nr")
    cols = cols.join(n_left, by).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nl") - one))).drop("nl")

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty or q.empty:
            return pd.DataFrame({a: [], b: [], "dist": []})
        return _best(p[a].to_numpy(), q[b].to_numpy(), _distances(matrix(p["va"]), matrix(q["vb"])), k, a, b)

    return rows.groupBy(by, "i", "j").cogroup(cols.groupBy(by, "i", "j")).applyInPandas(
        lambda p, q: run(p, q), f"{a} long, {b} long, dist double")


@dataclass
class Index:
    """members (list, b, vb): every distinct vector in its list; centres
    (coarse, centre, vb); copies (b, i, id): the smallest ids of a vector."""
    members: DataFrame
    centres: DataFrame
    copies: DataFrame
    coarse: np.ndarray
    coarse_ids: np.ndarray
    n_lists: int
    tile: int

    def near_coarse(self, rows: DataFrame, width: int) -> DataFrame:
        """``rows`` (a, va) with each of their ``width`` nearest coarse cells."""
        sent = rows.sparkSession.sparkContext.broadcast((self.coarse, self.coarse_ids))
        width = min(width, len(self.coarse))

        def run(parts):
            mat, ids = sent.value
            for p in parts:
                if len(p):
                    d = _distances(matrix(p["va"]), mat)
                    near = ids[np.argsort(d, axis=1, kind="stable")[:, :width]]
                    yield pd.DataFrame({"a": np.repeat(p["a"].to_numpy(), width), "va": np.repeat(p["va"].to_numpy(), width),
                                        "coarse": near.ravel()})

        return rows.mapInPandas(run, "a long, va array<double>, coarse long")

    def lists_of(self, rows: DataFrame, probes: int) -> DataFrame:
        """(a, list): the ``probes`` nearest lists of each row (a, va)."""
        per_cell = max(1, self.n_lists // max(1, len(self.coarse)))
        cells = self.near_coarse(rows, WIDE + -(-2 * probes // per_cell))
        found = _in_tiles(cells, self.centres, "coarse", probes, "a", "centre", self.tile)
        return top_k(found, ["a"], [F.col("dist"), F.col("centre")], probes, "nth").select("a", F.col("centre").alias("list"))


def _distinct(points: DataFrame, k: int, key: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (b: their smallest id, vb) and the k smallest ids of each."""
    rows = points.select(F.col(key).cast("long").alias("id"), F.transform(vec, lambda x: x.cast("double") + 0.0).alias("vb")) \
        .filter(F.col("id").isNotNull() & F.col("vb").isNotNull())
    first = rows.groupBy("vb").agg(F.min("id").alias("b"))
    ids = top_k(rows, ["vb"], [F.col("id")], k, "i").join(first, "vb").select("b", "i", "id")
    return first, ids


def build(points: DataFrame, k: int, key: str = "doc_id", vec: str = "embedding", leaf: int = LEAF, tile: int = TILE) -> Index:
    """Index all rows for searches of up to ``k`` neighbours."""
    first, ids = _distinct(points, k + 1, key, vec)
    first, ids = cut_lineage(first), cut_lineage(ids)
    n, dims = first.agg(F.count(F.lit(1)), F.max(F.size("vb"))).first()
    lists = max(1, -(-n // leaf))
    draw = lambda seed: F.pmod(F.xxhash64("b", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    own = first.withColumn("u", draw(SEED))
    centres = own.filter(F.col("u") < lists / max(n, 1)).drop("u")
    if centres.isEmpty():
        centres = first.orderBy("b").limit(1)
    centres = cut_lineage(centres.select(F.col("b").alias("centre"), "vb"))
    n_lists = max(1, centres.count())
    most = max(1, MAX_BROADCAST_CELLS // max(1, dims or 1))
    part = min(n_lists ** 0.5, most / 2) / n_lists
    drawn = centres.filter(F.pmod(F.xxhash64("centre", F.lit(SEED + 1)), F.lit(1 << 30)) < int(part * (1 << 30))).orderBy("centre").limit(most).collect()
    drawn = drawn or centres.orderBy("centre").limit(1).collect()
    coarse = np.array([r["vb"] for r in drawn], float).reshape(len(drawn), dims if dims and dims > 0 else 1)
    index = Index(first, centres, ids, coarse, np.array([r["centre"] for r in drawn], np.int64), n_lists, tile)
    if n:
        placed = index.near_coarse(centres.select(F.col("centre").alias("a"), F.col("vb").alias("va")), 1)
        index.centres = cut_lineage(placed.select("coarse", F.col("a").alias("centre"), F.col("va").alias("vb")))
        rows = first.select(F.col("b").alias("a"), F.col("vb").alias("va"))
        lists_of = index.lists_of(rows, 1).select(F.col("a").alias("b"), "list")
        index.members = cut_lineage(first.join(lists_of, "b").select("list", "b", "vb"))
    return index


def _neighbours(found: DataFrame, queries: DataFrame, index: Index, k: int) -> DataFrame:
    """Neighbours (a, b, dist) among distinct vectors -> among ids, for the
    query ids of each vector."""
    best = top_k(found, ["a"], [F.col("dist"), F.col("b")], k + 1, "nth").drop("nth")
    each = queries.join(best, "a").join(index.copies, "b").filter("id <> query")
    return top_k(each.select(F.col("query").alias("a"), F.col("id").alias("b"), "dist"), ["a"], [F.col("dist"), F.col("b")], k)


def _of(queries: DataFrame, key: str, vec: str) -> DataFrame:
    return queries.select(F.col(key).cast("long").alias("query"), F.transform(vec, lambda x: x.cast("double") + 0.0).alias("va")) \
        .filter(F.col("query").isNotNull() & F.col("va").isNotNull())


def search(index: Index, queries: DataFrame, k: int, probes: int, key: str = "doc_id", vec: str = "embedding") -> DataFrame:
    """(a, b, dist, rank): k neighbours of each query row in its ``probes``
    nearest lists, itself excluded, ties by id."""
    rows = _of(queries, key, vec).join(index.members.select("b", F.col("vb").alias("va")), "va", "left") \
        .withColumn("a", F.coalesce("b", -F.col("query") - 1)).drop("b")
    once = rows.groupBy("a").agg(F.first("va").alias("va"))
    asked = index.lists_of(once, min(probes, index.n_lists)).join(once, "a")
    found = _in_tiles(asked, index.members, "list", k + 1, "a", "b", index.tile)
    return _neighbours(found, rows.select("a", "query"), index, k)


def scan(index: Index, queries: DataFrame, k: int, key: str = "doc_id", vec: str = "embedding") -> DataFrame:
    """The same, exactly: the given few queries (collected) against all rows."""
    rows = _of(queries, key, vec)
    known = {r["query"]: r["va"] for r in rows.collect()}
    ids = np.array(sorted(known), np.int64)
    sent = queries.sparkSession.sparkContext.broadcast((ids, np.array([known[i] for i in ids], float)))

    def run(parts):
        asked, mat = sent.value
        for p in parts:
            if len(p) and len(asked):
                yield _best(asked, p["b"].to_numpy(), _distances(mat, matrix(p["vb"])), k + 1, "a", "b")

    found = index.members.select("b", "vb").mapInPandas(run, "a long, b long, dist double")
    own = queries.select(F.col(key).cast("long").alias("a"), F.col(key).cast("long").alias("query"))
    return _neighbours(found, own, index, k)


def recall(got: DataFrame, exact: DataFrame, k: int) -> float:
    """Share of the exact neighbours found; one as near as the k-th counts."""
    limit = exact.groupBy("a").agg(F.max("dist").alias("limit"), F.count(F.lit(1)).alias("n"))
    hits = got.join(limit, "a").filter(F.round("dist", 9) <= F.round("limit", 9)).groupBy("a").agg(F.count(F.lit(1)).alias("hit"))
    row = limit.join(hits, "a", "left").agg(F.sum(F.least(F.coalesce("hit", F.lit(0)), F.col("n"))), F.sum("n")).first()
    return (row[0] / row[1]) if row[1] else 1.0


def knn_index(points: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", vec: str = "embedding", at_least: float = 0.93,
              leaf: int = LEAF, tile: int = TILE, sample: int = SAMPLE) -> tuple[DataFrame, int, float]:
    """Neighbours (a, b, dist, rank) of the query rows among all points, the
    number of probes chosen and the recall that the sample had with it.
    ``at_least`` is the recall that at most ``sample`` queries, drawn by a
    hash, must reach."""
    index = build(points, k, key, vec, leaf, tile)
    if not len(index.coarse):  # no vector at all
        none = points.sparkSession.createDataFrame([], "a long, b long, dist double, rank long")
        return none, 0, 1.0
    drawn = cut_lineage(queries.orderBy(F.xxhash64(F.col(key), F.lit(SEED)), key).limit(sample))
    exact = cut_lineage(scan(index, drawn, k, key, vec))
    probes, got = 4, 0.0
    while True:
        probes = min(probes, index.n_lists)
        got = recall(search(index, drawn, k, probes, key, vec), exact, k)
        if got >= at_least or probes == index.n_lists:
            break
        probes *= 2
    return search(index, queries, k, probes, key, vec), probes, got
