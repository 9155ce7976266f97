"""Topic quality: NPMI coherence, diversity, weighted metric, silhouette
(A5-A8)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tiles import BLOCK_ROWS, block_count, matrix, scored, sums_by_label

EPSILON = 1e-12


def _topic_pairs(topic_words: DataFrame, cls: str, term: str) -> DataFrame:
    a = topic_words.select(F.col(cls), F.col(term).alias("w1"))
    b = topic_words.select(F.col(cls), F.col(term).alias("w2"))
    return a.join(b, cls).filter(F.col("w1") < F.col("w2"))


def npmi(topic_words: DataFrame, tokens: DataFrame, mode: str = "window", window: int = 10,
         cls: str = "topic", term: str = "term", key: str = "doc_id", pos: str = "pos",
         lengths: DataFrame | None = None) -> DataFrame:
    """A5: per-topic NPMI -> (cls, npmi); mean over topics = coherence.

    ``tokens`` = (key, pos, term), positions 0.. in each document after
    preprocessing; with the column L of ``positions`` no lengths are joined. mode 'document': a unit is a document. mode 'window': a
    unit is each run of ``window`` consecutive tokens (a document not longer
    than the window is one unit). For word pairs (w1, w2) of one topic:
    npmi = ln((p12 + eps) / (p1 p2)) / -ln(p12 + eps), eps = 1e-12.
    Only topic words are expanded into units, so the work is bounded by the
    topic words' occurrences, not by the corpus: the words of one unit
    become one sorted set (in a document one per topic, so that it stays
    small), equal sets are counted before they cross the network, and words
    and pairs are counted from them. ``lengths`` = (key, L)
    for every document, also empty ones (each empty document is one unit); by
    default it is derived from ``tokens``.
    """
    from ..functions.frames import reuse
    # worked out once; a written table's size is known, so that Spark sends it to
    # the tokens only below its broadcast bound, and joins by term above it
    topic_words = cut_lineage(topic_words.select(cls, term))
    by = [cls] if mode == "document" else []
    words = topic_words.select(*by, F.col(term).alias("term")).distinct()
    if lengths is None:
        tokens = reuse(tokens)  # read twice only when lengths come from it
        lengths = tokens.groupBy(key).agg(F.count(F.lit(1)).alias("L"))
    occ = tokens.join(words, "term")
    if mode == "document":
        n_units = lengths.agg(F.count(F.lit(1)).alias("N")).first()["N"]
        units = occ.select(key, F.lit(0).alias("u"), *by, "term")
    elif mode == "window":
        n_units = lengths.agg(F.sum(F.when(F.col("L") > window, F.col("L") - window + 1)
                                     .otherwise(F.lit(1))).alias("N")).first()["N"]
        lo = F.when(F.col("L") > window, F.greatest(F.lit(0), F.col(pos) - (window - 1))).otherwise(F.lit(0))
        hi = F.when(F.col("L") > window, F.least(F.col(pos), F.col("L") - window)).otherwise(F.lit(0))
        # dealt by document first: its windows are then formed where it lies
        occ = occ if "L" in tokens.columns else occ.join(lengths, key)
        units = (occ.repartition(key)
                    .select(key, F.explode(F.sequence(lo, hi)).alias("u"), "term"))
    else:
        raise ValueError("mode is 'document' or 'window'")
    n_units = float(n_units or 0)
    sets = reuse(units.groupBy(key, "u", *by).agg(F.array_sort(F.collect_set("term")).alias("ws"))
                      .groupBy(*by, "ws").agg(F.count(F.lit(1)).alias("c")))
    c1 = sets.select(*by, F.explode("ws").alias("w1"), "c").groupBy(*by, "w1").agg(F.sum("c").alias("c1"))
    c2 = c1.select(*by, F.col("w1").alias("w2"), F.col("c1").alias("c2"))
    later = F.transform("ws", lambda w, i: F.transform(F.slice("ws", i + 2, F.size("ws")),
                                                       lambda v: F.struct(w.alias("w1"), v.alias("w2"))))
    c12 = (sets.filter(F.size("ws") > 1).select(*by, F.explode(F.flatten(later)).alias("p"), "c")
               .groupBy(*by, "p.w1", "p.w2").agg(F.sum("c").alias("c12")))
    j = (_topic_pairs(topic_words, cls, term).join(c1, [*by, "w1"], "left").join(c2, [*by, "w2"], "left")
         .join(c12, [*by, "w1", "w2"], "left").fillna(0, ["c1", "c2", "c12"]))
    p1 = F.col("c1") / F.lit(n_units)
    p2 = F.col("c2") / F.lit(n_units)
    p12 = F.col("c12") / F.lit(n_units)
    val = F.log((p12 + EPSILON) / (p1 * p2)) / (-F.log(p12 + EPSILON))
    # a pair with a word that the corpus lacks has no association: 0
    seen = (F.col("c1") > 0) & (F.col("c2") > 0)
    return j.groupBy(cls).agg(F.avg(F.when(seen, val).otherwise(F.lit(0.0))).alias("npmi"))


def diversity(topic_words: DataFrame, k: int | None = None, cls: str = "topic",
              term: str = "term", rank: str = "rank") -> DataFrame:
    """Distinct words among the top-k of all topics / (k * topics)."""
    tw = topic_words if k is None else topic_words.filter(F.col(rank) <= k)
    g = tw.agg(F.countDistinct(term).alias("distinct_words"), F.countDistinct(cls).alias("topics"),
               F.max(rank).alias("k"))
    kk = F.lit(k) if k is not None else F.col("k")
    return g.select((F.col("distinct_words") / (kk * F.col("topics"))).alias("diversity"))


def weighted_quality(coherence: float, diversity_: float, w_c: float = 1.0, w_d: float = 1.0) -> dict:
    """Log-transformed parts and their weighted sum."""
    c = math.log((coherence + 1) / 2 + 1e-10)
    d = math.log(diversity_ + 1e-10)
    return {"log_coherence": c, "log_diversity": d, "weighted": w_c * c + w_d * d}


def weighted_quality_cols(coherence, diversity_, w_c: float = 1.0, w_d: float = 1.0):
    """A8 as column expressions (for tables of runs)."""
    c = F.log((F.col(coherence) + 1) / 2 + F.lit(1e-10))
    d = F.log(F.col(diversity_) + F.lit(1e-10))
    return c.alias("log_coherence"), d.alias("log_diversity"), (F.lit(w_c) * c + F.lit(w_d) * d).alias("weighted")


# -- A7 silhouette ------------------------------------------------------------

def _tile_schema():
    return "id long, other int, sum_d double, cnt long"


def _tile_distances(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Sums of a tile by point and label of the other side: of the left points
    and, if the tile is of two blocks, of the right ones."""
    if left.empty or right.empty:
        return pd.DataFrame({"id": pd.Series(dtype="int64"), "other": pd.Series(dtype="int32"),
                             "sum_d": pd.Series(dtype="float64"), "cnt": pd.Series(dtype="int64")})
    two = left["bl"].iat[0] != left["br"].iat[0]
    x, y, labels = matrix(left["vec"]), matrix(right["vec"]), right["label"].to_numpy()
    got = sums_by_label(x, y, labels, left["label"].to_numpy()) if two else (sums_by_label(x, y, labels),)
    return pd.concat([pd.DataFrame({"id": np.repeat(side["id"].to_numpy(), len(names)), "other": np.tile(names, len(side)).astype(np.int32),
                                    "sum_d": sums.ravel(), "cnt": np.tile(counts, len(side)).astype(np.int64)})
                      for side, (names, counts, sums) in zip((left, right), got)])


def silhouette_samples(points: DataFrame, key: str = "doc_id", vec: str = "embedding",
                       label: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A7 exact: per-point silhouette with Euclidean distance, outliers (-1)
    excluded -> (key, label, s).

    Points are hashed into B blocks; every two blocks are a tile, one pandas
    task that computes the distances in numpy, once, and sums them for either
    side per cluster of the other. No pair is ever a row. Cost is n^2 distances by
    definition; use ``simplified_silhouette`` when that is too much.
    """
    p = points.filter(F.col(label) != -1).select(F.col(key).cast("long").alias("id"),
                                                   F.col(label).cast("int").alias("label"),
                                                   F.col(vec).alias("vec"))
    n = p.count()
    blocks = block_count(n, block_rows)
    p = p.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = p.select(F.col("blk").alias("bl"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("br"),
                    "id", "label", "vec").filter("bl <= br")
    right = p.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("bl"), F.col("blk").alias("br"),
                     "id", "label", "vec").filter("bl <= br")
    tiles = (left.groupBy("bl", "br")
                 .cogroup(right.groupBy("bl", "br"))
                 .applyInPandas(lambda a, b: _tile_distances(a, b), _tile_schema()))
    # stored: both sides of the join below read it, and the distances are worked out once
    per = cut_lineage(tiles.groupBy("id", "other").agg(F.sum("sum_d").alias("sum_d"), F.sum("cnt").alias("cnt")))
    own = p.select("id", "label")
    j = per.join(own, "id")
    a = (j.filter(F.col("other") == F.col("label"))
          .select("id", "label", F.when(F.col("cnt") > 1, F.col("sum_d") / (F.col("cnt") - 1)).alias("a"),
                  (F.col("cnt") > 1).alias("nontrivial")))
    b = (j.filter(F.col("other") != F.col("label"))
          .groupBy("id").agg(F.min(F.col("sum_d") / F.col("cnt")).alias("b")))
    s = a.join(b, "id", "left").select(
        F.col("id").alias(key), "label",
        F.when(F.col("nontrivial") & F.col("b").isNotNull() & (F.greatest(F.col("a"), F.col("b")) > 0),
               (F.col("b") - F.col("a")) / F.greatest(F.col("a"), F.col("b"))).otherwise(F.lit(0.0)).alias("s"))
    return s


def silhouette(points: DataFrame, **kw) -> DataFrame:
    """A7 exact mean silhouette -> one row (silhouette)."""
    return silhouette_samples(points, **kw).agg(F.avg("s").alias("silhouette"))


def simplified_silhouette(points: DataFrame, centroids: DataFrame, key: str = "doc_id",
                          vec: str = "embedding", label: str = "label") -> DataFrame:
    """A7 centroid form: a = distance to own centroid, b = nearest other
    centroid; O(n * topics), at any number of centroids (operators/tiles.py)."""
    def score(pdf, ks, m):
        x = matrix(pdf[vec])
        d = np.sqrt(np.clip((x * x).sum(1)[:, None] + (m * m).sum(1)[None, :] - 2 * x @ m.T, 0, None))
        own = pdf[label].to_numpy()[:, None] == ks[None, :]
        return pd.DataFrame({key: pdf[key].to_numpy(), label: pdf[label].to_numpy(),
                             "a": np.where(own, d, np.inf).min(1), "b": np.where(own, np.inf, d).min(1)})

    got, tiled = scored(points.filter(F.col(label) != -1).select(key, F.col(label).cast("int").alias(label), vec), centroids, label, score,
                        f"{key} long, {label} int, a double, b double")
    if tiled:
        got = got.groupBy(key, label).agg(F.min("a").alias("a"), F.min("b").alias("b"))
    most, none = F.greatest("a", "b"), float("inf")
    s = F.when((F.col("b") < none) & (most > 0), F.when(F.col("a") < none, (F.col("b") - F.col("a")) / most)).otherwise(0.0)
    return got.select(key, label, s.alias("s"))
