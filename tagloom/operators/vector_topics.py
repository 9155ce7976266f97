"""Topics as vectors: the hierarchy of topics (A31), merging of close topics
and reduction by vectors (M8)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, normalize
from ..session import Rounds, cut_lineage
from .cluster import components
from .tiles import matrix, scored, unit
from .topics import nearest


def agglomerate(sims: DataFrame, topics: DataFrame, cls: str = "topic") -> DataFrame:
    """Average-linkage hierarchy of topics as a merge table (step, left,
    right, distance, size), T - 1 rows for T topics.

    ``sims`` = (t1, t2, cosine) of the pairs that are similar at all; distance is
    1 - the mean cosine over the pairs of two groups (absent pairs: 0). A group
    is named by its smallest topic. The chains of nearest neighbours end in
    pairs that are each other's nearest; all of these merge in one round, which
    average linkage allows in any order. Sums of cosines and sizes add up, so a
    round is one aggregation. Groups that share nothing merge last, at
    distance 1, by id. Ties go to the smaller ids."""
    rounds = Rounds(sims.sparkSession)
    group = rounds.keep(topics.select(F.col(cls).cast("long").alias("g")).distinct().withColumn("n", F.lit(1).cast("long")))
    pair = rounds.keep(sims.filter("cosine > 0").select(F.least("t1", "t2").cast("long").alias("x"), F.greatest("t1", "t2").cast("long").alias("y"),
                                                        F.col("cosine").alias("s")))
    merges, i = [], 0
    of = lambda c, n: group.select(F.col("g").alias(c), F.col("n").alias(n))
    while not pair.isEmpty():
        # distances to 12 digits, so that equal ones tie in any order of summation
        d = pair.join(of("x", "nx"), "x").join(of("y", "ny"), "y").withColumn("d", F.round(1 - F.col("s") / (F.col("nx") * F.col("ny")), 12))
        edge = F.struct("d", "x", "y")
        both = d.select(F.col("x").alias("g"), edge.alias("e"), "nx", "ny").unionByName(d.select(F.col("y").alias("g"), edge.alias("e"), "nx", "ny"))
        best = both.groupBy("g").agg(F.min(F.struct("e", "nx", "ny")).alias("m"))
        mutual = rounds.keep(best.groupBy("m").agg(F.count(F.lit(1)).alias("c")).filter("c = 2")
                             .select("m.e.d", "m.e.x", "m.e.y", (F.col("m.nx") + F.col("m.ny")).alias("n"), F.lit(i).alias("round")))
        merges.append(mutual)
        to = mutual.select(F.col("y").alias("old"), F.col("x").alias("new"))
        name = lambda df, c: df.join(to.select(F.col("old").alias(c), F.col("new").alias("_")), c, "left") \
            .withColumn(c, F.coalesce("_", c)).drop("_")
        moved = name(name(pair, "x"), "y").filter("x <> y")
        pair = rounds.keep(moved.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.sum("s").alias("s")))
        group = rounds.keep(name(group, "g").groupBy("g").agg(F.sum("n").alias("n")))
        i += 1
    order = Window.orderBy("g")  # one row per group that is similar to no other
    rest = group.select(F.lit(1.0).alias("d"), F.min("g").over(order).alias("x"), F.col("g").alias("y"),
                        F.sum("n").over(order).alias("n"), F.lit(i).alias("round")).filter("x <> y")
    for m in merges:
        rest = rest.unionByName(m.select(*rest.columns))
    step = F.row_number().over(Window.orderBy("d", "round", "x", "y"))  # one row per topic
    out = cut_lineage(rest.select(step.cast("long").alias("step"), F.col("x").alias("left"), F.col("y").alias("right"),
                                  F.col("d").alias("distance"), F.col("n").alias("size")))
    rounds.drop()
    return out


def close_pairs(cents: DataFrame, least: float, cls: str = "topic") -> DataFrame:
    """(a, b, cosine), a < b: pairs of centroids at a cosine of ``least`` or more."""
    def score(pdf, ks, m):
        cosine = (unit(matrix(pdf["v"])) @ unit(m).T).round(12)
        row, col = ((cosine >= least) & (pdf["a"].to_numpy()[:, None] < ks[None, :])).nonzero()
        return pd.DataFrame({"a": pdf["a"].to_numpy()[row], "b": ks[col], "cosine": cosine[row, col]})

    rows = cents.select(F.col(cls).cast("long").alias("a"), F.col("centroid").alias("v"))
    return scored(rows, cents, cls, score, "a long, b long, cosine double")[0]


def _weighted(rows: DataFrame, by: str) -> DataFrame:
    """(by, size, centroid): means of centroids weighted by size, of length 1."""
    part = rows.select(by, "size", F.posexplode("centroid").alias("i", "x")).groupBy(by, "i") \
        .agg((F.sum(F.col("x") * F.col("size")) / F.sum("size")).alias("m"))
    mean = part.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select(by, normalize(F.transform("c", lambda s: s["m"])).alias("centroid"))
    return rows.groupBy(by).agg(F.sum("size").alias("size")).join(mean, by)


def merge_close(cents: DataFrame, least: float = 0.9, cls: str = "topic") -> tuple[DataFrame, DataFrame]:
    """M8: merge centroids (cls, centroid, size) that are close, directly or by
    others between, into their weighted mean, until no two are. Returns the new
    centroids and (cls, new); a merged topic has its smallest old name."""
    cur = cut_lineage(cents.select(F.col(cls).cast("long").alias(cls), F.col("size").cast("long").alias("size"), "centroid"))
    name = cut_lineage(cur.select(cls, F.col(cls).alias("new")))
    while True:
        pairs = cut_lineage(close_pairs(cur, least, cls))
        if pairs.isEmpty():
            return cur, name
        comp = components(pairs.select("a", "b")).select(F.col("node").alias(cls), "comp")
        cur = cut_lineage(_weighted(cur.join(comp, cls, "left").withColumn(cls, F.coalesce("comp", cls)).drop("comp"), cls))
        name = cut_lineage(name.join(comp.withColumnRenamed(cls, "new"), "new", "left").select(cls, F.coalesce("comp", "new").alias("new")))


def reassign_merged(points: DataFrame, assign: DataFrame, cents: DataFrame, names: DataFrame, cls: str = "topic", key: str = "doc_id",
                    vec: str = "embedding") -> DataFrame:
    """(key, cls): documents of topics that took part in a merge go to their
    nearest centroid; the others keep their topic, unread."""
    touched = names.filter(F.col(cls) != F.col("new")).select(F.col("new").alias("t")).distinct()
    moved = names.join(touched, F.col("new") == F.col("t"), "left_semi").select(cls)
    own = assign.select(F.col(key).cast("long").alias(key), F.col(cls).cast("long").alias(cls))
    left = own.join(moved, cls, "left_anti").select(key, cls)
    again = points.join(own.join(moved, cls, "left_semi").select(key), key, "left_semi")
    return left.unionByName(nearest(again, cents, cls, key, vec).select(key, F.col(cls).cast("long").alias(cls)))


def reduce_by_vectors(points: DataFrame, assign: DataFrame, cents: DataFrame, n: int, cls: str = "topic", key: str = "doc_id",
                      vec: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """M8: the smallest topic joins its nearest one (weighted mean), its
    documents and those of that one go to their nearest centroid, until ``n``
    topics are left. A round compares one centroid with the others and reads the
    vectors of two topics. Returns (key, cls) and the centroids with sizes."""
    cur = cut_lineage(cents.select(F.col(cls).cast("long").alias(cls), "centroid"))
    own = cut_lineage(assign.select(F.col(key).cast("long").alias(key), F.col(cls).cast("long").alias(cls)))
    while True:
        sizes = own.groupBy(cls).agg(F.count(F.lit(1)).alias("size"))
        sized = cut_lineage(cur.join(sizes, cls, "left").select(cls, F.coalesce("size", F.lit(0)).alias("size"), "centroid"))
        if sized.count() <= max(n, 1):
            return own, sized
        small = sized.orderBy("size", cls).first()
        unit_vec = F.array(*[F.lit(float(x)) for x in small["centroid"]])
        cosine = F.round(dot("centroid", unit_vec) / F.sqrt(dot("centroid", "centroid")), 12)
        other = sized.filter(F.col(cls) != small[cls]).orderBy(cosine.desc(), cls).first()
        two = F.col(cls).isin(small[cls], other[cls])
        # empty topics count as one document, so that a mean is always defined
        pair = sized.filter(two).select(F.lit(other[cls]).alias(cls), F.greatest("size", F.lit(1)).alias("size"), "centroid")
        cur = cut_lineage(sized.filter(~two).select(cls, "centroid").unionByName(_weighted(pair, cls).select(cls, "centroid")))
        again = points.join(own.filter(two).select(key), key, "left_semi")
        own = cut_lineage(own.filter(~two).unionByName(nearest(again, cur, cls, key, vec).select(key, F.col(cls).cast("long").alias(cls))))
