"""Topic tables: centroids, nearest topic, soft membership, top topics,
topic info and ordering, representative documents, outlier reassignment,
topic similarity and reduction (A11-A13, A30, A31, J10, M4, M5, W1, W7)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import reuse, top_k
from .blocks import WordBlocks, lists, placed
from .tiles import matrix, scored, unit


def centroids(points: DataFrame, cls: str = "topic", vec: str = "embedding",
              normalize: bool = True) -> DataFrame:
    """(cls, centroid array<double>) = mean vector per class, L2-normalised.

    posexplode + groupBy(class, dim) with partial aggregation: a hot class
    costs one partial row per dim per task.
    """
    comp = (points.select(F.col(cls), F.posexplode(vec).alias("i", "x"))
                  .groupBy(cls, "i").agg(F.avg(F.col("x").cast("double")).alias("m")))
    if normalize:
        comp = comp.withColumn("m", F.col("m") / F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(cls))))
    # one array per class, bounded by the vector dimension
    return (comp.groupBy(cls).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("__c"))
                .select(cls, F.transform("__c", lambda s: s["m"]).alias("centroid")))


def nearest(points: DataFrame, cents: DataFrame, cls: str = "topic", key: str = "doc_id",
            vec: str = "embedding") -> DataFrame:
    """(key, cls, cosine) of the most similar centroid (ties: smaller
    class), at any number of centroids (operators/tiles.py)."""
    def score(pdf, ks, m):
        sims = unit(matrix(pdf[vec])) @ unit(m).T
        j = np.argmax(sims, axis=1)
        return pd.DataFrame({key: pdf[key].to_numpy(), cls: ks[j].astype(np.int32), "cosine": sims[np.arange(len(pdf)), j]})

    got, tiled = scored(points.select(key, vec), cents, cls, score, f"{key} long, {cls} int, cosine double")
    return top_k(got, [key], [F.col("cosine").desc(), F.col(cls).asc()], 1).drop("rank") if tiled else got


def membership(points: DataFrame, cents: DataFrame, cls: str = "topic", key: str = "doc_id",
               vec: str = "embedding") -> DataFrame:
    """M4: (key, cls, prob) = softmax of cosine to each centroid, at any number
    of centroids. A cosine is 1 at most, so exp(cosine - 1) never overflows."""
    def score(pdf, ks, m):
        e = np.exp(unit(matrix(pdf[vec])) @ unit(m).T - 1)
        return pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), len(ks)), cls: np.tile(ks, len(pdf)).astype(np.int32),
                             "share": e.ravel(), "total": np.repeat(e.sum(axis=1), len(ks))})

    got, tiled = scored(points.select(key, vec), cents, cls, score, f"{key} long, {cls} int, share double, total double")
    # one point's row per centroid
    total = F.sum("share").over(Window.partitionBy(key)) if tiled else F.col("total")
    return got.select(key, cls, (F.col("share") / total).alias("prob"))


def top_topics(probs: DataFrame, k: int = 2, cls: str = "topic", key: str = "doc_id",
               prob: str = "prob") -> DataFrame:
    """The k most probable topics per document, outlier topic excluded."""
    return top_k(probs.filter(F.col(cls) != -1), [key], [F.col(prob).desc(), F.col(cls).asc()], k)


def topic_sizes(assign: DataFrame, cls: str = "topic") -> DataFrame:
    """A11 (counts): documents per topic."""
    return assign.groupBy(cls).agg(F.count(F.lit(1)).alias("count"))


def rank_topics(sizes: DataFrame, cls: str = "topic") -> DataFrame:
    """New topic ids by size (largest = 0), outliers stay -1.
    One row per topic, so the single ordering is bounded by the topic count."""
    w = Window.orderBy(F.col("count").desc(), F.col(cls).asc())
    real = sizes.filter(F.col(cls) != -1).withColumn("new_topic", (F.row_number().over(w) - 1).cast("int"))
    out = sizes.filter(F.col(cls) == -1).withColumn("new_topic", F.lit(-1))
    return real.unionByName(out)


def topic_info(assign: DataFrame, top: DataFrame, cls: str = "topic", term: str = "term",
               rank: str = "rank", label_words: int = 3) -> DataFrame:
    """Per topic count, label '<id>_w1_w2_w3' and the ranked words
    joined by ', '."""
    sizes = topic_sizes(assign, cls)
    words = (top.groupBy(cls).agg(F.array_sort(F.collect_list(F.struct(rank, term))).alias("__w"))
                .select(cls, F.transform("__w", lambda s: s[term]).alias("__ws")))
    return (sizes.join(words, cls, "left")
                 .select(cls, "count",
                         F.concat_ws("_", F.col(cls).cast("string"),
                                     F.array_join(F.slice("__ws", 1, label_words), "_")).alias("name"),
                         F.array_join("__ws", ", ").alias("representation")))


def doc_class_vectors(doc_counts: DataFrame, ctfidf_w: DataFrame, cls: str = "topic",
                      key: str = "doc_id") -> DataFrame:
    """Documents in c-TF-IDF space: (key, term, weight) with tf L1-normalised
    per document and the class model's idf ln(1 + A / f(t))."""
    idf = ctfidf_w.select("term", "idf").distinct()
    tot = doc_counts.groupBy(key).agg(F.sum("n").alias("__tot"))
    return (doc_counts.join(tot, key).join(idf, "term")
                      .select(key, "term", (F.col("n") / F.col("__tot") * F.col("idf")).alias("weight")))


def representative_docs(doc_vec: DataFrame, ctfidf_w: DataFrame, assign: DataFrame, n: int = 4,
                        cls: str = "topic", key: str = "doc_id") -> DataFrame:
    """The n documents of each topic most similar (cosine in c-TF-IDF
    space) to the topic's own vector; ties by id. All documents of the topic
    are scored (no sampling)."""
    dv = doc_vec.join(assign.select(key, cls), key)
    tv = ctfidf_w.select(cls, "term", F.col("weight").alias("tw"))
    dots = dv.join(tv, [cls, "term"]).groupBy(key, cls).agg(F.sum(F.col("weight") * F.col("tw")).alias("dot"))
    dn = doc_vec.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("dn"))
    tn = tv.groupBy(cls).agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"))
    sims = dots.join(dn, key).join(tn, cls).select(key, cls, (F.col("dot") / (F.col("dn") * F.col("tn"))).alias("cosine"))
    # cosines equal to 12 digits are ties (exact copies differ only by float
    # summation order); ties go to the smaller id
    return top_k(sims, [cls], [F.round("cosine", 12).desc(), F.col(key).asc()], n)


def representative_members(doc_counts: DataFrame, ctfidf_w: DataFrame, assign: DataFrame, n: int = 4,
                           cls: str = "topic", key: str = "doc_id") -> DataFrame:
    """A13 for documents that the class table was counted from: the same rows
    as ``representative_docs`` of their ``doc_class_vectors``.

    A topic's table then holds every term of its documents, so one join on
    (cls, term) brings both idf and class weight, and one aggregate gives dot
    product and norm; a document's length cancels in the cosine.
    """
    counts = doc_counts.join(assign.select(key, cls), key)
    tv = ctfidf_w.select(cls, "term", "idf", F.col("weight").alias("tw"))
    x = F.col("n") * F.col("idf")
    sims = (counts.join(tv, [cls, "term"]).groupBy(key, cls)
                  .agg(F.sum(x * F.col("tw")).alias("dot"), F.sqrt(F.sum(x * x)).alias("dn")))
    tn = tv.groupBy(cls).agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"))
    sims = sims.join(tn, cls).select(key, cls, (F.col("dot") / (F.col("dn") * F.col("tn"))).alias("cosine"))
    return top_k(sims, [cls], [F.round("cosine", 12).desc(), F.col(key).asc()], n)


def reassign_outliers(assign: DataFrame, candidates: DataFrame, threshold: float = 0.0,
                      cls: str = "topic", key: str = "doc_id", score: str = "score") -> DataFrame:
    """M5: only outlier rows (-1) move, to their best candidate topic when its
    score exceeds ``threshold``. ``candidates`` = (key, cls, score) for any
    strategy (embedding cosine, probability, c-TF-IDF cosine)."""
    c = candidates.filter(F.col(cls) != -1)
    best = top_k(c, [key], [F.col(score).desc(), F.col(cls).asc()], 1).filter(F.col(score) > threshold) \
        .select(key, F.col(cls).alias("__new"))
    return (assign.join(best, key, "left")
                  .withColumn(cls, F.when((F.col(cls) == -1) & F.col("__new").isNotNull(), F.col("__new"))
                              .otherwise(F.col(cls)))
                  .drop("__new"))


def ctfidf_candidates(doc_vec: DataFrame, ctfidf_w: DataFrame, outliers: DataFrame,
                      cls: str = "topic", key: str = "doc_id") -> DataFrame:
    """M5 'c-tf-idf' strategy scores: cosine of each outlier document with
    every topic's c-TF-IDF vector (joined on shared terms only)."""
    doc_vec, ctfidf_w = reuse(doc_vec), reuse(ctfidf_w)
    dv = doc_vec.join(outliers.select(key), key, "left_semi")
    tv = ctfidf_w.filter(F.col(cls) != -1).select(cls, "term", F.col("weight").alias("tw"))
    dots = dv.join(tv, "term").groupBy(key, cls).agg(F.sum(F.col("weight") * F.col("tw")).alias("dot"))
    dn = dv.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("dn"))
    tn = tv.groupBy(cls).agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"))
    return dots.join(dn, key).join(tn, cls).select(key, cls, (F.col("dot") / (F.col("dn") * F.col("tn"))).alias("score"))


def block_classes(blocks: WordBlocks, assign: DataFrame, cls: str = "topic", key: str = "doc_id", default: int | None = None) -> DataFrame:
    """(block, at, cls, m): the classes of each block's documents, ``m`` times
    each; of documents without one ``default``, or no row."""
    j = blocks.documents().join(assign.select(F.col(key).alias("key"), cls), "key", "inner" if default is None else "left")
    own = F.col(cls) if default is None else F.coalesce(cls, F.lit(default))
    return j.groupBy("block", "at", own.cast("int").alias(cls)).agg(F.count(F.lit(1)).alias("m"))


def block_counts(blocks: WordBlocks, classes: DataFrame, cls: str = "topic") -> DataFrame:
    """(cls, term, n) as ``terms.class_counts``: a row per block, class and word is what is shuffled."""
    def run(block: pa.Table, given: pa.Table) -> pa.Table:
        starts, at, n = lists(block, "starts", "at", "n")
        words = block.column("words").combine_chunks().flatten()
        doc = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(at)]))
        place, of, m = (np.asarray(given.column(c)) for c in ("at", cls, "m"))
        parts = []
        for t in np.unique(of):
            times = np.bincount(place[of == t], m[of == t], len(starts)).astype(np.int64)
            mine = times[doc] > 0
            total = np.bincount(at[mine], n[mine] * times[doc[mine]], len(words)).astype(np.int64)
            used = np.flatnonzero(total)
            parts.append(pa.table([pa.array(np.full(len(used), t, np.int32)), words.take(pa.array(used)), pa.array(total[used])], names=[cls, "term", "n"]))
        return pa.concat_tables(parts) if parts else pa.table({cls: pa.array([], pa.int32()), "term": pa.array([], pa.string()), "n": pa.array([], pa.int64())})

    got = blocks.apply(classes, run, f"{cls} int, term string, n long", ["starts", "words", "at", "n"])
    return got.groupBy(cls, "term").agg(F.sum("n").alias("n"))


def block_scores(blocks: WordBlocks, ctfidf_w: DataFrame, asked: DataFrame, cls: str = "topic") -> DataFrame:
    """(key, cls, cosine) in c-TF-IDF space of the documents ``asked`` (block,
    at, cls, m) with their class or, where that is null, with every class but
    -1, if the two share a term; a row of ``asked`` counts ``m`` times.

    The rows of ``ctfidf_w`` go to the blocks that use the word."""
    kind = blocks.kind
    tn = ctfidf_w.groupBy(cls).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("tn"))
    by_word = ctfidf_w.groupBy("term").agg(F.first("idf").alias("idf"), F.collect_list(F.col(cls).cast("int")).alias("of"), F.collect_list("weight").alias("w"))
    words = blocks.words().join(by_word, "term").select("block", "at", "idf", "of", "w")
    docs = asked.select("block", "at", F.lit(None).cast("double").alias("idf"), F.array(F.col(cls).cast("int"), F.col("m").cast("int")).alias("of"),
                        F.array().cast("array<double>").alias("w"))

    def run(block: pa.Table, given: pa.Table) -> pa.Table:
        starts, at, n = lists(block, "starts", "at", "n")
        keys = block.column("keys").combine_chunks().flatten()
        is_doc = pc.is_null(given.column("idf"))
        docs, words = given.filter(is_doc), given.filter(pc.invert(is_doc))
        size, ends = int(at.max()) + 1, np.r_[starts, len(at)]
        idf, = placed(words, size, "idf") if len(words) else (np.zeros(size),)
        per = np.diff(ends)
        v = n / np.repeat(np.add.reduceat(n, starts), per) * idf[at]
        norm = np.sqrt(np.add.reduceat(v * v, starts))
        word = np.repeat(np.asarray(words.column("at")), np.asarray(pc.list_value_length(words.column("of"))))
        of, w = lists(words, "of", "w")
        pairs = docs.column("of").combine_chunks().flatten()
        d, t, m = np.asarray(docs.column("at")), pairs.take(pa.array(np.arange(0, len(pairs), 2))), np.asarray(pairs)[1::2].astype(np.int64)
        every, t = np.asarray(pc.is_null(t)), np.asarray(pc.fill_null(t, -1))
        out = [], [], [], []
        for c in np.unique(of):
            mine = np.flatnonzero((t == c) & ~every | every & (c != -1))
            if not len(mine):
                continue
            tv, has, here = np.zeros(size), np.zeros(size, bool), np.zeros(len(starts), bool)
            tv[word[of == c]], has[word[of == c]], here[d[mine]] = w[of == c], True, True
            cells = np.flatnonzero(np.repeat(here, per))
            which = np.cumsum(here) - 1
            first = np.r_[0, np.cumsum(per[here])[:-1]]
            dot = np.add.reduceat(v[cells] * tv[at[cells]], first)[which[d[mine]]]
            shared = np.add.reduceat(has[at[cells]].astype(np.int32), first)[which[d[mine]]] > 0
            for o, x in zip(out, (d[mine], np.full(len(mine), c), dot * m[mine], norm[d[mine]])):
                o.append(x[shared])
        d, c, dot, dn = (np.concatenate(o) if o else np.zeros(0) for o in out)
        return pa.table([keys.take(pa.array(d, pa.int64())), pa.array(c, pa.int32()), pa.array(dot, pa.float64()), pa.array(dn, pa.float64())],
                        names=["key", cls, "dot", "dn"])

    got = blocks.apply(words.unionByName(docs), run, f"key {kind}, {cls} int, dot double, dn double", ["keys", "starts", "at", "n"])
    return got.join(F.broadcast(tn), cls).select("key", cls, (F.col("dot") / (F.col("dn") * F.col("tn"))).alias("cosine"))


def block_candidates(blocks: WordBlocks, ctfidf_w: DataFrame, outliers: DataFrame, cls: str = "topic", key: str = "doc_id") -> DataFrame:
    """The rows of ``ctfidf_candidates`` for documents in blocks."""
    asked = blocks.documents().join(outliers.select(F.col(key).alias("key")), "key", "left_semi") \
        .select("block", "at", F.lit(None).cast("int").alias(cls), F.lit(1).alias("m"))
    return block_scores(blocks, ctfidf_w, asked, cls).select(F.col("key").alias(key), cls, F.col("cosine").alias("score"))


def block_representatives(blocks: WordBlocks, ctfidf_w: DataFrame, assign: DataFrame, n: int = 4, cls: str = "topic", key: str = "doc_id") -> DataFrame:
    """The rows of ``representative_docs`` for documents in blocks."""
    sims = block_scores(blocks, ctfidf_w, block_classes(blocks, assign, cls, key), cls).select(F.col("key").alias(key), cls, "cosine")
    return top_k(sims, [cls], [F.round("cosine", 12).desc(), F.col(key).asc()], n)


def topic_similarity(ctfidf_w: DataFrame, cls: str = "topic") -> DataFrame:
    """Cosine between topics' c-TF-IDF vectors, (t1, t2, cosine), t1 < t2,
    joined on shared terms (one row per term per topic pair sharing it)."""
    ctfidf_w = reuse(ctfidf_w)
    a = ctfidf_w.select(F.col(cls).alias("t1"), "term", F.col("weight").alias("w1"))
    b = ctfidf_w.select(F.col(cls).alias("t2"), "term", F.col("weight").alias("w2"))
    dots = a.join(b, "term").filter(F.col("t1") < F.col("t2")).groupBy("t1", "t2") \
            .agg(F.sum(F.col("w1") * F.col("w2")).alias("dot"))
    n = ctfidf_w.groupBy(cls).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("nrm"))
    n1 = n.select(F.col(cls).alias("t1"), F.col("nrm").alias("n1"))
    n2 = n.select(F.col(cls).alias("t2"), F.col("nrm").alias("n2"))
    return dots.join(n1, "t1").join(n2, "t2").select("t1", "t2", (F.col("dot") / (F.col("n1") * F.col("n2"))).alias("cosine"))
