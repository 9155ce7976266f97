"""Operator 8, SimHash near-dedup by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all its variants within half the radius
(radius 2: itself and its 64 one-bit flips). Two fingerprints within the
radius share at least one variant, so a shuffle on variants brings every
linked pair together, exactly. A variant's group holds at most 65 distinct
fingerprints (those within half the radius of it), whatever the data; each is
linked to the group's smallest and the pair is verified by its bit distance.
Copies share one fingerprint and are never expanded into pairs.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of
``SHINGLE`` words joined by a space (repeats included; fewer words: the whole
sequence), XXH64 with seed 42; a bit is 1 if set in over half the hashes.

Defined results: a null, empty or blank text has fingerprint zero and links
like any other; repeated rows are copies; a null doc_id joins the components
but never names one unless all its members are null; an empty table gives an
empty result; further columns are kept by ``keep_one`` and else ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import components, parted, slices, staged, whole, words_of

SHINGLE = 3
RADIUS = 2
SEED = 42
RUN = 1 << 16  # shingles hashed at a time


def _prints(texts: pa.Array) -> np.ndarray:
    words, row = words_of(texts, lower=True)
    n = np.bincount(row, minlength=len(texts))
    start = np.cumsum(n) - n
    parts, rows = [], []
    if len(words) >= SHINGLE:
        whole = np.flatnonzero(row[:len(row) - SHINGLE + 1] == row[SHINGLE - 1:])
        joined = pc.binary_join_element_wise(
            *[words.slice(j, len(words) - SHINGLE + 1) for j in range(SHINGLE)], pa.scalar(" ", words.type)).take(pa.array(whole))
        parts.append(joined)
        del joined
        rows.append(row[whole])
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        parts.append(pa.array([" ".join(words.slice(int(start[i]), int(n[i])).to_pylist()) for i in short],
                              pa.large_string()))
        rows.append(short)
    out = np.zeros(len(texts), np.uint64)
    if not parts:
        return out
    digest = xxhash.xxh64_intdigest
    # few shingles at a time are Python objects
    hashes = np.concatenate([np.fromiter((digest(s, SEED) for s in p.slice(lo, RUN).cast(pa.large_binary()).to_pylist()),
                                         np.uint64, min(RUN, len(p) - lo)) for p in parts for lo in range(0, len(p), RUN)])
    del parts
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    hashes, rows = hashes[order], rows[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    size = np.diff(np.r_[first, len(rows)])
    got = np.zeros(len(first), np.uint64)
    for bit in range(64):
        ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), first)
        got |= (2 * ones > size.astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    out[rows[first]] = got
    return out


def _fingerprints(batches):
    for b in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").cast(pa.int64()), b.column("content"),
             pa.array(_prints(b.column("text")).view(np.int64))], names=["doc_id", "content", "fp"])
        pa.default_memory_pool().release_unused()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, content hash, fp long) of every document, in the shared folder."""
    return staged(docs.select("doc_id", "text", F.xxhash64("text").alias("content"))
                  .mapInArrow(_fingerprints, "doc_id long, content long, fp long"), "simhash")


def linked(distinct_fps: DataFrame) -> DataFrame:
    """(a, b): edges over distinct fingerprints whose components are those of
    the links at ``RADIUS`` or fewer differing bits."""
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)])
    near = distinct_fps.select("fp", F.explode(flips).alias("flip")) \
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    low = F.min("fp").over(Window.partitionBy("variant"))
    met = near.withColumn("low", low).filter("fp > low")
    return met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))) <= RADIUS) \
        .select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def group(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, content, fp, component_id (the smallest
    doc_id reachable by links) and first: whether the row is the group's
    smallest by (doc_id, content); its repeated rows are all marked."""
    prints = fingerprints(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")
    classes = prints.groupBy("fp").agg(F.min(order).alias("best"))
    comp = components(linked(classes.select("fp")), "simhash-links")
    named = classes.join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left") \
        .withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("best").alias("best"))
    of_fp = named.select("fp", "component").join(least, "component").select("fp", "best")
    first = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & F.col("content").eqNullSafe(F.col("best.content"))
    return prints.join(of_fp, "fp").select(
        "doc_id", "content", "fp", F.col("best.doc_id").alias("component_id"), first.alias("first"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, one of each group: the smallest
    by (doc_id, content); of its repeated rows, one."""
    best = group(docs).filter("first").select("doc_id", "content").distinct().toDF("id", "key")
    rows = docs.select(whole(docs.columns), F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"))
    got = rows.join(best, F.col("d").eqNullSafe(F.col("id")) & (F.col("t") == F.col("key")), "left_semi")
    return got.dropDuplicates(["d", "t"]).select(*parted(docs.columns))
