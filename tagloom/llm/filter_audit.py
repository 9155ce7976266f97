"""Operator 12, filter interaction audit with a counting-Bloom duplicate prepass.

Five filters are evaluated on every whole text, whatever the others say, as a
bit mask per document; what each of them removes, in each of the 120 orders,
follows from the counts of the masks alone.

Filter E (a text that a smaller doc_id has) is the one that compares documents.
Tasks put their text hashes into sparse counting Bloom sketches (``PROBES``
counters a text, in segments chosen by the hash). The sketches of a segment are
merged; a text with a counter of 1 is unique for certain and is cleared. Only
the texts of the others are shuffled, whole, for the smallest doc_id of each;
documents that are not it fail. The sketch grows with the number of documents
(``COUNTERS`` for each), so about one unique text in 70 is not cleared, at every
size; it is compared exactly and does not fail. Within a task equal hashes are
one, so a text of very many copies is one entry a task.

Defined results: a null text is empty; a null lang is the part ''; a null
doc_id never fails E and has no label; of several labels of a document 1
holds; repeated rows count each and do not fail E by each other; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import staged

FILTERS = "ABCDE"
PROBES = 2
COUNTERS = 16
SEGMENT = 1 << 18
WAITING = 1 << 19
BROADCAST = 1 << 20
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 3


def flags(docs: DataFrame) -> DataFrame:
    """(doc_id, part, h, mask): the filters A to D as bits 0 to 3, and a hash
    of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    read = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words, distinct = F.size("words"), F.size(F.array_distinct("words"))
    upper = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))
    failed = [words < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * words,
              100 * upper.cast("long") > MAX_UPPER_PERCENT * F.length("text"), F.col("text").rlike(r"[#$%&*|]")]
    mask = sum((F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(failed)), F.lit(0))
    return read.withColumn("words", split).select("doc_id", "part", F.xxhash64("text").alias("h"), mask.alias("mask"))


class Sketch:
    """Layout of the counters: the low bits of a hash choose a segment, the
    next ``PROBES`` groups of bits a counter each."""

    def __init__(self, documents: int, segment: int = SEGMENT):
        self.segments = 1 << max(0, (-(-documents // segment) - 1).bit_length())
        self.bits = min(22, (segment * COUNTERS - 1).bit_length())

    def segment(self, h: np.ndarray) -> np.ndarray:
        return (h.view(np.uint64) & np.uint64(self.segments - 1)).astype(np.int64)

    def cells(self, h: np.ndarray) -> np.ndarray:
        """(texts, PROBES)"""
        u = h.view(np.uint64)
        at = [u >> np.uint64(64 - (i + 1) * self.bits) & np.uint64((1 << self.bits) - 1) for i in range(PROBES)]
        return np.stack(at, 1).astype(np.int32)

    def partials(self, batches):
        """One row per segment that the task's texts touch: its counters (a
        cell as often as it was hit, twice at most) and the hashes."""
        waiting, size = [], 0

        def flush():
            h, n = np.unique(np.concatenate(waiting), return_counts=True)
            segment, cells = self.segment(h), self.cells(h)
            order = np.argsort(segment, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(segment[order]) > 0, True])
            rows = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                at = order[lo:hi]
                cell, hits = np.unique(cells[np.repeat(at, np.minimum(n[at], 2))], return_counts=True)
                rows.append((int(segment[at[0]]), np.repeat(cell, np.minimum(hits, 2)), h[at]))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["segment", "cells", "hashes"])

        for b in batches:
            if b.num_rows:
                waiting.append(np.asarray(b.column("h")).copy())
                size += b.num_rows
                if size >= WAITING:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    def repeated(self, group: pa.Table) -> pa.Table:
        """Merge a segment's sketches: the hashes that are not cleared."""
        flat = lambda c: np.asarray(group.column(c).combine_chunks().flatten())
        count = np.bincount(flat("cells"), minlength=1 << self.bits)
        h = np.unique(flat("hashes"))
        return pa.table({"h": h[(count[self.cells(h)] > 1).all(axis=1)]})


def possible_repeats(known: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(h): text hashes of ``known`` that the sketches do not clear. Each hash
    that two rows have is among them."""
    sketch = Sketch(known.count(), segment)
    partial = known.select("h").mapInArrow(sketch.partials, "segment long, cells array<int>, hashes array<long>")
    return staged(partial.groupBy("segment").applyInArrow(lambda g: sketch.repeated(g), "h long"), "audit-repeats")


def first_copies(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """(doc_id, h): the smallest doc_id of each whole text whose hash is among
    ``repeats``. These are broadcast up to ``BROADCAST`` hashes, so that no
    other text is shuffled; above it, the join shuffles."""
    few = repeats.count() <= BROADCAST
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", text.alias("text")).withColumn("h", F.xxhash64("text"))
    held = read.join(F.broadcast(repeats) if few else repeats, "h", "left_semi")
    return held.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.xxhash64("text").alias("h")).distinct()


def masks(docs: DataFrame, labels: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters that they fail
    (bit i: FILTERS[i]) and their labels."""
    known = staged(flags(docs), "audit-flags")
    repeats = possible_repeats(known, segment)
    firsts = staged(first_copies(docs, repeats), "audit-firsts").withColumn("first", F.lit(True))
    few = repeats.count() <= BROADCAST
    marked = repeats.withColumn("maybe", F.lit(True))
    labelled = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copy = F.col("maybe") & F.col("first").isNull() & F.col("doc_id").isNotNull()
    whole = known.join(F.broadcast(marked) if few else marked, "h", "left").join(firsts, ["doc_id", "h"], "left") \
        .join(labelled, "doc_id", "left")
    mask = F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    no = F.lit(False)
    return whole.groupBy("part", mask.alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")) \
        .agg(F.count("*").alias("n"))


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, filter order and step from the counts of ``masks``
    (at most 128 a part): kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for i, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            steps.append({"filter_order": "".join(order), "step": i + 1, "before": before, "bit": bit})
            before |= bit
    kind = "array<struct<filter_order: string, step: int, before: int, bit: int>>"
    each = counts.withColumn("s", F.explode(F.from_json(F.lit(json.dumps(steps)), kind))).select("part", "mask", "good", "toxic", "n", "s.*")
    mask = F.col("mask")
    fails = mask.bitwiseAND(F.col("bit")) != 0
    gone = mask.bitwiseAND(F.col("before")) != 0
    removed = fails & ~gone
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    # of all orders a filter comes first among k failing ones in one k-th
    orders = F.lit(120) * F.col("n") / F.bit_count(mask)
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"), total(removed).alias("removed"), total(fails & gone).alias("redundant"),
        total(mask == F.col("bit")).alias("unique_fails"), total(removed & F.col("good")).alias("good_lost"),
        total(removed & F.col("toxic")).alias("toxic_lost"),
        F.sum(F.when(fails, orders).otherwise(0)).cast("long").alias("shapley"))
