"""Operator 1, quality rules: cross-document line frequency.

Lines are normalised (A-Z lower-cased, words joined by one space) and hashed.
Per host (``source``) the distinct documents (by doc_id and text) holding a
line are counted, copies of a text like any others. A line found in more than
``max_docs`` documents of a host is removed there from all of them but the
first (smallest doc_id), so that no line vanishes from the host. A document is
rejected when the base rules fail or when less than ``min_share`` of its words
remain.

Defined results: a null text has no words and fails the base rules; a null
source is a host of its own; repeated rows are one document and get the same
verdict each; rows of one doc_id with several texts are documents of their own,
all first if the doc_id is; a null doc_id is first only among null ones; an
empty table gives an empty result; further columns, whatever their names, are
ignored (``decide``) or kept (``clean``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import parted, slices, staged, whole, words_of

#: fixed values: the symbols that the base rules count
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MAX_DOCS = 20
MIN_SHARE = 0.3

_FACTS = ("doc_id long, host string, doc long, n_words long, word_chars long, n_symbols long, "
          "n_dup_lines long, n_repeat_words long, line_hash array<long>, line_words array<long>")


def line_hash(line: bytes) -> int:
    """Signed 64-bit hash of a line's normal form; 0 words give 0."""
    h = xxhash.xxh3_64_intdigest(b" ".join(line.lower().split()))
    return h - (1 << 64) if h >> 63 else h


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step (splitmix64's constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _repeated(codes: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Per row: words standing in a window that occurs twice or more in it."""
    n = len(codes) - WINDOW + 1
    if n <= 0:
        return np.zeros(n_rows, np.int64)
    key = _mixed(row[:n].astype(np.uint64) + np.uint64(1))
    word = _mixed(codes.astype(np.uint64) + np.uint64(1 << 40))
    for j in range(WINDOW):
        key = _mixed(key + word[j:n + j])
    at = np.flatnonzero(row[:n] == row[WINDOW - 1:])
    _, back, count = np.unique(key[at], return_inverse=True, return_counts=True)
    hit = at[count[back] > 1]
    mark = np.zeros(len(codes), bool)
    for j in range(WINDOW):
        mark[hit + j] = True
    return np.bincount(row[mark], minlength=n_rows)


def _facts(batches):
    for b in slices(batches, "text"):
        words, row = words_of(b.column("text"), lower=False)
        n = b.num_rows
        codes = np.asarray(words.dictionary_encode().indices)
        chars = np.asarray(pc.utf8_length(words))
        symbols, dups, hashes, counts = [], [], [], []
        for text in b.column("text").cast(pa.large_binary()).to_pylist():
            text = text or b""
            symbols.append(len(text) - len(text.translate(None, SYMBOLS)))
            seen, dup, lines = set(), 0, {}
            for line in text.split(b"\n"):
                k = len(line.split())
                if not k:
                    continue
                dup += line in seen
                seen.add(line)
                h = line_hash(line)
                lines[h] = lines.get(h, 0) + k
            dups.append(dup)
            hashes.append(list(lines))
            counts.append(list(lines.values()))
        yield pa.RecordBatch.from_arrays([
            b.column("doc_id").cast(pa.int64()), b.column("host").cast(pa.string()), b.column("doc"),
            pa.array(np.bincount(row, minlength=n)),
            pa.array(np.bincount(row, weights=chars, minlength=n).astype(np.int64)),
            pa.array(symbols, pa.int64()), pa.array(dups, pa.int64()),
            pa.array(_repeated(codes, row, n)),
            pa.array(hashes, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64())),
        ], names=["doc_id", "host", "doc", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                  "n_repeat_words", "line_hash", "line_words"])


def _host(source: str = "source"):
    return F.coalesce(F.col(source).cast("string"), F.lit(""))


def facts(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts and its distinct line hashes."""
    keyed = docs.select("doc_id", "text", _host().alias("host"), F.xxhash64("doc_id", "text").alias("doc"))
    return staged(keyed.mapInArrow(_facts, _FACTS), "quality-facts")


def removed_lines(known: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, doc, line, words): the lines that each document loses."""
    once = known.groupBy("host", "doc").agg(
        F.min("doc_id").alias("id"), F.first("line_hash").alias("line_hash"), F.first("line_words").alias("line_words"))
    lines = once.select("host", "doc", "id", F.explode(F.arrays_zip("line_hash", "line_words")).alias("l")) \
        .select("host", "doc", "id", F.col("l.line_hash").alias("line"), F.col("l.line_words").alias("words"))
    common = lines.groupBy("host", "line").agg(F.count("*").alias("n_docs"), F.min("id").alias("first")) \
        .filter(F.col("n_docs") > max_docs).select("host", "line", "first")
    return lines.join(common, ["host", "line"]).filter(~F.col("id").eqNullSafe(F.col("first"))).select("host", "doc", "line", "words")


def decide(docs: DataFrame, max_docs: int = MAX_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per document: base counts, base_failed, kept and what the line
    limit removed (n_removed_lines, n_removed_words, removed: line hashes)."""
    known = facts(docs)
    gone = removed_lines(known, max_docs).groupBy("host", "doc").agg(
        F.count("*").alias("n_removed_lines"), F.sum("words").alias("n_removed_words"),
        F.collect_list("line").alias("removed"))
    out = known.drop("line_hash", "line_words").join(gone, ["host", "doc"], "left") \
        .fillna(0, ["n_removed_lines", "n_removed_words"])
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    left = F.col("n_words") - F.col("n_removed_words") >= F.col("n_words") * min_share
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & left)


@F.pandas_udf(T.StringType())
def _without(text, removed):
    import pandas as pd

    def one(t, drop):
        if t is None or drop is None:  # nothing to remove
            return t
        drop = set(drop)
        return b"\n".join(x for x in t.encode().split(b"\n") if not (x.split() and line_hash(x) in drop)).decode()

    return pd.Series([one(t, d) for t, d in zip(text, removed)], dtype=object)


def clean(docs: DataFrame, max_docs: int = MAX_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """The documents that are kept, with all their columns, their text
    without the removed lines."""
    verdict = decide(docs, max_docs, min_share).filter("kept").groupBy("host", "doc").agg(F.first("removed").alias("removed"))
    rows = docs.select(whole(docs.columns), F.col("text").alias("t"), _host().alias("host"), F.xxhash64("doc_id", "text").alias("doc"))
    got = rows.join(verdict, ["host", "doc"]).select("whole", _without("t", "removed").alias("t"))
    return got.select(*parted(docs.columns, instead={"text": F.col("t")}))
