"""Operator 9, LM scoring by prediction by partial matching.

The model is a byte-context trie of ``ORDER`` context bytes, trained on all
training documents (pretrained code lengths): counts of (context, symbol)
with escape method D, symbol exclusion and update exclusion. A symbol seen n
times in the full context has (n - 1/2) / T; otherwise an escape d / 2T over
its d distinct symbols is paid and the next shorter context is asked, without
the symbols of the longer one, down to the uniform choice among the bytes
never seen. A shorter context counts in how many contexts one byte longer a
symbol was seen, not how often. A document begins after ``ORDER`` zero bytes
and ends with a zero byte, whose prediction is part of its probability.

How it is spread: documents are dealt into blocks of bounded size (a bucketed
table in the shared folder). Each block lists its distinct words and its
distinct (context, symbol) strings with their training counts; these are summed
over the corpus, the trie's probabilities are worked out in groups of contexts
that share their last ``SHARED`` bytes (at most 2^24 rows for each, whatever the
corpus; a group has about ``GROUP`` rows), cogrouped with the symbol counts of
the last two bytes, and each block gets back the values of its own list. Neither vocabulary nor trie is ever broadcast; only
the table of single-byte contexts (65,536 counts) is.

The base score is a word unigram with add-one counts over the same documents.

Defined results: a null or empty text has the end token only; a zero byte in a
text shares the end's symbol; a null doc_id folds as empty text; repeated rows
are documents of their own; without training documents every byte costs
log10(256); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import slices, staged, words_of
from tagloom.session import scratch_table

ORDER = 5
SHARED = 3
HALF = 0.5
BLOCK_BYTES = 16 << 20
GROUP = 1 << 19
CONTEXTS = 1024
UNIT = float(1 << 35)
PART_BYTES = 1 << 20
RUN = 1 << 18


def word_keys(words: pa.Array) -> np.ndarray:
    """63-bit hashes of words as negative numbers; (context, symbol) codes
    are never negative."""
    raw = words.cast(pa.large_binary()).to_pylist()
    return np.fromiter((xxhash.xxh3_64_intdigest(w) | 1 << 63 for w in raw), np.uint64, len(raw)).view(np.int64)


def grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(context, symbol) codes of every position of every text, the last byte
    being the symbol, and the text each belongs to, in runs of ``RUN``."""
    pad = bytes(ORDER)
    flat = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), np.uint8)
    ends = np.cumsum([len(t) + 1 + ORDER for t in texts])
    for lo in range(0, len(flat) - ORDER, RUN):
        hi = min(lo + RUN, len(flat) - ORDER)
        code = np.zeros(hi - lo, np.int64)
        for j in range(ORDER + 1):
            code <<= 8
            code |= flat[lo + j:hi + j]
        first, last = np.searchsorted(ends, [lo + ORDER, hi + ORDER - 1], "right")
        cuts = np.concatenate([[0], np.minimum(ends[first:last + 1], hi + ORDER) - lo - ORDER])
        row = np.repeat(np.arange(first, last + 1), np.diff(cuts))
        starts = np.concatenate([[0], ends])[first:last + 1] - lo - ORDER
        padding = (starts[:, None] + np.arange(ORDER)).ravel()
        own = np.ones(hi - lo, bool)
        own[padding[(padding >= 0) & (padding < hi - lo)]] = False
        yield code[own], row[own]


class Sums:
    """Counts by key. New keys wait until they outnumber the summed ones, so a
    block costs a few times the memory of its distinct keys."""

    def __init__(self):
        self.key = self.n = np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        self.waiting.append((key, n))
        if sum(len(k) for k, _ in self.waiting) > max(len(self.key), 1 << 16):
            self.merge()

    def merge(self) -> None:
        key = np.concatenate([self.key, *(k for k, _ in self.waiting)])
        n = np.concatenate([self.n, *(c for _, c in self.waiting)])
        self.waiting = []
        if len(key):
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            self.key, self.n = key[first], np.add.reduceat(n[order], first)


def raw_texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def _needs(block: pa.Table) -> pa.Table:
    """The block's distinct keys with their counts in training documents."""
    word, gram = Sums(), Sums()
    for part in slices(block.to_batches(), "text", PART_BYTES):
        held = np.asarray(part.column("held_out"))
        words, row = words_of(part.column("text"), lower=True)
        coded = words.dictionary_encode()
        word.add(word_keys(coded.dictionary),
                 np.bincount(np.asarray(coded.indices)[~held[row]], minlength=len(coded.dictionary)))
        for code, row in grams(raw_texts(part.column("text"))):
            out = held[row]
            gram.add(*np.unique(code[~out], return_counts=True))
            key = np.unique(code[out])
            gram.add(key, np.zeros(len(key), np.int64))
    word.merge()
    gram.merge()
    size = len(word.key) + len(gram.key)
    which = block.column("block")[0].as_py()
    pa.default_memory_pool().release_unused()
    return pa.table({"block": np.full(size, which, np.int32),
                     "key": np.concatenate([word.key, gram.key]), "n": np.concatenate([word.n, gram.n])})


def _escape(log, found, symbol, count, total, kinds):
    """Add one order's share: hits pay their count less the half that a symbol
    gives to the escape, misses the escape. All per row, without the symbols
    of longer contexts."""
    hit = ~found & (count > 0)
    log[hit] += np.log10((count[hit] - HALF) / total[hit])
    miss = ~found & (count == 0) & (total > 0)
    log[miss] += np.log10(HALF * kinds[miss] / total[miss])
    found |= hit


def trie_logs(key: np.ndarray, n: np.ndarray, two: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each (context, symbol) code.

    ``key`` holds all codes of some contexts of ``SHARED`` bytes, ``n`` their
    training counts (0: asked for only). ``two[i, s]`` counts the contexts one
    byte longer in which symbol s followed the last two bytes of the i-th of
    those contexts (in ascending order), ``pairs[c, s]`` those in which it
    followed byte c.
    """
    symbol, context = key & 0xFF, key >> 8
    log, found = np.zeros(len(key)), np.zeros(len(key), bool)
    code, count = np.unique(key), None  # the (context, symbol) pairs of this order and their counts
    row = np.searchsorted(code, key)
    count = np.bincount(row, weights=n)
    for order in range(ORDER, SHARED - 1, -1):
        contexts, at = np.unique(code >> 8, return_inverse=True)
        total, kinds = np.bincount(at, weights=count), np.bincount(at, weights=count > 0)
        if order == ORDER:
            free, free_kinds = total[at][row], kinds[at][row]
        else:  # what the next longer context has seen is excluded
            longer, above = np.unique(last >> 8, return_inverse=True)
            seen = last_count > 0
            less = np.bincount(above, weights=np.where(seen, count[up], 0))
            fewer = np.bincount(above, weights=seen)
            mine = np.searchsorted(longer, context & ((1 << 8 * (order + 1)) - 1))
            free, free_kinds = total[at][row] - less[mine], kinds[at][row] - fewer[mine]
        _escape(log, found, symbol, count[row], free, free_kinds)
        if order > SHARED:
            last, last_count = code, count
            shorter = ((last >> 8) & ((1 << 8 * (order - 1)) - 1)) << 8 | (last & 0xFF)
            code, up = np.unique(shorter, return_inverse=True)
            count = np.bincount(up, weights=last_count > 0)
            row = np.searchsorted(code, (context & ((1 << 8 * (order - 1)) - 1)) << 8 | symbol)
    # from here on tables of (SHARED-byte context, symbol)
    mine = np.searchsorted(contexts, context & ((1 << 8 * SHARED) - 1))
    seen = np.zeros((len(contexts), 256), bool)
    seen[at, code & 0xFF] = count > 0
    for table in (two, pairs[contexts & 0xFF], (pairs > 0).sum(axis=0)[None]):
        free = (table * ~seen).astype(float)
        _escape(log, found, symbol, free[mine, symbol], free.sum(axis=1)[mine], (free > 0).sum(axis=1)[mine])
        seen |= table > 0
    never = ~found
    log[never] -= np.log10(256 - seen.sum(axis=1)[mine[never]])
    return log


def _logs(pairs: np.ndarray):
    def run(rows: pd.DataFrame, below: pd.DataFrame) -> pd.DataFrame:
        key, n = (rows[c].to_numpy(np.int64) for c in ("key", "n"))
        near = key >> 8 & ((1 << 8 * SHARED) - 1)
        order = np.argsort(near, kind="stable")
        key, n, near = key[order], n[order], near[order]
        of, symbol, count = below.near.to_numpy(np.int64) >> 8, below.k.to_numpy(np.int64) & 0xFF, below.n.to_numpy(np.int64)
        order = np.argsort(of, kind="stable")
        of, symbol, count = of[order], symbol[order], count[order]
        value = np.zeros(len(key))
        contexts = np.unique(near)
        for lo in range(0, len(contexts), CONTEXTS):
            some = contexts[lo:lo + CONTEXTS]
            a, b = np.searchsorted(near, some[0]), np.searchsorted(near, some[-1], "right")
            c, d = np.searchsorted(of, some[0]), np.searchsorted(of, some[-1], "right")
            two = np.zeros((len(some), 256), np.int64)
            two[np.searchsorted(some, of[c:d]), symbol[c:d]] = count[c:d]
            value[a:b] = trie_logs(key[a:b], n[a:b], two, pairs)
        return pd.DataFrame({"key": key, "value": np.rint(value * -UNIT).astype(np.int64)})
    return run


def _scored(known_end: int):
    def run(block: pa.Table, values: pa.Table) -> pa.Table:
        key, value = (np.asarray(values.column(c)) for c in ("key", "value"))
        order = np.argsort(key)
        key, value = key[order], value[order]
        del order
        word = np.searchsorted(key, 0)
        (ids, codes), (counts, logs) = np.split(key, [word]), np.split(value, [word])
        logs = logs / -UNIT
        schema = pa.schema({"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(),
                            "logs": pa.float64(), "score": pa.float64()})
        done = [schema.empty_table()]
        for part in slices(block.to_batches(), "text", PART_BYTES):
            n = part.num_rows
            words, row = words_of(part.column("text"), lower=True)
            coded = words.dictionary_encode()
            asked = word_keys(coded.dictionary)
            c = counts[np.searchsorted(ids, asked)] if len(asked) else np.zeros(0)
            c = c[np.asarray(coded.indices)]
            score = np.zeros(n)
            for code, doc in grams(raw_texts(part.column("text"))):
                code, back = np.unique(code, return_inverse=True)
                score += np.bincount(doc, weights=logs[np.searchsorted(codes, code)][back], minlength=n)
            done.append(pa.table({
                "doc_id": part.column("doc_id"), "held_out": part.column("held_out"),
                "n_tokens": np.bincount(row, minlength=n) + 1,
                "n_known": np.bincount(row[c > 0], minlength=n) + (known_end > 0),
                "logs": np.bincount(row, weights=np.log10(c + 1), minlength=n) + np.log10(known_end + 1),
                "score": score}, schema=schema))
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(done)
    return run


def blocks(docs: DataFrame, held_out, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, doc_id, text, held_out), bucketed by block in the shared folder."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(-(-size // block_bytes), 2 * spark.sparkContext.defaultParallelism)
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"), "doc_id",
                       F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    name = f"lm_blocks_{uuid.uuid4().hex}"
    rows.repartition(n, "block").write.bucketBy(n, "block").format("parquet") \
        .option("compression", "zstd").option("path", scratch_table(spark, name)).saveAsTable(name)
    return spark.table(name)


def score(docs: DataFrame, held_out, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score. ``held_out``: a column expression; those are not learned
    from."""
    dealt = blocks(docs, held_out, block_bytes)
    # a block's keys ascend: the second Parquet format stores their differences
    needs = staged(dealt.groupBy("block").applyInArrow(_needs, "block int, key long, n long"), "lm-needs", "zstd",
                   **{"parquet.writer.version": "PARQUET_2_0"})
    ends = dealt.filter("not held_out").count()
    per_word = needs.filter("key < 0").groupBy("key").agg(F.sum("n").alias("n"))
    total = per_word.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    tokens, kinds = total["n"] + ends, total["v"] + (ends > 0)

    per_gram = staged(needs.filter("key >= 0").groupBy("key").agg(F.sum("n").alias("n")), "lm-grams", "zstd")
    # in how many contexts one byte longer each (two bytes, symbol) was seen; at most 2^24 rows
    low = staged(per_gram.filter("n > 0").select(F.col("key").bitwiseAND((1 << 8 * (SHARED + 1)) - 1).alias("k")).distinct()
                 .groupBy(F.col("k").bitwiseAND(0xFFFFFF).alias("k")).agg(F.count("*").alias("n")), "lm-low")
    pairs = np.zeros((256, 256), np.int64)
    for r in low.groupBy(F.col("k").bitwiseAND(0xFFFF).alias("p")).agg(F.count("*").alias("n")).collect():
        pairs[r["p"] >> 8, r["p"] & 0xFF] = r["n"]  # at most 65,536 rows

    near = F.col("key").bitwiseAND((1 << 8 * (SHARED + 1)) - 256)  # the last SHARED context bytes
    n_groups = max(1, -(-per_gram.count() // GROUP))
    by_near = per_gram.select("key", "n", F.pmod(F.xxhash64(near), F.lit(n_groups)).alias("part"))
    two = F.col("near").bitwiseAND(0xFFFF00)
    below = per_gram.select(near.alias("near")).distinct().withColumn("two", two) \
        .join(low.withColumn("two", F.col("k").bitwiseAND(0xFFFF00)), "two") \
        .select("near", "k", "n", F.pmod(F.xxhash64("near"), F.lit(n_groups)).alias("part"))
    trie = by_near.groupBy("part").cogroup(below.groupBy("part")).applyInPandas(_logs(pairs), "key long, value long")
    # counts of words, and code lengths as multiples of 1 / UNIT: mostly 5 bytes, which the shuffle's compression sees
    model = per_word.select("key", F.col("n").alias("value")).unionByName(trie)
    values = needs.select("block", "key").join(model, "key").select("block", "key", "value")
    got = dealt.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(
        _scored(ends), "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double")
    base = F.col("logs") - F.col("n_tokens") * float(np.log10(tokens + (kinds + 1)))
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
                      base.alias("base_score"), "score")
