"""Operator 4, line dedup: levelled sorted runs of line hashes.

The distinct line keys of the documents come in batches. ``LineRuns`` keeps,
like a log-structured merge tree, runs of (key hash, documents) bucketed and
sorted by hash. A new batch is counted, merge-anti-joined with the full run
(keys already known to be common need no further count) and added as a run of
its own; when a level holds ``fanout`` runs they are merged into one run of
the next level, and keys that reached ``min_docs`` move to the full run.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with
A-Z lower-cased, hashed to 64 bits. Keys with at least one code point found
in at least ``min_docs`` documents lose all their lines in every document;
empty keys are never dropped.

Defined results: a null or empty text is one empty line; repeated rows count
as documents of their own and get equal results; an empty table gives an
empty result; further columns, whatever their names, are kept by ``clean`` and
ignored by ``apply``.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import parted, slices, staged, whole
from tagloom.session import scratch_table

MIN_DOCS = 10
BATCHES = 4
FANOUT = 2


def key_hash(line: bytes) -> int | None:
    """Signed 64-bit hash of a line's key; None for an empty key."""
    key = line.strip(b" \t\n\x0b\x0c\r").lower()
    if not key:
        return None
    h = xxhash.xxh64_intdigest(key)
    return h - (1 << 64) if h >> 63 else h


def _keys(batches):
    for b in slices(batches, "text"):
        out = [list({h for x in (t or b"").split(b"\n") if (h := key_hash(x)) is not None})
               for t in b.column("text").cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("row"), b.column("batch"), pa.array(out, pa.list_(pa.int64()))], names=["row", "batch", "keys"])


def line_keys(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(row, batch, h): the distinct line keys of each document. ``row`` is a
    hash of id and text, which repeated rows share."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text") \
        .withColumn("batch", F.pmod(F.col("row"), F.lit(batches)).cast("int"))
    return rows.mapInArrow(_keys, "row long, batch int, keys array<long>") \
        .select("row", F.explode("keys").alias("h"), "batch")


class LineRuns:
    """Runs of (h, n) by level, and the full run of common keys."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.full: str | None = None

    def _write(self, run: DataFrame) -> str:
        """A run: one sorted file per bucket of hashes."""
        name = f"line_run_{uuid.uuid4().hex}"
        run.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").format("parquet") \
            .option("path", scratch_table(self.spark, name)).saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for n in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")

    def add(self, batch: DataFrame) -> None:
        """Count a batch of (row, h) and add it as a run."""
        new = batch.groupBy("h").agg(F.count("*").alias("n"))
        if self.full:
            new = new.join(self.spark.table(self.full), "h", "left_anti")
        self._push(0, self._write(new))

    def _push(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._compact(runs))

    def _merged(self, runs: list[str]) -> DataFrame:
        """Key-wise sums by full outer merge joins of equally bucketed runs."""
        out = self.spark.table(runs[0])
        for name in runs[1:]:
            other = self.spark.table(name).withColumnRenamed("n", "m")
            out = out.join(other, "h", "full").select(
                "h", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def _compact(self, runs: list[str]) -> str:
        merged = staged(self._merged(runs), "line-merge")
        full = merged.filter(F.col("n") >= self.min_docs).select("h")
        if self.full:
            full = full.unionByName(self.spark.table(self.full).select("h")).distinct()
        old, self.full = self.full, self._write(full)
        rest = self._write(merged.filter(F.col("n") < self.min_docs))
        self._drop([*runs, *([old] if old else [])])
        return rest

    def common(self) -> DataFrame:
        """(h): all keys with at least ``min_docs`` documents so far."""
        runs = [n for level in self.levels for n in level]
        self.levels = [[self._compact(runs)]] if runs else []
        return self.spark.table(self.full) if self.full else self.spark.createDataFrame([], "h long")


def common_keys(keys: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    runs = LineRuns(keys.sparkSession, min_docs)
    for i in range(batches):
        runs.add(keys.filter(F.col("batch") == i))
    return runs.common()


def _cut(batches):
    for b in slices(batches, "text"):
        n_lines, n_dropped, kept = [], [], []
        for text, drop in zip(b.column("text").cast(pa.large_binary()).to_pylist(), b.column("drop").to_pylist()):
            lines = (text or b"").split(b"\n")
            left = lines
            if drop:
                gone = set(drop)
                left = [x for x in lines if key_hash(x) not in gone]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(left))
            kept.append(b"\n".join(left) if len(left) < len(lines) else text or b"")
        yield pa.RecordBatch.from_arrays(
            [b.column("all"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string())], names=["all", "n_lines", "n_dropped", "kept_text"])


def _applied(docs: DataFrame, columns: list[str], min_docs: int, batches: int) -> DataFrame:
    spark = docs.sparkSession
    path = scratch_table(spark, "line-keys")
    line_keys(docs, batches).write.partitionBy("batch").parquet(path)
    keys = spark.read.schema("row long, h long, batch int").parquet(path)
    drops = keys.join(common_keys(keys, min_docs, batches), "h").groupBy("row").agg(F.collect_set("h").alias("drop"))
    rows = docs.select(whole(columns, "all"), "text", F.xxhash64("doc_id", "text").alias("row"))
    got = rows.join(drops, "row", "left").select("all", "text", "drop")
    kind = got.schema["all"].dataType.simpleString()
    return got.mapInArrow(_cut, f"all {kind}, n_lines long, n_dropped long, kept_text string")


def apply(docs: DataFrame, columns: list[str], min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """One row per document: ``columns`` of it, n_lines, n_dropped, kept_text."""
    return _applied(docs, columns, min_docs, batches).select(*parted(columns, "all"), "n_lines", "n_dropped", "kept_text")


def clean(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with all their columns, their text without common lines.
    A document keeps its row even if no line is left."""
    other = [c for c in docs.columns if c != "text"]
    got = _applied(docs, other, min_docs, BATCHES)
    at = {c: x for c, x in zip(other, parted(other, "all"))} | {"text": F.col("kept_text").alias("text")}
    return got.select(*[at[c] for c in docs.columns])
