"""Helpers shared by the training-data operators.

Conventions
-----------
* A row of ``documents`` is a document. Operators read only the columns they
  name, so extra columns (also ones with clashing names) never matter.
* Intermediate tables that several branches read are written to the shared
  folder of ``spark.checkpoint.dir`` (``staged``), so a lost executor costs a
  re-read and not a recomputation, and no branch runs the Python pass twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import scratch_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str, compression: str = "snappy", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = scratch_table(df.sparkSession, name)
    df.write.option("compression", compression).options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole(columns: list[str], name: str = "whole") -> Column:
    """All given columns as one struct with names of its own, so that no name
    of theirs can clash with one that an operator uses."""
    return F.struct(F.lit(True).alias("any"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias(name)


def parted(columns: list[str], name: str = "whole", instead: dict[str, Column] | None = None) -> list[Column]:
    """The columns of a ``whole`` struct again; ``instead`` has new values."""
    new = instead or {}
    return [new.get(c, F.col(name).getField(f"c{i}")).alias(c) for i, c in enumerate(columns)]


def fold(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % n


def slices(batches: Iterator[pa.RecordBatch], column: str,
           max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches (without copying) into runs of rows whose ``column``
    holds about ``max_bytes``; a longer single row is a slice of its own."""
    for b in batches:
        if b.num_rows == 0:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0)).astype(np.int64)
        part = (np.cumsum(size) - size) // max_bytes
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, b.num_rows]):
            yield b.slice(int(lo), int(hi - lo))


class Recent:
    """A bounded cache: when ``size`` entries are new, those older than them
    go, so frequent keys stay (2 * ``size`` entries at most)."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value


def words_of(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text and the row each stands in.

    A null text has no words. ``lower`` maps A-Z to a-z only.
    """
    # a compact copy: Arrow's string kernels must not see a slice's outer bytes
    raw = [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]
    texts = pa.array([t.lower() for t in raw] if lower else raw, pa.large_binary()).cast(pa.large_string())
    lists = pc.ascii_split_whitespace(texts)
    counts = np.diff(np.asarray(lists.offsets))
    flat = lists.flatten()
    row = np.repeat(np.arange(len(texts)), counts)
    full = pc.greater(pc.binary_length(flat), 0)  # a split leaves an empty string at either end
    keep = np.asarray(full)
    return (flat if keep.all() else flat.filter(full)), row[keep]


def _stats(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node id reachable over ``edges`` (a, b).

    Alternating large-star and small-star rounds (Kiveris et al., 2014),
    repeated until the edge set no longer changes; O(log^2 n) rounds. A hub's
    neighbours are reduced to their minimum by a partial aggregate, and the
    join back on the hub is one that AQE can split. Each round's edges are
    written to the shared folder, which cuts the lineage. Nodes without edges
    are not returned.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:  # only the smaller neighbours
            near = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = near.join(low, "a")
        if large:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                low.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    cur = staged(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
                 .filter("a <> b").distinct(), name)
    before = _stats(cur)
    while True:
        cur = staged(star(star(cur, True), False), name)
        after = _stats(cur)
        if after == before:
            break
        before = after
    # at the fixed point every edge is (node, root)
    pairs = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = pairs.select(F.col("component").alias("node"), "component").distinct()
    return pairs.unionByName(roots)
