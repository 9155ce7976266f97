"""Exact ranks and medians that stay distributed under skew.

Values are first reduced to (group, value, count) with map-side partial
aggregation, so a hot group with few distinct values is a few rows. Global
positions come from buckets by range of (group, value): running counts within
each bucket plus the totals of the group's earlier buckets. No step holds a
whole group in one task, and the number of buckets grows with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def value_counts(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("cnt"))


ROWS = 1 << 20  # rows of a bucket, about


def dealt(df: DataFrame, keys: Sequence[str], bucket: str, rows: int = ROWS) -> DataFrame:
    """``df`` with its bucket by range of ``keys``: rows of equal keys share a
    bucket, and buckets follow the order of the keys. There are as many as the
    row count needs. The table is written, so that a task that runs again
    reads the same buckets."""
    df = cut_lineage(df)
    n = -(-df.count() // rows)
    if n <= 1:
        return df.withColumn(bucket, F.lit(0))
    return cut_lineage(df.repartitionByRange(n, *keys).withColumn(bucket, F.spark_partition_id()))


def cumulative_counts(vc: DataFrame, group: Sequence[str], value: str, rows: int = ROWS) -> DataFrame:
    """Add ``before`` = number of rows of the same group with a smaller value.

    ``vc`` = (group..., value, cnt). Rows are dealt to buckets by range of
    (group, value), so one group spans as many buckets as it needs; running
    counts are taken within (group, bucket) and offset by the totals of the
    group's earlier buckets (a table of one row per group and bucket).
    """
    r = dealt(vc, [*group, value], "__b", rows)
    w_local = Window.partitionBy(*group, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    tot = r.groupBy(*group, "__b").agg(F.sum("cnt").alias("__tot"))
    w_off = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("__off", F.coalesce(F.sum("__tot").over(w_off), F.lit(0))).drop("__tot")
    r = r.withColumn("__local", F.coalesce(F.sum("cnt").over(w_local), F.lit(0)))
    return (r.join(off, [*group, "__b"])
             .withColumn("before", F.col("__off") + F.col("__local"))
             .drop("__b", "__local", "__off"))


def midranks(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group..., value, cnt, midrank): average 1-based rank of each distinct
    value within its group (ties share the mean of their ranks)."""
    vc = cumulative_counts(value_counts(df, group, value), group, value)
    return vc.withColumn("midrank", F.col("before") + (F.col("cnt") + F.lit(1)) / F.lit(2.0))


def medians(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group..., median): exact median (mean of the two middle values for
    even counts)."""
    vc = cumulative_counts(value_counts(df, group, value), group, value)
    n = vc.groupBy(*group).agg(F.sum("cnt").alias("__n"))
    j = vc.join(n, list(group))
    # 0-based positions of the middle elements
    lo = F.floor((F.col("__n") - 1) / 2)
    hi = F.floor(F.col("__n") / 2)
    covers = lambda pos: (F.col("before") <= pos) & (pos < F.col("before") + F.col("cnt"))
    picked = j.select(*group, F.when(covers(lo), F.col(value)).alias("__lo"),
                      F.when(covers(hi), F.col(value)).alias("__hi"))
    return picked.groupBy(*group).agg(((F.max("__lo") + F.max("__hi")) / 2.0).alias("median"))
