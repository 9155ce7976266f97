"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reuse(df: DataFrame) -> DataFrame:
    """Keep a table that several branches of one plan read (memory, then
    local disk), so the expensive part (tokenising, exploding) runs once.
    Lost blocks are recomputed from lineage; nothing goes to the driver."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
          rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows per group by ``order`` and number them 1..k.

    ``row_number() <= k`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so each map task forwards at most k rows per group: a hot
    group costs k rows per task, not its whole size.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w))
              .filter(F.col(rank_col) <= k)
              .withColumn(rank_col, F.col(rank_col).cast("bigint")))


def round_half_up(x: Column, digits: int) -> Column:
    """Round half-up in exact decimal after snapping to 9 digits (see r6)."""
    return F.round(F.round(x, 9).cast("decimal(38,9)"), digits).cast("double")


def r6(c) -> Column:
    """Round a double to 6 digits (the comparison precision).

    The value is first snapped to 9 digits and then rounded half-up in exact
    decimal arithmetic, so values that differ only by floating-point
    summation order (1e-16) round the same way even on a decimal tie."""
    x = F.col(c) if isinstance(c, str) else c
    return F.round(F.round(x, 9).cast("decimal(38,9)"), 6).cast("double")


def pick(df: DataFrame, *names: str) -> Column:
    """First existing column among ``names`` (create-or-update fallback)."""
    for n in names:
        if n and n in df.columns:
            return F.col(n)
    raise KeyError(f"none of {names} in {df.columns}")
