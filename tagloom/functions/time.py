"""Wall-clock (TIMESTAMP_NTZ) <-> instant conversions that do not depend on
the session time zone: wall times are read as UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _tz(spark: SparkSession) -> str:
    return spark.conf.get("spark.sql.session.timeZone")


def instant(df: DataFrame, ts: str) -> Column:
    """The column as an instant (TIMESTAMP); a wall time is taken as UTC."""
    c = F.col(ts)
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.from_utc_timestamp(c.cast("timestamp"), _tz(df.sparkSession))
    return c


def wall_utc(spark: SparkSession, c: Column) -> Column:
    """An instant as its UTC wall time (TIMESTAMP_NTZ)."""
    return F.to_utc_timestamp(c, _tz(spark)).cast("timestamp_ntz")
