"""Session helpers: building a session for tests/bench and cutting lineage."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "tagloom", extra: dict | None = None) -> SparkSession:
    """Session for local runs (tests, bench). On a cluster, use the cluster's
    own session; the library never depends on these settings."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``; we read it from there. Only
    a session in local mode, where driver and executors are one process, may
    leave it unset and gets a scratch folder; elsewhere that is an error, as
    executors would not see each other's files.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="tagloom-ckpt-", dir=os.environ.get("TAGLOOM_SCRATCH", "/tmp"))
    sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back. It
    survives the loss of executors, is computed once, and its size is known
    (a checkpointed plan would keep an estimate that grows in every round)."""
    path = scratch_table(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of a loop: ``keep`` writes one, ``drop`` deletes all of them
    once the result is stored elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        self.paths.append(scratch_table(self.spark, "round"))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self) -> None:
        dropped(self.spark, paths=self.paths)
        self.paths = []


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


def dropped(spark: SparkSession, tables: list[str] = (), paths: list[str] = ()) -> None:
    """Drop catalogue tables and delete folders of ``scratch_table`` that
    nothing reads any more."""
    for name in tables:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    _collected(spark)
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _collected(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are gone: it does when
    the driver collects its garbage, which a loop over large tables and few
    objects may not bring about before the disk is full."""
    gc.collect()
    spark._jvm.System.gc()
