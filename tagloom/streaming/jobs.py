"""Structured Streaming jobs.

Each builder takes a streaming DataFrame and returns a started query or a
streaming DataFrame; sinks are files/tables under a caller-given folder so
results survive restarts (checkpoints hold the offsets and state).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.topics import nearest
from ..session import dropped


def file_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, max_files: int = 1) -> DataFrame:
    """A parquet file stream over ``<folder>/<name>*.parquet``: files, or
    folders of files as Spark writes a table."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
                 .parquet(f"{folder.rstrip('/')}/{name}*.parquet"))


def stream_counts(stream: DataFrame, ts: str = "ts", key: str = "topic", window: str = "1 day",
                  delay: str = "1 hour") -> DataFrame:
    """Counts per tumbling window and key with a watermark; append mode
    emits each window once the watermark passes its end, and its state is
    dropped then."""
    return (stream.withWatermark(ts, delay)
                  .groupBy(F.window(ts, window).alias("w"), F.col(key))
                  .agg(F.count(F.lit(1)).alias("n"))
                  .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n"))


def land(rows: DataFrame, folder: str) -> None:
    """Add the files of one arrival to the folder that a stream reads."""
    rows.write.mode("append").parquet(folder)


def close_windows(spark: SparkSession, folder: str, schema: T.StructType, out: str, checkpoint: str,
                  ts: str = "ts", key: str = "topic", window: str = "1 day", delay: str = "1 hour") -> tuple[int, int]:
    """T1 over what has landed in ``folder`` since the last run: windows that
    the watermark has passed are appended to ``out`` and leave the state, rows
    of such windows are dropped as late. Offsets and state are in
    ``checkpoint``, so a run goes on where the last one ended. Returns the rows
    of state left and the rows dropped (Spark counts these after its partial
    aggregation; ``late_counts`` gives events)."""
    stream = spark.readStream.schema(schema).parquet(folder)
    q = (stream_counts(stream, ts, key, window, delay).writeStream.outputMode("append").format("parquet")
         .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    states = [s for p in q.recentProgress for s in p.stateOperators]
    return (states[-1].numRowsTotal if states else 0), sum(s.numRowsDroppedByWatermark for s in states)


def closing_row(arrived: DataFrame, ts: str = "ts", window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """One row, null but for a time so late that the watermark passes the end
    of every window of ``arrived``. Its own window stays open. No row if no
    row has a time."""
    at = arrived.agg((F.max(ts) + F.expr(f"interval {window}") + F.expr(f"interval {delay}")).alias(ts)).dropna()
    return at.select(*[F.col(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in arrived.schema])


def late_counts(arrived: DataFrame, closed: DataFrame, ts: str = "ts", key: str = "topic",
                window: str = "1 day") -> DataFrame:
    """(window_start, window_end, key, n, late): the counts of closed windows
    beside the events that arrived for them too late to be counted, by
    comparing what landed with what the stream emitted. A window that got only
    late events has n = 0; events without a time belong to no window."""
    landed = (arrived.filter(F.col(ts).isNotNull())
                     .groupBy(F.window(ts, window).alias("w"), F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("all"))
                     .select("w.start", "w.end", "k", "all"))
    c = closed.select(F.col("window_start").alias("s"), F.col(key).alias("c"), "n")
    j = landed.join(c, (F.col("start") == F.col("s")) & F.col("k").eqNullSafe(F.col("c")), "left")
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return j.select(F.col("start").alias("window_start"), F.col("end").alias("window_end"), F.col("k").alias(key),
                    n.alias("n"), (F.col("all") - n).alias("late"))


def stream_assign(cents: DataFrame, path: str, key: str = "doc_id", vec: str = "embedding", cls: str = "topic"):
    """Nearest frozen topic of each arriving vector (cosine), at any number
    of topics. Batch b is written to ``path``/b=<b>; a retried batch overwrites
    its own folder. Returns the foreachBatch function."""
    def assign(batch: DataFrame, batch_id: int) -> None:
        nearest(batch, cents, cls, key, vec).write.mode("overwrite").parquet(f"{path}/b={batch_id}")
    return assign


def stream_dedupe(stream: DataFrame, text: str = "text", ts: str = "ts", delay: str = "3650 days") -> DataFrame:
    """Drop exact repeats (same text hash) that arrive within ``delay``
    of the first one; the state for a hash expires with the watermark."""
    return (stream.withColumn("text_hash", F.sha2(F.col(text), 256))
                  .withWatermark(ts, delay)
                  .dropDuplicatesWithinWatermark(["text_hash"]))


def _versions(spark: SparkSession, path: str, prefix: str = "v") -> list[int]:
    """Batch ids of the tables named ``prefix<id>`` under ``path`` (Hadoop FS
    listing, so it works on the shared storage of a cluster)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith(prefix) and name[len(prefix):].isdigit() and fs.exists(
                jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name[len(prefix):]))
    return sorted(out)


def _state(spark: SparkSession, path: str, key: str, upto: int | None = None, before: int | None = None) -> DataFrame:
    """(key, i, s, c): the newest base older than batch ``before`` and the
    batches after it, up to ``upto``."""
    bases = [b for b in _versions(spark, path, "base") if before is None or b < before]
    base = bases[-1] if bases else -1
    parts = [f"{path}/base{base}"] if bases else []
    parts += [f"{path}/v{v}" for v in _versions(spark, path) if v > base and (upto is None or v <= upto)]
    if not parts:
        raise ValueError(f"no batch has been written under {path}")
    return spark.read.parquet(*parts).groupBy(key, "i").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))


def stream_centroids(stream: DataFrame, state_path: str, key: str = "label", vec: str = "embedding", every: int = 16):
    """T4: running-mean centroids. Micro-batch b writes only its own sums and
    counts per (key, dim), as ``v<b>``; every ``every``-th one also adds the
    batches since the last base to it and writes ``base<b>``, so the whole
    state is rewritten once in ``every`` batches. Then all that the base
    before covers is deleted: two bases and the batches after the older one
    stay. A retried batch writes the same tables from the same input, so
    replays never count twice. Returns the foreachBatch function."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        (batch.select(F.col(key), F.posexplode(vec).alias("i", "x"))
              .groupBy(key, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count(F.lit(1)).alias("c"))
              .write.mode("overwrite").parquet(f"{state_path}/v{batch_id}"))
        if (batch_id + 1) % every:
            return
        _state(spark, state_path, key, upto=batch_id, before=batch_id) \
            .write.mode("overwrite").parquet(f"{state_path}/base{batch_id}")
        earlier = [b for b in _versions(spark, state_path, "base") if b < batch_id]
        if earlier:
            dropped(spark, paths=[f"{state_path}/base{b}" for b in earlier[:-1]]
                    + [f"{state_path}/v{v}" for v in _versions(spark, state_path) if v <= earlier[-1]])
    return merge


def read_centroids(spark: SparkSession, state_path: str, key: str = "label") -> DataFrame:
    """Current running-mean centroids -> (key, i, mean)."""
    return _state(spark, state_path, key).select(key, "i", (F.col("s") / F.col("c")).alias("mean"))
