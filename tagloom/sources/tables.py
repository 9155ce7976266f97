"""Input tables and the projections that stand in for the reference's inputs.

Each projection is a plain select/join over the given tables, so Catalyst
prunes columns and pushes filters to the parquet scan.
"""

from __future__ import annotations

from pyspark.errors import PySparkAttributeError, PySparkNotImplementedError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Spread an input that arrives in fewer splits than the cluster has
    cores (e.g. one file with one row group) round-robin over the default
    parallelism. Large inputs already have many splits and are left alone,
    so no shuffle is added at scale. Column pruning and filters still reach
    the scan (they are pushed below the repartition)."""
    try:
        par = df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < par:
            return df.repartition(par)
    except (PySparkAttributeError, PySparkNotImplementedError):  # sessions without the RDD API: leave the scan as is
        pass
    return df


def load_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 on the driver tables: dataset catalogue rows (schema D1).

    dataset_id=doc_id, description=text (null -> ''), name=source-doc_id,
    tag=[lang, source], features = all space-separated words as
    (idx, name) structs in order.
    """
    d = table(spark, sf_dir, "documents")
    words = F.split(F.coalesce(F.col("text"), F.lit("")), " ")
    return d.select(
        F.col("doc_id").alias("dataset_id"),
        F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string")).alias("name"),
        F.coalesce(F.col("text"), F.lit("")).alias("description"),
        F.array(F.col("lang"), F.col("source")).alias("tag"),
        F.transform(words, lambda w, i: F.struct(i.alias("idx"), w.alias("name"))).alias("features"),
        F.col("source"),
        F.col("lang"),
    )


def tag_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 rows (dataset_id, tag): for toxic documents, their source tag."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    lab = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id")
    return d.join(lab, "doc_id", "left_semi").select(
        F.col("doc_id").alias("dataset_id"), F.col("source").alias("tag"))


def rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewritten text: documents that have a label row carry a rewrite."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id")
    return d.join(lab, "doc_id", "left_semi").select(
        F.col("doc_id").alias("dataset_id"),
        F.concat(F.lit("Rewritten: "), F.col("text")).alias("prompt_description"))


def topic_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 (doc_id, topic): embeddings.label for vec_id=doc_id, else -1."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return d.join(e, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("label"), F.lit(-1)).cast("int").alias("topic"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, topic): documents with their topic in one left join
    (the label table is small and is broadcast by AQE when it fits)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return d.join(e, "doc_id", "left").select(
        "doc_id", "text", F.coalesce(F.col("label"), F.lit(-1)).cast("int").alias("topic"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 (doc_id, embedding array<float>, label)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding", "label")


def experiment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D13 flattened: one row per run with Model, nr_topics, Dataset, scores."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderpriority").alias("Model"),
        F.month("o_orderdate").cast("int").alias("nr_topics"),
        F.col("o_orderstatus").alias("Dataset"),
        (F.col("o_totalprice") / F.lit(1e6)).alias("npmi"),
        ((F.col("o_orderkey") % 100) / F.lit(100.0)).alias("diversity"),
        F.col("o_orderdate").alias("ts"),
    )


def timed_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D15 + topic: (doc_id, topic, ts, value) from events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("topic"),
                    "ts", "value", "user_id")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D16 (rater, item, model, rating): rater=user_id%7, item=event_id%50,
    model=event_type, rating=1+floor(value)%5."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 7).alias("rater"),
        (F.col("event_id") % 50).alias("item"),
        F.col("event_type").alias("model"),
        (F.lit(1) + F.floor(F.col("value")) % 5).cast("int").alias("rating"),
        F.col("event_id"),
    )


def event_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as they arrive: users send their events of some days together,
    up to nine days late; ``arrival`` numbers periods of eight days."""
    from ..functions.time import instant
    e = table(spark, sf_dir, "events")
    e = e.withColumn("ts", instant(e, "ts"))
    day = F.floor(F.unix_seconds("ts") / 86400)
    return e.withColumn("arrival", F.floor((day + F.col("user_id") % 10) / 8))
