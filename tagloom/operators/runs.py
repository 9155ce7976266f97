"""Experiment runs: means, leaderboard, bands, summaries, grids, best runs
(A21-A26, A32, A33, W2, W3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import round_half_up
from ..functions.ranks import medians


def mean_by_model(runs: DataFrame, metrics: Sequence[str] = ("npmi", "diversity"), model: str = "Model") -> DataFrame:
    """Mean of each numeric score per model."""
    return runs.groupBy(model).agg(*[F.avg(m).alias(m) for m in metrics])


def leaderboard(runs: DataFrame, datasets: Sequence[str], metrics: Sequence[str] = ("npmi", "diversity"),
                model: str = "Model", dataset: str = "Dataset", digits: int | None = 3) -> DataFrame:
    """One row per model, columns '<dataset>_<metric>' = mean score, and
    ``position`` = order of the models by the first dataset's first metric
    (ascending, ties by model). ``datasets`` fixes the pivot values so Spark
    runs no extra job to find them."""
    aggs = [F.avg(m).alias(m) for m in metrics]
    wide = runs.groupBy(model).pivot(dataset, list(datasets)).agg(*aggs)
    key = f"{datasets[0]}_{metrics[0]}"
    # one row per model: the ordering window is bounded by the model count
    wide = wide.withColumn("position", F.row_number().over(Window.orderBy(F.col(key).asc_nulls_last(), F.col(model))))
    if digits is not None:
        for c in wide.columns:
            if c not in (model, "position"):
                wide = wide.withColumn(c, round_half_up(F.col(c), digits))
    return wide


def topic_quality(runs: DataFrame, model: str = "Model", dataset: str = "Dataset") -> DataFrame:
    """Mean npmi x mean diversity per (model, dataset)."""
    m = runs.groupBy(model, dataset).agg(F.avg("npmi").alias("npmi"), F.avg("diversity").alias("diversity"))
    return m.select(model, dataset, (F.col("npmi") * F.col("diversity")).alias("quality"))


def flatten_runs(runs: DataFrame, combine: bool = False, params: str = "Params", model: str = "Model",
                 file_index: str = "file_index") -> DataFrame:
    """nr_topics = first non-zero of Params nr_topics, num_topics,
    n_components; model suffixed by '_<file_index>' unless ``combine``."""
    def p(k):
        v = F.expr(f"try_cast({params}['{k}'] AS BIGINT)")
        return F.when(v != 0, v)
    out = runs.withColumn("nr_topics", F.coalesce(p("nr_topics"), p("num_topics"), p("n_components")))
    if not combine:
        out = out.withColumn(model, F.concat(F.col(model), F.lit("_"), F.col(file_index).cast("string")))
    return out


def flatten_slices(dtm: DataFrame, scores: str = "Scores") -> DataFrame:
    """One row per time slice from Scores = map(slice -> struct(npmi,
    diversity))."""
    keep = [c for c in dtm.columns if c != scores]
    return dtm.select(*keep, F.explode(scores).alias("slice", "__s")).select(
        *keep, "slice", F.col("__s.npmi").alias("npmi"), F.col("__s.diversity").alias("diversity"))


def band(runs: DataFrame, y: str = "npmi", width: float = 0.5, model: str = "Model",
         x: str = "nr_topics") -> DataFrame:
    """Mean +- width x sample standard deviation per (model, x)."""
    g = runs.groupBy(model, x).agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"))
    return g.select(model, x, "mean", "std", (F.col("mean") - width * F.col("std")).alias("lower"),
                    (F.col("mean") + width * F.col("std")).alias("upper"))


def run_summary(runs: DataFrame, y: str = "npmi", group: Sequence[str] = ("Model", "nr_topics")) -> DataFrame:
    """Mean, exact median and sample standard deviation per group."""
    g = runs.groupBy(*group).agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"),
                                 F.count(F.lit(1)).alias("runs"))
    return g.join(medians(runs, list(group), y), list(group))


def grid(params: DataFrame) -> DataFrame:
    """Cartesian product of list-valued parameters.

    ``params`` holds one row whose columns are arrays; each array is
    exploded in turn, so the product is built by generators inside one row
    stream (no join)."""
    out = params
    for c in params.columns:
        out = out.withColumn(c, F.explode(c))
    return out


def best_run(runs: DataFrame, metric: str = "npmi", rank: int = 1,
             group: Sequence[str] = ("Model", "nr_topics")) -> DataFrame:
    """The group with the ``rank``-th best mean score (ties by group)."""
    g = runs.groupBy(*group).agg(F.avg(metric).alias("mean"))
    # one row per group: the global ordering is bounded by the group count
    w = Window.orderBy(F.col("mean").desc(), *[F.col(c) for c in group])
    return g.withColumn("place", F.row_number().over(w)).filter(F.col("place") == rank)


def top3_marks(board: DataFrame, columns: Sequence[str], model: str = "Model") -> DataFrame:
    """For each column, the models holding its first, second and third
    distinct maximum -> (column, model, value, mark 1..3)."""
    longs = None
    for c in columns:
        part = board.select(F.lit(c).alias("column"), F.col(model), F.col(c).cast("double").alias("value"))
        longs = part if longs is None else longs.unionByName(part)
    w = Window.partitionBy("column").orderBy(F.col("value").desc())
    return longs.filter(F.col("value").isNotNull()).withColumn("mark", F.dense_rank().over(w)).filter(F.col("mark") <= 3)
