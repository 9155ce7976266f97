"""Time bins and topics over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import top_k
from ..functions.text import ENGLISH_STOP_WORDS, drop_words, tokens
from ..functions.time import instant, wall_utc


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch (wall times read as UTC)."""
    return F.unix_micros(instant(df, ts))


def bin_edges(df: DataFrame, ts: str):
    """(min, max) of a timestamp column in microseconds (two scalars)."""
    r = df.agg(F.min(micros(df, ts)).alias("mn"), F.max(micros(df, ts)).alias("mx")).first()
    return float(r["mn"] or 0.0), float(r["mx"] or 0.0)  # no event: one empty bin


def equal_bins(df: DataFrame, ts: str, n: int = 10, out: str = "bin") -> DataFrame:
    """N equal-width bins over [min, max], right-closed (the first edge
    is lowered by 0.1 % of the range). Adds ``bin`` (1..n) and ``bin_start``
    (the left edge as a timestamp)."""
    mn, mx = bin_edges(df, ts)
    return df.withColumn(out, bin_of(micros(df, ts), mn, mx, n)).withColumn(
        "bin_start", bin_start(df.sparkSession, F.col(out), mn, mx, n))


def bin_of(x: Column, mn: float, mx: float, n: int) -> Column:
    w = (mx - mn) / n
    if w <= 0:
        return F.lit(1)
    return F.least(F.lit(n), F.greatest(F.lit(1), F.ceil((x.cast("double") - F.lit(mn)) / F.lit(w)))).cast("int")


def bin_start(spark, k: Column, mn: float, mx: float, n: int) -> Column:
    w = (mx - mn) / n
    left = F.when(k == 1, F.lit(mn - 0.001 * (mx - mn))).otherwise(F.lit(mn) + (k - 1).cast("double") * F.lit(w))
    # UTC wall-clock timestamp (no zone), like the input event times
    return wall_utc(spark, F.timestamp_micros(F.floor(left).cast("bigint")))


def slice_sizes(df: DataFrame, ts: str, n: int = 10) -> DataFrame:
    """Documents per bin, empty bins included (bins come from a
    sequence, not from the data)."""
    mn, mx = bin_edges(df, ts)
    counts = df.select(bin_of(micros(df, ts), mn, mx, n).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("size"))
    allb = df.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("bin"))
    return (allb.join(counts, "bin", "left")
                .select("bin", bin_start(df.sparkSession, F.col("bin"), mn, mx, n).alias("bin_start"),
                        F.coalesce(F.col("size"), F.lit(0)).alias("size")))


def bin_counts(docs: DataFrame, stop_words=ENGLISH_STOP_WORDS, cls: str = "topic", binc: str = "bin",
               text: str = "text") -> DataFrame:
    """(bin, topic, term, n) of documents with bin and topic: occurrences of
    each term, and under the empty term the documents with a term. One pass
    and one shuffle: rows are summed by bin and topic in each task first."""
    toks = docs.select(binc, cls, drop_words(tokens(text), stop_words).alias("__t")).filter(F.size("__t") > 0)
    return (toks.select(binc, cls, F.explode(F.concat("__t", F.array(F.lit("")))).alias("term"))
                .groupBy(binc, cls, "term").agg(F.count(F.lit(1)).alias("n")))


def topics_over_time(counts: DataFrame, idf: DataFrame, top: int = 5, cls: str = "topic",
                     binc: str = "bin") -> DataFrame:
    """Per (bin, topic): frequency and top words.

    ``counts`` = (bin, topic, doc_id, term, n) occurrences, or the table of
    ``bin_counts``; ``idf`` = (term, idf) of the fitted topic model (bins are
    scored with the global idf). The outlier topic is dropped.
    """
    c = counts.filter(F.col(cls) != -1)
    tc = c.groupBy(binc, cls, "term").agg(F.sum("n").alias("n"))
    if "doc_id" in c.columns:
        docs = c.select(binc, cls, "doc_id").distinct().groupBy(binc, cls).agg(F.count(F.lit(1)).alias("n"))
        tc = tc.unionByName(docs.withColumn("term", F.lit("")))
    per = tc.groupBy(binc, cls).agg(F.sum(F.when(F.col("term") != "", F.col("n"))).alias("__tot"),
                                    F.sum(F.when(F.col("term") == "", F.col("n"))).alias("frequency"))
    w = tc.join(per, [binc, cls]).join(idf, "term").select(
        binc, cls, "term", (F.col("n") / F.col("__tot") * F.col("idf")).alias("weight"))
    words = top_k(w, [binc, cls], [F.col("weight").desc(), F.col("term").asc()], top)
    wl = (words.groupBy(binc, cls).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("__w"))
               .select(binc, cls, F.array_join(F.transform("__w", lambda s: s["term"]), ", ").alias("words")))
    return per.select(binc, cls, "frequency").join(wl, [binc, cls], "left")
