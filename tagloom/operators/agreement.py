"""Agreement and classification scores over rating and label tables
(E12-E16, E19, E20).

Rater agreement is computed from (item, category) counts, so the work per
item is bounded by the number of categories, never by raters squared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import cumulative_counts


def one_rating(ratings: DataFrame, rater: str = "rater", item: str = "item", rating: str = "rating",
               order: str = "event_id") -> DataFrame:
    """One rating per (rater, item): the latest by ``order``."""
    return ratings.groupBy(rater, item).agg(F.max_by(F.col(rating), F.col(order)).alias(rating))


def fleiss_kappa(ratings: DataFrame, item: str = "item", rating: str = "rating") -> DataFrame:
    """Fleiss' kappa from item x category counts (items may have
    different numbers of ratings; items with one rating are skipped)."""
    r = ratings.filter(F.col(rating).isNotNull())
    nij = r.groupBy(item, rating).agg(F.count(F.lit(1)).alias("nij"))
    per_item = nij.groupBy(item).agg(F.sum("nij").alias("ni"), F.sum(F.col("nij") ** 2).alias("sq")) \
                  .filter(F.col("ni") >= 2)
    pbar = per_item.agg(F.avg((F.col("sq") - F.col("ni")) / (F.col("ni") * (F.col("ni") - 1))).alias("pbar"),
                        F.sum("ni").alias("total"))
    pj = nij.join(per_item.select(item), item, "left_semi").groupBy(rating).agg(F.sum("nij").alias("nj"))
    tot = pbar.first()
    pe = pj.agg(F.sum((F.col("nj") / F.lit(float(tot["total"]))) ** 2).alias("pe"))
    return pe.select(F.lit(tot["pbar"]).alias("p_bar"), "pe",
                     ((F.lit(tot["pbar"]) - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def krippendorff_alpha(ratings: DataFrame, level: str = "nominal", item: str = "item",
                       rating: str = "rating") -> DataFrame:
    """Krippendorff's alpha (nominal, ordinal or interval; the latter two
    need numbers); missing ratings are allowed, units with fewer than two
    values are not pairable. NaN if the values do not vary.

    No pair of categories is formed. With counts n_uc per unit u of m_u values,
    the observed disagreement of a unit is (m^2 - sum n^2) / (m - 1) on the
    nominal level and 2 (m sum n v^2 - (sum n v)^2) / (m - 1) for squared
    differences of v; the expected one is the same sum over all units together.
    The ordinal distance is a difference of mid-ranks, so v is the rating
    itself (interval) or its mid-rank among all pairable values (ordinal).
    """
    if level not in ("nominal", "ordinal", "interval"):
        raise ValueError("level is nominal, ordinal or interval")
    nuc = ratings.filter(F.col(rating).isNotNull()).groupBy(item, rating).agg(F.count(F.lit(1)).alias("n"))
    mu = nuc.groupBy(item).agg(F.sum("n").alias("m")).filter(F.col("m") >= 2)
    u = nuc.join(mu.select(item), item, "left_semi")
    marg = u.groupBy(rating).agg(F.sum("n").alias("cnt"))
    m, n = F.sum("n"), F.col("n").cast("double")
    if level == "nominal":
        units = u.groupBy(item).agg(((m * m - F.sum(n * n)) / (m - 1)).alias("do"), m.alias("n"))
        both = units.select("do", "n", F.lit(0.0).alias("sq")).unionByName(
            marg.select(F.lit(0.0).alias("do"), F.lit(0).cast("bigint").alias("n"),
                        (F.col("cnt").cast("double") * F.col("cnt")).alias("sq")))
        total = both.agg(F.sum("do").alias("do"), F.sum("n").alias("n"), F.sum("sq").alias("sq"))
        de = F.col("n").cast("double") * F.col("n") - F.col("sq")
    else:
        if level == "ordinal":
            places = cumulative_counts(marg, [], rating).select(
                rating, (F.col("before") + F.col("cnt") / 2.0).alias("v"))
            u = u.join(places, rating)
        else:
            u = u.withColumn("v", F.col(rating).cast("double"))
        # differences do not change by a shift; around the mean the sums of squares stay exact
        mean = u.agg(F.sum(F.col("n") * F.col("v")) / F.sum("n")).first()[0] or 0.0
        v = F.col("v") - F.lit(mean)
        s1, s2 = F.sum(n * v), F.sum(n * v * v)
        units = u.groupBy(item).agg((2 * (m * s2 - s1 * s1) / (m - 1)).alias("do"), m.alias("n"),
                                    s1.alias("s1"), s2.alias("s2"))
        total = units.agg(F.sum("do").alias("do"), F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
        de = 2 * (F.col("n") * F.col("s2") - F.col("s1") * F.col("s1"))
    alpha = F.when(de > 0, 1 - (F.col("n") - 1) * F.col("do") / de).otherwise(F.lit(float("nan")))
    return total.select(F.lit(level).alias("level"), alpha.alias("alpha"))


def icc(ratings: DataFrame, rater: str = "rater", item: str = "item", rating: str = "rating") -> DataFrame:
    """ICC(1), ICC(2), ICC(3) and their k-rater forms from the two-way
    mean squares; only items rated by every rater are used."""
    r = ratings.filter(F.col(rating).isNotNull()).select(rater, item, F.col(rating).cast("double").alias("x"))
    k = r.select(rater).distinct().count()
    full = r.groupBy(item).agg(F.count(F.lit(1)).alias("__c")).filter(F.col("__c") == k).select(item)
    r = r.join(full, item, "left_semi")
    n = full.count()
    gm = r.agg(F.avg("x")).first()[0]
    sst = r.agg(F.sum((F.col("x") - F.lit(gm)) ** 2)).first()[0]
    ssr = r.groupBy(item).agg(F.avg("x").alias("m")).agg(F.sum((F.col("m") - F.lit(gm)) ** 2)).first()[0] * k
    ssc = r.groupBy(rater).agg(F.avg("x").alias("m")).agg(F.sum((F.col("m") - F.lit(gm)) ** 2)).first()[0] * n
    sse = sst - ssr - ssc
    ssw = sst - ssr
    msr, msc = ssr / (n - 1), ssc / (k - 1)
    mse, msw = sse / ((n - 1) * (k - 1)), ssw / (n * (k - 1))
    vals = {
        "ICC1": (msr - msw) / (msr + (k - 1) * msw),
        "ICC2": (msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n),
        "ICC3": (msr - mse) / (msr + (k - 1) * mse),
        "ICC1k": (msr - msw) / msr,
        "ICC2k": (msr - mse) / (msr + (msc - mse) / n),
        "ICC3k": (msr - mse) / msr,
    }
    spark = ratings.sparkSession
    return spark.createDataFrame([(name, float(v)) for name, v in vals.items()], "type string, icc double")


def confusion(df: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Counts and rates of a binary prediction against the truth."""
    p, t = F.col(pred) == 1, F.col(truth) == 1
    c = df.agg(F.sum(F.when(p & t, 1).otherwise(0)).alias("tp"), F.sum(F.when(p & ~t, 1).otherwise(0)).alias("fp"),
               F.sum(F.when(~p & t, 1).otherwise(0)).alias("fn"), F.sum(F.when(~p & ~t, 1).otherwise(0)).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec = F.try_divide(tp, tp + fp)
    rec = F.try_divide(tp, tp + fn)
    return c.select("tp", "fp", "fn", "tn",
                    F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"), prec.alias("precision"),
                    rec.alias("recall"), F.try_divide(tn, tn + fp).alias("specificity"),
                    F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


def intruder_tasks(shown: DataFrame, foreign: DataFrame, key: str = "doc_id", tag: str = "tag") -> DataFrame:
    """E16 build: for each document one intruder = the foreign tag (not among
    the shown ones) that comes first in md5(key|tag) order. ``foreign`` is a
    bounded candidate list per document (e.g. another topic's top words)."""
    cand = foreign.select(key, tag).join(shown.select(key, tag), [key, tag], "left_anti")
    order = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col(tag)))
    best = cand.groupBy(key).agg(F.min_by(F.col(tag), order).alias("intruder"))
    return best


def intruder_rate(tasks: DataFrame, answers: DataFrame, key: str = "doc_id", group: str = "n_tags") -> DataFrame:
    """E16 score: share of tasks whose answer is the intruder, per group."""
    j = tasks.join(answers, key)
    return j.groupBy(group).agg(F.avg(F.when(F.col("answer") == F.col("intruder"), 1.0).otherwise(0.0)).alias("rate"),
                                F.count(F.lit(1)).alias("tasks"))


def rating_means(ratings: DataFrame, by=("model",), rating: str = "rating") -> DataFrame:
    """Mean rating per group, NA excluded, with NA and rated counts."""
    return ratings.groupBy(*by).agg(F.avg(rating).alias("mean"), F.count(rating).alias("rated"),
                                    (F.count(F.lit(1)) - F.count(rating)).alias("na"))


def label_agreement(assign: DataFrame, labels: DataFrame, key: str = "doc_id", cluster: str = "topic",
                    label: str = "label") -> DataFrame:
    """Purity (the share of documents in their cluster's majority label), topic recall (share
    of labels that are some cluster's majority), document coverage (share
    not in the outlier cluster -1)."""
    j = assign.select(key, cluster).join(labels.select(key, label), key)
    cnt = j.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("c"))
    maj = cnt.filter(F.col(cluster) != -1).groupBy(cluster).agg(
        F.max_by(F.col(label), F.struct(F.col("c"), -F.col(label))).alias("maj"), F.max("c").alias("cmax"))
    n = j.count()
    n_labels = labels.select(label).distinct().count()
    purity = maj.agg(F.sum("cmax")).first()[0] or 0
    recall = maj.select("maj").distinct().count()
    covered = j.filter(F.col(cluster) != -1).count()
    spark = assign.sparkSession
    return spark.createDataFrame([(float(purity) / n, float(recall) / n_labels, float(covered) / n)],
                                 "purity double, topic_recall double, coverage double")
