"""Hypothesis tests and effect sizes over score tables.

Statistics come from grouped sufficient statistics (count, sums of powers,
ranks); p-values are computed on the few result rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pvalues as P
from ..functions.ranks import medians, midranks


def attach(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join per-stratum values onto ``df``; without strata ``small`` is one
    aggregate row, read to the driver and added as literals."""
    by = list(by)
    if by:
        return df.join(small, by)
    row = small.first()
    out = df
    for c, t in small.dtypes:
        # integer aggregates come back as 64-bit numbers
        v = F.lit(row[c]).cast("bigint") if t in ("int", "bigint") else F.lit(row[c])
        out = out.withColumn(c, v)
    return out


def group_stats(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """(group..., n, mean, var) with sample variance."""
    return df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                  F.var_samp(value).alias("var"))


def levene(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Levene's test centred on group medians (Brown-Forsythe)."""
    by = list(by)
    med = medians(df, by + [group], value)
    z = df.join(med, by + [group]).withColumn("z", F.abs(F.col(value) - F.col("median")))
    return _one_way(z, "z", group, by, "W")


def _one_way(df: DataFrame, value: str, group: str, by: list[str], name: str) -> DataFrame:
    """One-way ANOVA table per stratum, in one pass over the rows: a group's
    sum of squares is (n - 1) times its variance. Undefined statistics (one
    group, no spread within) are null."""
    gs = (df.groupBy(*by, group)
            .agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("__v"))
            .withColumn("ssw_g", F.coalesce((F.col("n") - 1) * F.col("__v"), F.lit(0.0))))
    # one row per group: windows over a stratum's groups are tiny
    w = Window.partitionBy(*by)
    gs = (gs.withColumn("n_tot", F.sum("n").over(w))
            .withColumn("grand", F.sum(F.col("n") * F.col("m")).over(w) / F.col("n_tot")))
    t = gs.groupBy(*by).agg(F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("ssb"),
                            F.sum("ssw_g").alias("ssw"), F.count(F.lit(1)).alias("k"), F.first("n_tot").alias("n_tot"))
    stat = F.try_divide(F.try_divide(F.col("ssb"), F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n_tot") - F.col("k")))
    out = t.select(*by, stat.alias(name), (F.col("k") - 1).cast("double").alias("df1"),
                   (F.col("n_tot") - F.col("k")).cast("double").alias("df2"),
                   F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")).alias("np2"))
    return out.withColumn("p", P.f_pvalue(name, "df1", "df2"))


def anova(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """One-way ANOVA F (per ``by`` stratum) with eta/partial eta squared."""
    return _one_way(df, value, group, list(by), "F_stat")


def bartlett(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Bartlett's test for equal variances. T is infinite when a group
    is constant and another is not, and null when it is undefined (a group of
    one row, a single group, or no spread at all)."""
    by = list(by)
    gs = group_stats(df, value, by + [group])
    a = gs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n_all"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("sv"),
        F.sum((F.col("n") - 1) * F.log("var")).alias("slv"),
        F.sum(F.try_divide(F.lit(1.0), F.col("n") - 1)).alias("sinv"),
        F.min("n").alias("n_min"), F.min("var").alias("v_min"))
    sp = F.try_divide(F.col("sv"), F.col("n_all") - F.col("k"))
    num = (F.col("n_all") - F.col("k")) * F.log(sp) - F.col("slv")
    den = F.lit(1.0) + F.try_divide(F.lit(1.0), 3 * (F.col("k") - 1)) * (
        F.col("sinv") - F.try_divide(F.lit(1.0), F.col("n_all") - F.col("k")))
    stat = F.when((F.col("n_min") > 1) & (F.col("k") > 1) & (F.col("sv") > 0),
                  F.when(F.col("v_min") > 0, F.try_divide(num, den)).otherwise(F.lit(float("inf"))))
    out = a.select(*by, stat.alias("T"), (F.col("k") - 1).cast("double").alias("df"))
    return out.withColumn("p", P.chi2_pvalue("T", "df"))


def cell_residuals(df: DataFrame, value: str, cells: Sequence[str], key: str) -> DataFrame:
    """Residual of each row from its cell mean (saturated two-way model)."""
    m = df.groupBy(*cells).agg(F.avg(value).alias("__m"))
    return df.join(m, list(cells)).select(key, *cells, (F.col(value) - F.col("__m")).alias("residual"))


def welch_anova(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Welch's ANOVA F, its degrees of freedom and np2 (SSB / SST). The
    test is undefined (null) when a group is constant or has one row."""
    by = list(by)
    gs = group_stats(df, value, by + [group]).withColumn("w", F.try_divide(F.col("n"), F.col("var")))
    w = Window.partitionBy(*by)  # one row per group
    j = (gs.withColumn("w_sum", F.sum("w").over(w)).withColumn("k", F.count(F.lit(1)).over(w))
           .withColumn("mp", F.try_divide(F.sum(F.col("w") * F.col("mean")).over(w), F.col("w_sum"))))
    t = j.groupBy(*by).agg(
        F.first("k").alias("k"), F.count("w").alias("n_w"),
        F.sum(F.col("w") * (F.col("mean") - F.col("mp")) ** 2).alias("A0"),
        F.sum(F.try_divide((1 - F.try_divide(F.col("w"), F.col("w_sum"))) ** 2, F.col("n") - 1)).alias("lam"))
    k = F.col("k")
    A = F.try_divide(F.col("A0"), k - 1)
    B = F.lit(1.0) + F.try_divide(2 * (k - 2), k * k - 1) * F.col("lam")
    told = F.col("n_w") == k  # every group has a variance above 0
    out = t.select(*by, F.when(told, F.try_divide(A, B)).alias("F_stat"), (k - 1).cast("double").alias("df1"),
                   F.when(told, F.try_divide(k * k - 1, 3 * F.col("lam"))).alias("df2"))
    np2 = _one_way(df, value, group, by, "__F").select(*by, "np2")
    return attach(out, np2, by).withColumn("p", P.f_pvalue("F_stat", "df1", "df2"))


def _pairs(gs: DataFrame, group: str, by: list[str]) -> DataFrame:
    """Every pair of groups (A < B) within each stratum, with both groups'
    statistics suffixed _a / _b. Built from the stratum's list of groups
    (one row per group, so bounded by the number of groups) by exploding it
    twice; no join is involved."""
    stats = [c for c in gs.columns if c not in by]
    lst = gs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*stats))).alias("__g"))
    one = lst.select(*by, F.posexplode("__g").alias("__i", "__x"), "__g")
    two = one.select(*by, "__i", "__x", F.posexplode("__g").alias("__j", "__y"), F.size("__g").alias("n_groups")) \
             .filter(F.col("__i") < F.col("__j"))
    return two.select(*by, *[F.col("__x")[c].alias(c + "_a") for c in stats],
                      *[F.col("__y")[c].alias(c + "_b") for c in stats], "n_groups")


def games_howell(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """E5: pairwise mean differences with Welch standard errors, the
    studentised statistic q = |t| sqrt(2), Welch df, Hedges' g, the
    Games-Howell p-value (studentised range with k groups and the Welch df,
    by quadrature) and, for reference, the two-sided Welch t p-value."""
    by = list(by)
    p = _pairs(group_stats(df, value, by + [group]), group, by)
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    se = F.sqrt(va + vb)
    t = (F.col("mean_a") - F.col("mean_b")) / se
    dof = (va + vb) ** 2 / (va ** 2 / (F.col("n_a") - 1) + vb ** 2 / (F.col("n_b") - 1))
    out = p.select(*by, F.col(group + "_a").alias("A"), F.col(group + "_b").alias("B"),
                   (F.col("mean_a") - F.col("mean_b")).alias("diff"), se.alias("se"), t.alias("T"),
                   (F.abs(t) * F.sqrt(F.lit(2.0))).alias("q"), dof.alias("df"),
                   _hedges(F.col("mean_a"), F.col("mean_b"), F.col("var_a"), F.col("var_b"),
                           F.col("n_a"), F.col("n_b")).alias("hedges"), "n_groups")
    return out.withColumn("p_t", P.t_pvalue("T", "df")).withColumn("p", P.tukey_pvalue("q", "n_groups", "df"))


def tukey_hsd(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """E6 post-hoc: Tukey HSD with the pooled within-group mean square:
    q = |m_a - m_b| / sqrt(MSE / 2 (1/n_a + 1/n_b)), df = N - k."""
    by = list(by)
    means = df.groupBy(*by, group).agg(F.avg(value).alias("m"))
    gs = (df.join(means, by + [group]).groupBy(*by, group)
            .agg(F.count(value).alias("n"), F.first("m").alias("m"),
                 F.sum((F.col(value) - F.col("m")) ** 2).alias("ssw_g")))
    w = Window.partitionBy(*by)  # one row per group
    gs = (gs.withColumn("mse", F.sum("ssw_g").over(w) / (F.sum("n").over(w) - F.count(F.lit(1)).over(w)))
            .withColumn("dfe", (F.sum("n").over(w) - F.count(F.lit(1)).over(w)).cast("double")))
    p = _pairs(gs.select(*by, group, "n", "m", "mse", "dfe"), group, by)
    q = F.abs(F.col("m_a") - F.col("m_b")) / F.sqrt(F.col("mse_a") / 2 * (F.lit(1.0) / F.col("n_a") + F.lit(1.0) / F.col("n_b")))
    out = p.select(*by, F.col(group + "_a").alias("A"), F.col(group + "_b").alias("B"),
                   (F.col("m_a") - F.col("m_b")).alias("diff"), q.alias("q"), F.col("dfe_a").alias("df"), "n_groups")
    return out.withColumn("p", P.tukey_pvalue("q", "n_groups", "df"))


def _cohen(ma, mb, va, vb, na, nb):
    pooled = F.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))
    return (ma - mb) / pooled


def _hedges(ma, mb, va, vb, na, nb):
    return _cohen(ma, mb, va, vb, na, nb) * (F.lit(1.0) - F.lit(3.0) / (4 * (na + nb) - 9))


def cohens_d(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Cohen's d (pooled SD) for every pair of groups."""
    by = list(by)
    p = _pairs(group_stats(df, value, by + [group]), group, by)
    return p.select(*by, F.col(group + "_a").alias("A"), F.col(group + "_b").alias("B"),
                    _cohen(F.col("mean_a"), F.col("mean_b"), F.col("var_a"), F.col("var_b"),
                           F.col("n_a"), F.col("n_b")).alias("d"))


def correlation(df: DataFrame, x: str, y: str, group: Sequence[str] = ()) -> DataFrame:
    """Pearson r and Spearman rho (Pearson on mid-ranks) per group."""
    group = list(group)
    pear = df.groupBy(*group).agg(F.corr(x, y).alias("pearson"), F.count(F.lit(1)).alias("n"))
    rx = midranks(df, group, x).select(*group, x, F.col("midrank").alias("rx"))
    ry = midranks(df, group, y).select(*group, y, F.col("midrank").alias("ry"))
    r = df.select(*group, x, y).join(rx, group + [x]).join(ry, group + [y])
    spear = r.groupBy(*group).agg(F.corr("rx", "ry").alias("spearman"))
    return attach(pear, spear, group)


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction and eta squared
    ((H - k + 1) / (N - k))."""
    mr = midranks(df, [], value)
    r = df.select(group, value).join(mr.select(value, "midrank"), value)
    g = r.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("midrank").alias("rank_sum"))
    ties = mr.agg(F.sum(F.col("cnt") ** 3 - F.col("cnt")).alias("tt"), F.sum("cnt").alias("n_all"))
    s = g.agg(F.sum(F.col("rank_sum") ** 2 / F.col("n")).alias("sr"), F.count(F.lit(1)).alias("k"))
    j = attach(s, ties, [])
    N = F.col("n_all").cast("double")
    H0 = 12.0 / (N * (N + 1)) * F.col("sr") - 3 * (N + 1)
    H = H0 / (F.lit(1.0) - F.col("tt") / (N ** 3 - N))
    out = j.select(H.alias("H"), (F.col("k") - 1).cast("double").alias("df"),
                   ((H - F.col("k") + 1) / (N - F.col("k"))).alias("eta2"))
    return out.withColumn("p", P.chi2_pvalue("H", "df"))


def dunn(df: DataFrame, value: str, group: str) -> DataFrame:
    """Dunn's pairwise z on mean ranks with tie correction; Bonferroni."""
    mr = midranks(df, [], value)
    r = df.select(group, value).join(mr.select(value, "midrank"), value)
    g = r.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("midrank").alias("rbar"))
    ties = mr.agg(F.sum(F.col("cnt") ** 3 - F.col("cnt")).alias("tt"), F.sum("cnt").alias("n_all"))
    p = _pairs(g, group, [])
    m = g.count() * (g.count() - 1) / 2
    j = attach(p, ties, [])
    N = F.col("n_all").cast("double")
    var = (N * (N + 1) / 12.0 - F.col("tt") / (12.0 * (N - 1))) * (F.lit(1.0) / F.col("n_a") + F.lit(1.0) / F.col("n_b"))
    z = (F.col("rbar_a") - F.col("rbar_b")) / F.sqrt(var)
    out = j.select(F.col(group + "_a").alias("A"), F.col(group + "_b").alias("B"), z.alias("z"))
    return out.withColumn("p", P.z_pvalue("z")).withColumn("p_bonf", F.least(F.lit(1.0), F.col("p") * F.lit(m)))


def cliffs_delta(df: DataFrame, value: str, group: str) -> DataFrame:
    """Cliff's delta for every pair of groups from value counts:
    delta = (#(a > b) - #(a < b)) / (n_a n_b). No pair of rows is formed."""
    vc = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("cnt"))
    groups = vc.select(group).distinct()
    pairs = _pairs(groups, group, []).select(F.col(group + "_a").alias("A"), F.col(group + "_b").alias("B"))
    # each group's counts in each pair it belongs to, tagged by side
    a = pairs.join(vc.withColumnRenamed(group, "A"), "A").select("A", "B", value, F.col("cnt").alias("ca"),
                                                                 F.lit(0).alias("cb"))
    b = pairs.join(vc.withColumnRenamed(group, "B"), "B").select("A", "B", value, F.lit(0).alias("ca"),
                                                                 F.col("cnt").alias("cb"))
    u = a.unionByName(b).groupBy("A", "B", value).agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    cum = cumulative_pairs(u, value)
    tot = u.groupBy("A", "B").agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb"))
    j = cum.join(tot, ["A", "B"])
    s = j.groupBy("A", "B").agg(
        F.sum(F.col("ca") * F.col("b_less")).alias("gt"),
        F.sum(F.col("ca") * (F.col("nb") - F.col("b_less") - F.col("cb"))).alias("lt"),
        F.first("na").alias("na"), F.first("nb").alias("nb"))
    return s.select("A", "B", ((F.col("gt") - F.col("lt")) / (F.col("na") * F.col("nb"))).alias("delta"))


def cumulative_pairs(u: DataFrame, value: str) -> DataFrame:
    """b_less = count of side-B values below each value, per (A, B) pair."""
    from ..functions.ranks import cumulative_counts
    c = cumulative_counts(u.withColumn("cnt", F.col("cb")), ["A", "B"], value)
    return c.withColumnRenamed("before", "b_less").drop("cnt")


def describe(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """E17 per group: n, mean, median, mode (smallest most frequent), sample
    sd, skewness and excess kurtosis (population moments)."""
    group = list(group)
    m = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                               F.stddev_samp(value).alias("sd"))
    d = F.col(value) - F.col("mean")
    mom = (df.join(m.select(*group, "mean"), group).groupBy(*group)
             .agg((F.sum(d ** 2) / F.count(value)).alias("m2"), (F.sum(d ** 3) / F.count(value)).alias("m3"),
                  (F.sum(d ** 4) / F.count(value)).alias("m4"))
             .select(*group, (F.col("m3") / F.col("m2") ** 1.5).alias("skewness"),
                     (F.col("m4") / F.col("m2") ** 2 - 3).alias("kurtosis")))
    # mode: the most frequent value, from (group, value, count); a partial top-1
    vc = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("c"))
    mode = vc.groupBy(*group).agg(F.min_by(F.col(value), F.struct(-F.col("c"), F.col(value))).alias("mode"))
    return m.join(mom, group).join(mode, group).join(medians(df, group, value), group)


def anderson_darling(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """E18 per group: Anderson-Darling A^2 for normality with estimated mean
    and sd, and the small-sample adjusted A*^2.

    The order statistics enter through sums over positions; for a run of
    tied values at positions before+1..before+cnt those sums have closed
    forms, so only (group, value, count) rows with cumulative counts are
    needed.
    """
    from ..functions.ranks import cumulative_counts, value_counts
    group = list(group)
    m = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    vc = cumulative_counts(value_counts(df, group, value), group, value).join(m, group)
    cdf = P.phi((F.col(value) - F.col("mean")) / F.col("sd"))
    vc = vc.withColumn("cdf", cdf)
    b, c, n = F.col("before"), F.col("cnt"), F.col("n")
    s_low = (b + c) ** 2 - b ** 2                         # sum of (2i - 1)
    s_high = c * (2 * n + 1) - ((b + c) * (b + c + 1) - b * (b + 1))  # sum of (2(n+1-i) - 1)
    t = vc.groupBy(*group).agg(F.sum(s_low * F.log("cdf") + s_high * F.log(1 - F.col("cdf"))).alias("s"),
                               F.first("n").alias("n"))
    a2 = -F.col("n") - F.col("s") / F.col("n")
    return t.select(*group, "n", a2.alias("A2"), (a2 * (1 + 0.75 / F.col("n") + 2.25 / F.col("n") ** 2)).alias("A2_star"))
