"""Distribution tails for test statistics.

These run on a handful of result rows (one per test), so they are plain
Python on numbers, applied with a pandas UDF. Continued fractions and series
follow the standard numerical recipes for the regularised incomplete beta
and gamma functions.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1.0:
        s, term, ap = 1.0 / a, 1.0 / a, a
        for _ in range(100000):
            ap += 1.0
            term *= x / ap
            s += term
            if abs(term) < abs(s) * 1e-16:
                break
        return 1.0 - s * math.exp(-x + a * math.log(x) - math.lgamma(a))
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 100000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = d if abs(d) > tiny else tiny
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        d = 1.0 / d
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-16:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f) for an F(d1, d2) variable."""
    if f is None or math.isnan(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_sf(x: float, k: float) -> float:
    if x is None or math.isnan(x) or k <= 0:
        return float("nan")
    return gammainc_upper(k / 2.0, x / 2.0)


def t_sf2(t: float, df: float) -> float:
    """Two-sided P(|T| > |t|)."""
    if t is None or math.isnan(t) or df <= 0:
        return float("nan")
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def norm_sf2(z: float) -> float:
    """Two-sided P(|Z| > |z|)."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _wrap(fn, n):
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([fn(*[None if pd.isna(v) else float(v) for v in vals]) if not any(pd.isna(v) for v in vals)
                          else float("nan") for vals in zip(*cols)], dtype="float64")
    return F.pandas_udf(run, T.DoubleType())


f_pvalue = _wrap(f_sf, 3)
chi2_pvalue = _wrap(chi2_sf, 2)
t_pvalue = _wrap(t_sf2, 2)
z_pvalue = _wrap(norm_sf2, 1)
phi = _wrap(norm_cdf, 1)


# -- studentised range ----------------------------------------------------------

def _range_cdf_inf(w: float, k: int, z, wz) -> float:
    """P(range of k standard normals < w) by quadrature over z."""
    from math import erf, sqrt
    import numpy as np
    phi = np.exp(-0.5 * z * z) / np.sqrt(2 * np.pi)
    cdf = 0.5 * (1 + np.vectorize(erf)(z / sqrt(2)))
    cdf_w = 0.5 * (1 + np.vectorize(erf)((z - w) / sqrt(2)))
    return float(k * np.sum(wz * phi * np.clip(cdf - cdf_w, 0, 1) ** (k - 1)))


def ptukey_sf(q: float, k: float, df: float) -> float:
    """P(Q > q) for the studentised range of k means with df degrees of
    freedom: the range distribution of k normals integrated over the chi
    distribution of s (Gauss-Legendre quadrature; about 1e-5 accuracy)."""
    import numpy as np
    if q is None or math.isnan(q) or k < 2 or df <= 0:
        return float("nan")
    if q <= 0:
        return 1.0
    k = int(round(k))
    xz, wzz = np.polynomial.legendre.leggauss(120)
    z = 8.0 * xz          # z over [-8, 8]
    wz = 8.0 * wzz
    if df > 5000:
        return 1.0 - _range_cdf_inf(q, k, z, wz)
    # s = sqrt(chi2_df / df); density of s
    xs, ws = np.polynomial.legendre.leggauss(120)
    lo, hi = max(1e-6, 1 - 8 / math.sqrt(2 * df)), 1 + 10 / math.sqrt(2 * df)
    s = 0.5 * (hi - lo) * xs + 0.5 * (hi + lo)
    wsn = 0.5 * (hi - lo) * ws
    v = df
    log_f = (math.log(2.0) + (v / 2) * math.log(v / 2) - math.lgamma(v / 2)
             + (v - 1) * np.log(s) - v * s * s / 2)
    fs = np.exp(log_f)
    cdf = sum(wi * fi * _range_cdf_inf(q * si, k, z, wz) for si, wi, fi in zip(s, wsn, fs))
    return float(min(1.0, max(0.0, 1.0 - cdf)))


tukey_pvalue = _wrap(ptukey_sf, 3)
