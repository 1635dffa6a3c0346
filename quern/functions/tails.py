"""Tail probabilities of t, F, chi-squared and normal statistics as Arrow-batched functions of columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, on the side where that converges fast."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (z > 0) & (z < 1)
    z = np.where(inside, z, 0.5)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / np.where(np.abs(1 + top * d) < tiny, tiny, 1 + top * d)
            c = np.where(np.abs(1 + top / c) < tiny, tiny, 1 + top / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    value = np.where(swap, 1 - front * h, front * h)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


def incomplete_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    z = np.maximum(x, 1e-300)
    front = np.exp(a * np.log(z) - z - _lgamma(a))
    term = total = 1 / a
    for n in range(1, 2000):
        term = term * z / (a + n)
        total = total + term
        if np.all(term <= total * 1e-16):
            break
    b = z + 1 - a
    c, d = np.full_like(z, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d.copy()
    for n in range(1, 2000):
        top = -n * (n - a)
        b = b + 2
        d = 1 / np.where(np.abs(top * d + b) < 1e-300, 1e-300, top * d + b)
        c = np.where(np.abs(b + top / c) < 1e-300, 1e-300, b + top / c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return np.where(x <= 0, 1.0, np.where(z < a + 1, 1 - front * total, front * h))


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided."""
    t, n = t.to_numpy(float), dof.to_numpy(float)
    return pd.Series(incomplete_beta(n / 2, np.full_like(n, 0.5), n / (n + t * t)))


@F.pandas_udf(DoubleType())
def f_pvalue(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    f, a, b = f.to_numpy(float), df1.to_numpy(float), df2.to_numpy(float)
    return pd.Series(incomplete_beta(b / 2, a / 2, b / (b + a * np.maximum(f, 0))))


@F.pandas_udf(DoubleType())
def chi2_pvalue(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(incomplete_gamma(dof.to_numpy(float) / 2, x.to_numpy(float) / 2))


@F.pandas_udf(DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    """Two-sided."""
    return pd.Series([math.erfc(abs(v) / math.sqrt(2)) for v in z.to_numpy(float)])


def t_quantile(p: float, dof: float) -> float:
    """Inverse of the t distribution by bisection, for intervals."""
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        tail = float(incomplete_beta(dof / 2, 0.5, dof / (dof + mid * mid))) / 2
        low, high = (mid, high) if (1 - tail if mid > 0 else tail) < p else (low, mid)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def t_quantiles(p: pd.Series, dof: pd.Series) -> pd.Series:
    """Inverse of the t distribution, all rows of a batch bisected at once."""
    p, n = p.to_numpy(float), dof.to_numpy(float)
    low, high = np.full_like(p, -1e4), np.full_like(p, 1e4)
    for _ in range(80):
        mid = (low + high) / 2
        tail = incomplete_beta(n / 2, np.full_like(n, 0.5), n / (n + mid * mid)) / 2
        below = np.where(mid > 0, 1 - tail, tail) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return pd.Series((low + high) / 2)
