"""Tail probabilities for the last, small step of a test (one row per test, Arrow batches)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _clean(x: float) -> bool:
    return x is not None and not math.isnan(x)


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * front
    # Lentz's method
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + num * d)
            c = 1 + num / c
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2.0, x / 2.0)


def t_sf(x: float, df: float) -> float:
    half = 0.5 * beta_i(df / 2.0, 0.5, df / (df + x * x))
    return half if x >= 0 else 1.0 - half


@F.pandas_udf(DoubleType())
def p_normal_upper(x: pd.Series) -> pd.Series:
    """P(Z > x)."""
    return x.map(lambda v: normal_sf(v) if _clean(v) else None).astype("float64")


@F.pandas_udf(DoubleType())
def p_normal_two(x: pd.Series) -> pd.Series:
    return x.map(lambda v: 2 * normal_sf(abs(v)) if _clean(v) else None).astype("float64")


@F.pandas_udf(DoubleType())
def p_chi2_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(max(a, 0.0), b) if _clean(a) and b > 0 else None for a, b in zip(x, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def p_t_two(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([2 * t_sf(abs(a), b) if _clean(a) and b > 0 else None for a, b in zip(x, df)], dtype="float64")
