"""Student's t without other libraries: distribution, quantile, and power."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_share(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def t_two_sided(t: float, df: float) -> float:
    return beta_share(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def t_power(effect: float, se: float, df: float, alpha: float = 0.05) -> float:
    """Two-sided power of a t test at a true effect: the non-central t, by integrating over the chi distribution."""
    if not se > 0:
        return 1.0 if effect else alpha
    cut, shift = t_quantile(1 - alpha / 2, df), effect / se
    phi = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    total, steps = 0.0, 2000
    top = math.sqrt(df) + 12
    for k in range(steps):
        s = (k + 0.5) * top / steps
        density = math.exp((1 - df / 2) * math.log(2) + (df - 1) * math.log(s) - s * s / 2 - math.lgamma(df / 2))
        scale = s / math.sqrt(df)
        total += density * (phi(shift - cut * scale) + phi(-cut * scale - shift)) * top / steps
    return min(1.0, total)


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p of a column of t values; null stays null."""

    @F.pandas_udf("double")
    def p_value(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(a, b) if a == a and b == b and a is not None and b > 0 else None for a, b in zip(ts, dfs)], dtype="float64")

    return p_value(t, df.cast("double"))


def t_figures(mean: Column, se: Column, df: Column) -> Column:
    """struct<mde, power>: the least effect detectable with power 0.8 at level 0.05, and the power at the mean observed."""

    @F.pandas_udf("mde double, power double")
    def figures(means: pd.Series, ses: pd.Series, dfs: pd.Series) -> pd.DataFrame:
        rows = [((t_quantile(0.975, d) + t_quantile(0.8, d)) * s, t_power(m, s, d)) if d > 0 and s == s else (None, None) for m, s, d in zip(means, ses, dfs)]
        return pd.DataFrame(rows, columns=["mde", "power"]).astype(float)

    return figures(mean, se, df.cast("double"))
