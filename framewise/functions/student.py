"""Tail probabilities of Student's t and Fisher's F for tables of one row a fit (vectorised Python; there is no built-in function)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            return front * out
    raise ArithmeticError("the continued fraction does not converge")


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / (df + t * t), df / 2, 0.5)


def t_quantile(level: float, df: float) -> float:
    """The t beyond which both tails together hold 1 - level."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 1 - level:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > 1 - level else (low, mid)
        if high - low < 1e-13 * high:
            break
    return (low + high) / 2


def f_upper(f: float, a: float, b: float) -> float:
    return incomplete_beta(b / (b + a * f), b / 2, a / 2)


def _apply(fn, *cols: Column) -> Column:
    def each(*parts: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else fn(*row) for row in zip(*parts)], dtype=float)

    n = len(cols)
    if n == 1:
        def udf(a: pd.Series) -> pd.Series:
            return each(a)
    elif n == 2:
        def udf(a: pd.Series, b: pd.Series) -> pd.Series:
            return each(a, b)
    else:
        def udf(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return each(a, b, c)
    return F.pandas_udf(udf, "double")(*[c.cast("double") for c in cols])


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic; null without degrees of freedom."""
    return F.when(df >= 1, _apply(lambda x, d: t_two_sided(x, d) if d >= 1 else None, t, df))


def t_critical(df: Column, level: float = 0.95) -> Column:
    """Half-width of a confidence interval in standard errors."""
    return F.when(df >= 1, _apply(lambda d: t_quantile(level, d) if d >= 1 else None, df))


def f_p_value(f: Column, a: Column, b: Column) -> Column:
    return F.when(b >= 1, _apply(lambda x, m, n: f_upper(x, m, n) if n >= 1 and x >= 0 else None, f, a, b))
