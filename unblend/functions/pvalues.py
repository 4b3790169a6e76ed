"""P-values, with numpy for tables of one row a gene and type, else with the standard library for one row a test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def normal_tails(z: np.ndarray) -> np.ndarray:
    """Upper tails of the normal distribution, all at once: the series of erf near 0, the continued fraction of erfc beyond."""
    z = np.asarray(z, float)
    x = np.abs(z) / math.sqrt(2.0)
    near = np.minimum(x, 2.5)
    term = near.copy()
    total = near.copy()
    for k in range(1, 80):
        term = term * 2.0 * near * near / (2 * k + 1)
        total += term
    small = 0.5 - np.exp(-near * near) / math.sqrt(math.pi) * total
    far = np.maximum(x, 2.5)
    rest = np.zeros_like(far)
    for k in range(80, 0, -1):
        rest = k / 2.0 / (far + rest)
    tail = np.where(x < 2.5, small, 0.5 * np.exp(-far * far) / math.sqrt(math.pi) / (far + rest))
    return np.where(np.isnan(z), np.nan, np.where(z >= 0, tail, 1.0 - tail))


@F.pandas_udf(T.DoubleType())
def normal_sf_column(z: pd.Series) -> pd.Series:
    return pd.Series(normal_tails(z.to_numpy(float)))


def corr_p_column(r: str, n: str) -> Column:
    """Two-sided p of a column of correlations over ``n`` pairs; one row a test."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else corr_p(x, int(k)) for x, k in zip(r, n)], dtype=float)

    return p(F.col(r), F.col(n))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def corr_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation by the t distribution."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return beta_inc((n - 2) / 2.0, 0.5, (n - 2) / (n - 2 + t2))


def fisher_greater(a: int, b: int, c: int, d: int) -> float:
    """One-sided p of a 2 x 2 table: ``a`` as large as it is, or larger."""
    row, col, n = a + b, a + c, a + b + c + d
    choose = lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
    base = choose(n, col)
    return min(1.0, sum(math.exp(choose(row, k) + choose(n - row, col - k) - base) for k in range(a, min(row, col) + 1)))


def mann_whitney_greater(u: float, n1: int, n2: int, ties: float) -> float:
    """One-sided asymptotic p with tie and continuity correction; ``ties``: sum of t^3 - t."""
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1.0))) if n > 1 else 0.0
    return 1.0 if var <= 0 else normal_sf((u - n1 * n2 / 2.0 - 0.5) / math.sqrt(var))


def wilcoxon_greater(w: float, n: int, ties: float, exact_to: int = 50) -> float:
    """One-sided p of the signed-rank sum ``w`` over ``n`` nonzero differences: exact
    for up to ``exact_to`` of them without ties, else the normal approximation."""
    if not n:
        return 1.0
    if n <= exact_to and not ties:
        ways = [1]
        for k in range(1, n + 1):
            more = ways + [0] * k
            for i, x in enumerate(ways):
                more[i + k] += x
            ways = more
        return sum(ways[math.ceil(w - 1e-9) :]) / float(2**n)
    var = n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0
    return 1.0 if var <= 0 else normal_sf((w - n * (n + 1) / 4.0) / math.sqrt(var))
