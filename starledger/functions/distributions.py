"""Tail probabilities without scipy, for the few rows that a test gives. Numerical recipes are the usual continued fractions."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY, _EPS, _ROUNDS = 1e-300, 1e-15, 10_000


def _lentz(step, first: float) -> float:
    """Continued fraction by the modified Lentz method; ``step(i)`` gives the i-th numerator and denominator."""
    f = first or _TINY
    c, d = f, 0.0
    for i in range(1, _ROUNDS):
        a, b = step(i)
        d = b + a * d or _TINY
        c = b + a / c or _TINY
        d = 1 / d
        f *= c * d
        if abs(c * d - 1) < _EPS:
            break
    return f


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)

    def step(i: int) -> tuple[float, float]:
        m = i // 2
        if i == 1:
            return 1.0, 1.0
        i -= 1
        m = i // 2
        if i % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    return front * _lentz(step, 0.0)


def gamma_tail(a: float, x: float) -> float:
    """Regularized Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * _EPS:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    return front * _lentz(lambda i: (1.0, x + 1 - a) if i == 1 else (-(i - 1) * (i - 1 - a), x + 2 * i - 1 - a), 0.0)


def t_two_sided(t: float, df: float) -> float:
    return 0.0 if math.isinf(t) else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return 0.0 if math.isinf(f) else incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


@lru_cache(64)
def _u_counts(n: int, m: int) -> tuple[int, ...]:
    """How many orders of n and m values give each U, by the generating function of partitions in a box."""
    poly = [1]
    for i in range(1, n + 1):  # times (1 - q^(m+i)) / (1 - q^i)
        up = poly + [0] * (m + i)
        for k in range(len(poly)):
            up[k + m + i] -= poly[k]
        for k in range(i, len(up)):
            up[k] += up[k - i]
        poly = up[: i * m + 1]
    return tuple(poly)


def mann_whitney_exact(u: float, n: int, m: int) -> float:
    """Two-sided p of U without ties."""
    counts = _u_counts(min(n, m), max(n, m))
    most = max(u, n * m - u)
    return min(1.0, 2 * sum(counts[math.ceil(most) :]) / sum(counts))


_KINDS = {
    "t": lambda s, a, b: t_two_sided(s, a), "f": f_tail, "chi2": lambda s, a, b: chi2_tail(s, a), "z": lambda s, a, b: normal_two_sided(s),
    "u": lambda s, a, b: mann_whitney_exact(s, int(a), int(b)), "upper_z": lambda s, a, b: normal_tail(s),
}


@F.pandas_udf(T.DoubleType())
def p_value(kind: pd.Series, statistic: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """p of one row a test: a few rows, whatever the data's size. Null in, null out."""
    return pd.Series([None if pd.isna(s) else _KINDS[k](s, x, y) for k, s, x, y in zip(kind, statistic, a, b, strict=True)], dtype="float64")


def p_of(kind: str, statistic: Column, a: Column | float = 0.0, b: Column | float = 0.0) -> Column:
    a, b = (c if isinstance(c, Column) else F.lit(float(c)) for c in (a, b))
    return p_value(F.lit(kind), statistic.cast("double"), a.cast("double"), b.cast("double"))
