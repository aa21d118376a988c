"""Tail probabilities of the two-sample tests. They run on one row per column, not on data."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def chi_square_tail(x: float, dof: float) -> float:
    """P(X >= x) for a chi-square number: the upper incomplete gamma ratio."""
    if x <= 0 or dof <= 0:
        return 1.0
    a, z = dof / 2.0, x / 2.0
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:  # series for the lower part
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1.0 - front * total)
    b = z + 1 - a  # continued fraction for the upper part
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2
        d = 1.0 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * h)


def kolmogorov_tail(distance: float, n: float, m: float) -> float:
    """Limit distribution of the two-sample Kolmogorov-Smirnov distance."""
    size = n * m / (n + m)
    x = math.sqrt(size) * distance
    if x < 0.2:
        return 1.0
    terms = ((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))
    return min(1.0, max(0.0, 2 * sum(terms)))


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


@pandas_udf(T.DoubleType())
def p_value(
    kind: pd.Series, statistic: pd.Series, dof: pd.Series, n: pd.Series, m: pd.Series
) -> pd.Series:
    """p-value by name of the test; null where there is no statistic."""
    out = []
    for k, s, d, a, b in zip(kind, statistic, dof, n, m, strict=True):
        if s is None or pd.isna(s):
            out.append(None)
        elif k == "ks":
            out.append(kolmogorov_tail(s, a, b))
        elif k == "z":
            out.append(normal_tail(s))
        else:
            out.append(chi_square_tail(s, d))
    return pd.Series(out, dtype="float64")
