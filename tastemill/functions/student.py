"""Student t quantile: neither Spark nor its SQL functions have one. Runs on the small effects table only."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def t_upper_tail(t: float, dof: float) -> float:
    """P(T > t) for t >= 0 through the incomplete beta function."""
    x = dof / (dof + t * t)
    a, b = dof / 2.0, 0.5
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) if 0.0 < x < 1.0 else 0.0
    if x < (a + 1.0) / (a + b + 2.0):
        whole = front * _beta_fraction(a, b, x) / a
    else:
        whole = 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b
    return 0.5 * whole


def t_quantile(p: float, dof: float) -> float:
    """Inverse of the t distribution for p in (0.5, 1), by bisection."""
    if not (dof > 0 and math.isfinite(dof)):
        return math.nan
    tail = 1.0 - p
    low, high = 0.0, 1.0
    while t_upper_tail(high, dof) > tail:
        high *= 2.0
    for _ in range(200):
        mid = 0.5 * (low + high)
        if t_upper_tail(mid, dof) > tail:
            low = mid
        else:
            high = mid
        if high - low < 1e-13 * max(1.0, high):
            break
    return 0.5 * (low + high)


@F.pandas_udf(DoubleType())
def t_quantile_column(p: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(
        [t_quantile(a, b) if pd.notna(b) else np.nan for a, b in zip(p, dof)], dtype="float64"
    ).where(dof.notna(), None)
