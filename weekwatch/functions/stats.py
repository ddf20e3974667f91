"""Rank correlation, its p-value and the two-sample Kolmogorov tail."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, Window as W, functions as F
from pyspark.sql.types import DoubleType

RELIABLE_N = 30  # fixed value: smallest sample read as reliable


def average_rank(value: str, partition: list[str]) -> Column:
    """Average rank of ties inside a partition whose size is bounded by the calendar or the places."""
    by_value = W.partitionBy(*partition).orderBy(value)
    ties = W.partitionBy(*partition, value)
    return F.rank().over(by_value) + (F.count(F.lit(1)).over(ties) - 1) / 2


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows that have both; null when a side is constant.

    Built from covariance and deviations: corr() itself divides by zero on a constant side.
    """
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_pop(a, b), spread))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def _regularized_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1.0 - x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation from Student's t with n-2 degrees of freedom."""

    def one(rho: float, count: float):
        if pd.isna(rho) or pd.isna(count) or count < 3:
            return None
        dof = count - 2
        rest = 1.0 - rho * rho
        return 0.0 if rest <= 0 else _regularized_beta(dof / 2.0, 0.5, dof / (dof + rho * rho * dof / rest))

    return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="float64")


def kolmogorov_p(statistic: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided tail: 2 * sum (-1)^(k-1) exp(-2 k^2 (D en)^2), kept in 0..1."""
    z2 = F.pow(statistic, 2.0) * (n1 * n2 / (n1 + n2))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * z2),
    )
    return F.when(statistic == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series)))
