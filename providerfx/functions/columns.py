"""Scalar functions as Column expressions, and the two survival functions for the driver's and Arrow's use."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights at or below 0 count as this much.
LEAST_WEIGHT = 1e-10


def col(name: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column) -> Column:
    """Null outside (0, 1)."""
    return F.when((p > 0) & (p < 1), F.ln(p / (1.0 - p)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def weight(n: Column, prob: Column, least: float = LEAST_WEIGHT) -> Column:
    w = n * prob * (1.0 - prob)
    return F.when(w <= 0, F.lit(least)).otherwise(w)


def clamp(x: Column, centre: Column, bound: float) -> Column:
    return F.least(F.greatest(x, centre - bound), centre + bound)


def verdict(flag: Column) -> Column:
    return F.when(flag > 0, "above the null value").when(flag < 0, "below the null value").when(flag == 0, "no clear difference").otherwise("no result")


def provider_name(k: Column) -> Column:
    return F.format_string("P%03d", k)


def normal_p(z) -> np.ndarray:
    """Two-sided p of a standard normal statistic; NaN stays NaN."""
    return np.array([math.erfc(abs(x) / math.sqrt(2)) if x == x else math.nan for x in np.atleast_1d(z)])


def chi2_p(x) -> np.ndarray:
    """Survival of chi-square with one degree of freedom, 1 at or below 0."""
    return np.array([math.nan if v != v else 1.0 if v <= 0 else math.erfc(math.sqrt(v / 2)) for v in np.atleast_1d(x)])
