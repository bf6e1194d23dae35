"""Distribution functions that Spark SQL does not ship."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Coefficients of Abramowitz & Stegun 7.1.26 for the error function.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """Error function, absolute error at most 1.5e-7."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return F.signum(x) * (F.lit(1.0) - poly * F.exp(-x * x))


def norm_cdf(z: Column) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(z / F.lit(math.sqrt(2.0))))


def norm_pdf(z: Column) -> Column:
    return F.exp(F.lit(-0.5) * z * z) / F.lit(math.sqrt(2.0 * math.pi))


def chi2_tail(x: float, dof: int) -> float:
    """P(chi-square with ``dof`` degrees of freedom > x), by the finite series."""
    if x is None or dof is None or math.isnan(x) or dof < 1:
        return float("nan")
    if x <= 0:
        return 1.0
    half = x / 2.0
    if dof % 2 == 0:
        term, acc = 1.0, 1.0
        for i in range(1, dof // 2):
            term *= half / i
            acc += term
        return math.exp(-half) * acc
    acc, term = 0.0, math.sqrt(2.0 * x / math.pi)
    for i in range((dof - 1) // 2):
        acc += term
        term *= x / (2 * i + 3)
    return math.erfc(math.sqrt(half)) + math.exp(-half) * acc


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(a) or pd.isna(k) else chi2_tail(float(a), int(k)) for a, k in zip(x, dof)],
        dtype="float64",
    )


def beta_cdf(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """Regularized incomplete beta function, by Lentz's continued fraction."""
    x = np.asarray(x, dtype=float)
    flip = x > (a + 1.0) / (a + b + 2.0)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    z = np.clip(np.where(flip, 1.0 - x, x), 1e-300, 1.0)
    front = np.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * np.log(z) + q * np.log1p(-z)
    ) / p
    c, d = np.ones_like(z), 1.0 / _away_from_zero(1.0 - (p + q) * z / (p + 1.0))
    f = d.copy()
    # The fraction settles after a multiple of sqrt(a + b) steps.
    for m in range(1, 1000 + 50 * math.isqrt(int(a + b) + 1)):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        d = 1.0 / _away_from_zero(1.0 + even * d)
        c = _away_from_zero(1.0 + even / c)
        f = f * d * c
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d = 1.0 / _away_from_zero(1.0 + odd * d)
        c = _away_from_zero(1.0 + odd / c)
        f = f * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-14):
            break
    return np.where(flip, 1.0 - front * f, front * f)


def _away_from_zero(v: np.ndarray) -> np.ndarray:
    return np.where(np.abs(v) < 1e-300, 1e-300, v)


def beta_quantile(p: np.ndarray, a: float, b: float) -> np.ndarray:
    """Inverse of :func:`beta_cdf` by Newton steps kept inside a shrinking bracket."""
    p = np.asarray(p, dtype=float)
    low, high = np.zeros_like(p), np.ones_like(p)
    mean, spread = a / (a + b), math.sqrt(a * b / (a + b + 1.0)) / (a + b)
    normal = NormalDist()
    start = mean + spread * np.array([normal.inv_cdf(v) for v in p])
    x = np.clip(start, mean * 1e-3, 1.0 - (1.0 - mean) * 1e-3)
    scale = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    for _ in range(60):
        gap = beta_cdf(x, a, b) - p
        low, high = np.where(gap < 0, x, low), np.where(gap < 0, high, x)
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            slope = np.exp(scale + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x))
            step = x - gap / slope
        settled = np.abs(step - x) <= 1e-12
        if np.all(settled):
            break
        inside = settled | ((step > low) & (step < high))
        x = np.where(inside, step, (low + high) / 2.0)
    return x
