"""Arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def sqnorm(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v)


def sqdist(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)))


def clip(x: Column, low: Column, high: Column) -> Column:
    """Coordinates moved inside ``low`` .. ``high``."""
    raised = F.zip_with(x, low, lambda v, b: F.greatest(v, b))
    return F.zip_with(raised, high, lambda v, b: F.least(v, b))


def unit_scale(x: Column, low: Column, high: Column) -> Column:
    """Coordinates relative to the bounds; a zero range divides by 1."""
    width = F.zip_with(high, low, lambda h, l: F.when(h > l, h - l).otherwise(F.lit(1.0)))
    return F.zip_with(F.zip_with(x, low, lambda v, l: v - l), width, lambda v, w: v / w)


def from_unit(u: Column, low: Column, high: Column) -> Column:
    """Unit-cube coordinates placed inside the bounds."""
    width = F.zip_with(high, low, lambda h, l: h - l)
    return F.zip_with(low, F.zip_with(width, u, lambda w, v: w * v), lambda l, s: l + s)


def matrix(column: pd.Series) -> np.ndarray:
    """Rows of an array column as a dense matrix."""
    return np.stack(column.to_numpy()).astype(float, copy=False)


def times_matrix(x: Column, weights: np.ndarray) -> Column:
    """``x @ weights`` for a small driver-side matrix, evaluated on Arrow batches."""
    fixed = np.asarray(weights, dtype=float)

    @F.pandas_udf("array<double>")
    def project(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        return pd.Series(list(matrix(rows) @ fixed))

    return project(x)
