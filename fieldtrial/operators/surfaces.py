"""Polynomial response surfaces of any order, one per campaign."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import dot
from ..session import cut_lineage, join_small
from .campaign_models import campaign_scale
from .scoring import gram

DOUBLES = T.ArrayType(T.DoubleType())
_TERM = "array<struct<last:int,v:double>>"


def design_vector(x: Column, order: int) -> Column:
    """All products of at most ``order`` coordinates, by degree: 1, x1, x2, x1 x1, x1 x2, x2 x2, ..."""
    terms = F.array(F.struct(F.lit(0).alias("last"), F.lit(1.0).alias("v")))
    every = [terms]
    for _ in range(order):

        def longer(t):
            more = F.transform(
                F.sequence(t["last"], F.size(x) - 1),
                lambda j: F.struct(j.alias("last"), (t["v"] * F.get(x, j)).alias("v")),
            )
            return F.when(F.size(x) > 0, more).otherwise(F.array().cast(_TERM))

        every.append(F.flatten(F.transform(every[-1], longer)))
    return F.transform(F.concat(*every), lambda t: t["v"])


def fit_surfaces(observed: DataFrame, keys: Sequence[str], order: int = 2) -> DataFrame:
    """Least-squares coefficients ``w`` per campaign, with the feature scale they refer to.

    Features are standardized first, which leaves the surface as it is and the sums well behaved.
    Where observations are fewer than terms, the coefficients are those of least norm.
    """
    ks = list(keys)
    scale = cut_lineage(campaign_scale(observed, ks).select(*ks, "x_mean", "x_std"), "scale")
    placed = join_small(observed.select(*ks, "x", "y"), scale, ks, computed=True)
    sums = gram(placed.withColumn("_v", design_vector(_standard(), order)), ks, "_v", "y")

    @F.pandas_udf(DOUBLES)
    def solve(xtx: pd.Series, xty: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(xtx, xty):
            p = len(b)
            out.append(np.linalg.lstsq(np.asarray(a, dtype=float).reshape(p, p), np.asarray(b, dtype=float), rcond=1e-12)[0])
        return pd.Series(out, dtype=object)

    return cut_lineage(sums.select(*ks, solve("xtx", "xty").alias("w")).join(scale, ks), "surfaces")


def _standard() -> Column:
    return F.zip_with(F.zip_with("x", "x_mean", lambda v, m: v - m), "x_std", lambda v, s: v / s)


def surface_values(surfaces: DataFrame, rows: DataFrame, keys: Sequence[str], order: int = 2) -> DataFrame:
    """Rows with the ``mean`` that the surface of their campaign predicts."""
    placed = join_small(rows, surfaces, keys)
    mean = dot(design_vector(_standard(), order), F.col("w"))
    return placed.withColumn("mean", mean).drop("w", "x_mean", "x_std")
