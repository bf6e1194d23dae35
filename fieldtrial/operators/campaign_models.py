"""One small kernel regression per campaign, all campaigns in the same job."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_int
from ..functions.vectors import matrix
from ..session import cut_lineage, join_small
from .models import NOISE, rbf
from .neighbours import BASE_TILE, pair_sizes, tile_grid

DOUBLES = T.ArrayType(T.DoubleType())


def fit_campaigns(
    observed: DataFrame,
    keys: Sequence[str],
    point: str = "point_id",
    m: int = 50,
    noise: float = NOISE,
    length: float = 1.0,
    seed: int | str = 42,
) -> DataFrame:
    """One model row per campaign: inducing points, their weights and the variance matrix.

    The inducing points are all observations of a campaign, or ``m`` drawn by hash. Blocks of
    observations add up m x m sums, and the weights are solved per campaign. Features and labels
    are standardized per campaign; the row carries their means and deviations.
    """
    ks = list(keys)
    scale = cut_lineage(campaign_scale(observed, ks), "scale")
    placed = join_small(observed.select(*ks, point, "x", "y"), scale, ks, computed=True)
    rows = cut_lineage(
        placed.select(
            *ks,
            F.col(point).alias("_q"),
            F.zip_with(
                F.zip_with("x", "x_mean", lambda v, m: v - m), "x_std", lambda v, s: v / s
            ).alias("_qx"),
            ((F.col("y") - F.col("y_mean")) / F.col("y_std")).alias("y"),
        ),
        "observed",
    )
    order = W.partitionBy(*ks).orderBy("_h", "_q")
    z = cut_lineage(
        rows.withColumn("_h", hash_int(str(seed), "inducing", *[F.col(k) for k in ks], F.col("_q")))
        .withColumn("_b", F.row_number().over(order))
        .where(F.col("_b") <= m)
        .select(*ks, F.col("_b").cast("long").alias("_b"), F.col("_qx").alias("_bx")),
        "inducing",
    )

    def partial(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        k = rbf(matrix(left["_qx"]), matrix(right.sort_values("_b")["_bx"]), length)
        flat = np.concatenate([k.T @ left["y"].to_numpy(float), (k.T @ k).ravel()])
        return pd.DataFrame({"sums": pd.Series([flat], dtype=object)})

    parts = tile_grid(
        rows, z, ks, pair_sizes(rows, z, ks), BASE_TILE, partial, [T.StructField("sums", DOUBLES)]
    )
    entry = (
        parts.select(*ks, F.posexplode("sums").alias("_i", "_v"))
        .groupBy(*ks, "_i")
        .agg(F.sum("_v").alias("_v"))
    )
    # At most m inducing points and m + m * m numbers per campaign.
    sums = entry.groupBy(*ks).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_s"))
    places = z.groupBy(*ks).agg(F.array_sort(F.collect_list(F.struct("_b", "_bx"))).alias("_z"))

    @F.pandas_udf(T.StructType([T.StructField("w", DOUBLES), T.StructField("inv", DOUBLES)]))
    def solve(flat: pd.Series, centres: pd.Series) -> pd.DataFrame:
        weights, inverses = [], []
        for s, c in zip(flat, centres):
            c = np.stack([np.asarray(v, dtype=float) for v in c])
            p = len(c)
            s = np.asarray(s, dtype=float)
            kmm = rbf(c, c, length) + 1e-6 * np.eye(p)
            weights.append(np.linalg.solve(s[p:].reshape(p, p) + noise * kmm, s[:p]))
            inverses.append(np.linalg.inv(kmm).ravel())
        return pd.DataFrame({"w": weights, "inv": inverses})

    return cut_lineage(
        sums.join(places, ks)
        .withColumn("_m", solve(F.col("_s._v"), F.col("_z._bx")))
        .join(scale, ks)
        .select(
            *ks, F.lit(0).cast("long").alias("_b"), F.col("_z._bx").alias("z"), "_m.w", "_m.inv",
            "x_mean", "x_std", "y_mean", "y_std",
        ),
        "models",
    )


def campaign_scale(observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means and deviations of ``x`` and ``y`` per campaign; a constant has deviation 1."""
    ks = list(keys)
    deviation = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(F.lit(1.0))
    dims = (
        observed.select(*ks, F.posexplode("x").alias("_d", "_v"))
        .groupBy(*ks, "_d")
        .agg(F.avg("_v").alias("_m"), deviation("_v").alias("_s"))
    )
    # One row per dimension and campaign.
    wide = dims.groupBy(*ks).agg(F.array_sort(F.collect_list(F.struct("_d", "_m", "_s"))).alias("_a"))
    labels = observed.groupBy(*ks).agg(F.avg("y").alias("y_mean"), deviation("y").alias("y_std"))
    return wide.join(labels, ks).select(
        *ks, F.col("_a._m").alias("x_mean"), F.col("_a._s").alias("x_std"), "y_mean", "y_std"
    )


def score_campaigns(
    model: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    point: str = "point_id",
    noise: float = NOISE,
    length: float = 1.0,
) -> DataFrame:
    """Rows with the posterior ``mean`` and ``std`` of their campaign's model, block by block."""
    ks = list(keys)
    kept = [c for c in rows.columns if c not in (*ks, point, "x")]
    asked = rows.select(*ks, F.col(point).alias("_q"), F.col("x").alias("_qx"), *kept)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        one = right.iloc[0]
        c = np.stack([np.asarray(v, dtype=float) for v in one["z"]])
        p = math.isqrt(len(one["inv"]))
        inv = np.asarray(one["inv"], dtype=float).reshape(p, p)
        x = (matrix(left["_qx"]) - np.asarray(one["x_mean"])) / np.asarray(one["x_std"])
        k = rbf(x, c, length)
        var = np.maximum(1.0 - (k * (k @ inv)).sum(1) + noise, 1e-6)
        mean = k @ np.asarray(one["w"], dtype=float)
        return left.assign(
            mean=mean * one["y_std"] + one["y_mean"], std=np.sqrt(var) * one["y_std"]
        )

    fields = [
        *[asked.schema[c] for c in ("_q", "_qx", *kept)],
        T.StructField("mean", T.DoubleType()),
        T.StructField("std", T.DoubleType()),
    ]
    scored = tile_grid(asked, model, ks, pair_sizes(asked, model, ks), BASE_TILE, score, fields)
    return scored.withColumnRenamed("_q", point).withColumnRenamed("_qx", "x")


def campaign_posterior(
    observed: DataFrame, candidates: DataFrame, keys: Sequence[str], m: int = 50, **kernel
) -> DataFrame:
    """Posterior ``mean`` and ``std`` of each candidate from the observations of its campaign."""
    return score_campaigns(fit_campaigns(observed, keys, m=m, **kernel), candidates, keys, **kernel)
