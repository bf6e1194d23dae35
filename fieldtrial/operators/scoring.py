"""Acquisition scores and the statistics they need."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import py_normal
from ..functions.special import norm_cdf, norm_pdf
from ..functions.vectors import matrix, sqdist, times_matrix
from ..session import join_small
from .exact import HOT_ROWS, agg_with_quantiles
from .neighbours import BASE_TILE, knn, pair_sizes, tile_grid

STD_FLOOR = 1e-6


def _improvement(mean: Column, std: Column, best: Column) -> Column:
    z = (mean - best) / std
    return (mean - best) * norm_cdf(z) + std * norm_pdf(z)


def expected_improvement(
    mean: Column, std: Column, best: Column, std_floor: float = STD_FLOOR
) -> Column:
    s = F.greatest(std, F.lit(std_floor))
    return F.greatest(_improvement(mean, s, best), F.lit(0.0))


def ei_bonus(mean: Column, std: Column, best: Column) -> Column:
    """Improvement plus a tenth of the deviation, without a floor at zero."""
    s = F.greatest(std, F.lit(STD_FLOOR))
    return _improvement(mean, s, best) + F.lit(0.1) * s


def noise_aware_ei(mean: Column, std: Column, noise_var: Column, best: Column) -> Column:
    """Improvement under model and local noise together, plus 0.01 of the model deviation."""
    s = F.greatest(std, F.lit(1e-8))
    both = F.sqrt(s * s + noise_var)
    return _improvement(mean, both, best) + F.lit(0.01) * s


def ucb(mean: Column, std: Column, kappa: float = 1.0) -> Column:
    return mean + F.lit(kappa) * F.greatest(std, F.lit(STD_FLOOR))


def predicted_value(prediction: Column) -> Column:
    return prediction


def denoised_best(observed: DataFrame, keys: Sequence[str], mean: str = "mean") -> DataFrame:
    """Largest posterior mean over the observed rows of each campaign."""
    return observed.groupBy(*keys).agg(F.max(mean).alias("best"))


def mad_sigma(
    df: DataFrame, keys: Sequence[str] = (), value: str = "y", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Robust deviation: 1.4826 times the median absolute deviation, plus 1e-9."""
    ks = list(keys)
    data = df if ks else df.withColumn("_all", F.lit(0))
    by = ks or ["_all"]
    middle = agg_with_quantiles(data, by, value, {"_med": 0.5}, (), hot_rows)
    away = join_small(data, middle, by).withColumn(
        "_dev", F.abs(F.col(value) - F.col("_med"))
    )
    spread = agg_with_quantiles(away, by, "_dev", {"_mad": 0.5}, (), hot_rows)
    return spread.select(*ks, (F.lit(1.4826) * F.col("_mad") + F.lit(1e-9)).alias("sigma"))


def local_noise(
    observed: DataFrame,
    at: DataFrame,
    keys: Sequence[str] = (),
    k: int = 10,
    observed_id: str = "point_id",
    at_id: str = "query_id",
    value: str = "y",
) -> DataFrame:
    """Noise variance at given places from their ``k`` nearest observations.

    The population variance of the neighbours' values, at least a tenth of the squared robust
    deviation, plus 1e-9.
    """
    near = knn(at, observed, k, keys, at_id, observed_id)
    values = observed.select(*keys, observed_id, F.col(value).alias("_y"))
    local = (
        near.join(values, [*keys, observed_id])
        .groupBy(*keys, at_id)
        .agg(F.var_pop("_y").alias("_var"))
    )
    sigma = mad_sigma(observed, keys, value)
    if keys:
        joined = join_small(local, sigma, keys)
    else:
        one = F.broadcast(sigma.limit(1).withColumn("_one", F.lit(1)))
        joined = local.withColumn("_one", F.lit(1)).join(one, "_one")
    floor = F.lit(0.1) * F.col("sigma") * F.col("sigma")
    return joined.select(
        *keys, at_id, (F.greatest("_var", floor) + F.lit(1e-9)).alias("noise_var")
    )


def observation_noise(
    observed: DataFrame, keys: Sequence[str], k: int = 10, point: str = "point_id", value: str = "y"
) -> DataFrame:
    """Noise variance at the observations themselves, each among its own neighbours.

    A campaign of n observations takes min(k, n - 1) neighbours, at least one. Columns: keys, the
    point and ``noise_var``, with the floor of ``local_noise``.
    """
    ks = list(keys)
    asked = observed.select(*ks, F.col(point).alias("_at"), "x")
    near = knn(asked, observed, k, ks, "_at", point)
    n = observed.groupBy(*ks).agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("_most"))
    values = observed.select(*ks, point, F.col(value).alias("_y"))
    local = (
        join_small(near, n, ks)
        .where(F.col("nn") <= F.col("_most"))
        .join(values, [*ks, point])
        .groupBy(*ks, "_at")
        .agg(F.var_pop("_y").alias("_var"))
    )
    floor = F.lit(0.1) * F.col("sigma") * F.col("sigma")
    return join_small(local, mad_sigma(observed, ks, value), ks).select(
        *ks, F.col("_at").alias(point), (F.greatest("_var", floor) + F.lit(1e-9)).alias("noise_var")
    )


def feature_relevance(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """0.7 |correlation with y| + 0.3 variance / largest variance, per coordinate."""
    sx = F.stddev_pop("v") * F.stddev_pop("y")
    corr = F.when(sx > 0, F.covar_pop("v", "y") / sx)
    flat = df.select(*keys, "y", F.posexplode("x").alias("dim", "v"))
    per = flat.groupBy(*keys, "dim").agg(
        F.abs(corr).alias("_c"), F.var_pop("v").alias("_v")
    )
    top = per.groupBy(*keys).agg(F.max("_v").alias("_top"))
    if keys:
        both = join_small(per, top, keys)
    else:
        both = per.withColumn("_one", F.lit(1)).join(
            F.broadcast(top.withColumn("_one", F.lit(1))), "_one"
        )
    score = F.lit(0.7) * F.coalesce("_c", F.lit(0.0)) + F.lit(0.3) * F.col("_v") / (
        F.col("_top") + F.lit(1e-6)
    )
    return both.select(*keys, "dim", score.alias("relevance"))


def embedding_dim(n_observed: int, n_features: int) -> int:
    """Size of the projected space."""
    return max(1, min(max(3, n_observed // 3), n_features // 2, 8))


def projection_matrix(relevance: Sequence[float], d_out: int, seed: int | str) -> np.ndarray:
    """Random columns of unit length, rows scaled by sqrt(relevance share + 0.1)."""
    share = np.asarray(relevance, dtype=float)
    share = share / share.sum()
    raw = np.array(
        [[py_normal(seed, "project", i, j) for j in range(d_out)] for i in range(len(share))]
    )
    raw *= np.sqrt(share + 0.1)[:, None]
    return raw / np.linalg.norm(raw, axis=0)


def project(df: DataFrame, relevance: DataFrame, d_out: int, seed: int | str) -> DataFrame:
    """Features projected to ``d_out`` coordinates; one relevance row per feature is collected."""
    rows = relevance.orderBy("dim").collect()
    weights = projection_matrix([r["relevance"] for r in rows], d_out, seed)
    return df.withColumn("x", times_matrix(F.col("x"), weights))


def trust_region(
    candidates: DataFrame, observed: DataFrame, radius: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Candidates near the best observation of their campaign.

    The radius is widened by half when it holds no candidate, and all candidates are kept when
    that holds none either. ``radius`` has the keys and ``radius``.
    """
    # The first of equally good observations, where they are numbered.
    last = -F.col("point_id") if "point_id" in observed.columns else F.col("x")
    centre = observed.groupBy(*keys).agg(F.max_by("x", F.struct("y", last)).alias("_centre"))
    state = centre.join(radius, list(keys))
    placed = join_small(candidates, state, keys).withColumn(
        "distance", F.sqrt(sqdist(F.col("x"), F.col("_centre")))
    )
    inside = F.count(F.when(F.col("distance") <= F.col("radius"), 1))
    wide = F.count(F.when(F.col("distance") <= F.col("radius") * 1.5, 1))
    level = placed.groupBy(*keys).agg(
        F.when(inside > 0, F.lit(1.0)).when(wide > 0, F.lit(1.5)).alias("_factor")
    )
    return (
        join_small(placed, level, keys)
        .where(
            F.col("_factor").isNull() | (F.col("distance") <= F.col("radius") * F.col("_factor"))
        )
        .withColumn("level", F.coalesce(F.col("_factor"), F.lit(0.0)))
        .drop("_centre", "_factor")
    )


def next_radius(scored: DataFrame, radius: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shrink after a standout score, grow otherwise, within [0.1, 1].

    A score stands out more than one deviation above the mean; of two scores neither does, however
    their mean is rounded.
    """
    deviation = F.stddev_pop("score")
    spread = scored.groupBy(*keys).agg(
        (F.max("score") - F.avg("score") > deviation * (1 + 1e-9)).alias("_good")
    )
    factor = F.when(F.col("_good"), F.lit(0.9)).otherwise(F.lit(1.1))
    return radius.join(spread, list(keys)).select(
        *keys, F.least(F.greatest(F.col("radius") * factor, F.lit(0.1)), F.lit(1.0)).alias("radius")
    )


MAX_OPEN_KEYS = 1000


def gram(
    df: DataFrame, keys: Sequence[str], x: str, y: str | None = None, weight: str | None = None
) -> DataFrame:
    """Weighted ``X'X`` and ``X'y`` per key.

    Every task adds up its own rows per key; only those small sums are shuffled. ``xtx`` is the
    row-major matrix, ``xty`` the vector, ``n`` the row count.
    """
    cols = [*keys, F.col(x).alias("_x")]
    cols.append((F.col(y) if y else F.lit(0.0)).alias("_y"))
    cols.append((F.col(weight) if weight else F.lit(1.0)).alias("_w"))
    data = df.select(*cols)
    schema = T.StructType(
        [data.schema[k] for k in keys] + [T.StructField("sums", T.ArrayType(T.DoubleType()))]
    )
    names = [f.name for f in schema]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[tuple, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            rows = [(*key, total) for key, total in kept.items()]
            kept.clear()
            return pd.DataFrame(rows, columns=names)

        for batch in batches:
            groups = batch.groupby(list(keys), sort=False) if keys else [((), batch)]
            for key, part in groups:
                m = matrix(part["_x"])
                w = part["_w"].to_numpy(float)
                xty = m.T @ (w * part["_y"].to_numpy(float))
                flat = np.concatenate([[len(part)], xty, (m.T @ (m * w[:, None])).ravel()])
                kept[key] = kept[key] + flat if key in kept else flat
            if len(kept) > MAX_OPEN_KEYS:
                yield flush()
        if kept:
            yield flush()

    entry = (
        data.mapInPandas(sums, schema)
        .select(*keys, F.posexplode("sums").alias("_i", "_v"))
        .groupBy(*keys, "_i")
        .agg(F.sum("_v").alias("_v"))
    )
    # One row per entry of the p x p matrix is collected back: 1 + p + p * p numbers.
    whole = entry.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_a")
    ).select(*keys, F.col("_a._v").alias("_a"))
    p = ((F.sqrt(4 * F.size("_a") - 3) - 1) / 2).cast("int")
    return whole.withColumn("_p", p).select(
        *keys,
        F.slice("_a", F.col("_p") + 2, F.col("_p") * F.col("_p")).alias("xtx"),
        F.slice("_a", F.lit(2), F.col("_p")).alias("xty"),
        F.col("_a")[0].cast("bigint").alias("n"),
    )


def d_optimal(
    observed: DataFrame,
    candidates: DataFrame,
    keys: Sequence[str],
    ridge: float = 1e-10,
    order: int = 1,
) -> DataFrame:
    """Score for the candidate that most increases det(X'X) of a polynomial model with intercept.

    det(M + vv') = det(M) (1 + v'M^-1 v), so the score is the leverage v'M^-1 v = |L^-1 v|^2 with the
    Cholesky factor L of M. ``order`` is that of the model: 1 is linear, 2 adds squares and products.
    A singular M gets a small ridge. Blocks of candidates are solved together, and a campaign's factor
    goes to each block once.
    """
    from .surfaces import design_vector

    ks = list(keys)

    def expanded(df: DataFrame) -> DataFrame:
        return df.withColumn("_v", design_vector(F.col("x"), order))

    info = gram(expanded(observed), ks, "_v")
    side = info.select(*ks, F.lit(0).cast("long").alias("_b"), F.col("xtx").alias("_bx"))
    kept = [c for c in candidates.columns if c not in ks]
    dealt = F.xxhash64(*candidates.columns).alias("_q")
    asked = expanded(candidates).select(*ks, dealt, F.col("_v").alias("_qx"), *kept)

    def leverage(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        v = matrix(left["_qx"])
        m = np.asarray(right["_bx"].iloc[0], dtype=float).reshape(v.shape[1], -1)
        if np.linalg.matrix_rank(m) < len(m):
            m = m + ridge * np.eye(len(m))
        try:
            solved = np.linalg.solve(np.linalg.cholesky(m), v.T)
            score = (solved * solved).sum(0)
        except np.linalg.LinAlgError:
            score = (v * np.linalg.solve(m, v.T).T).sum(1)
        return left.assign(score=score)

    fields = [*[asked.schema[c] for c in kept], T.StructField("score", T.DoubleType())]
    return tile_grid(asked, side, ks, pair_sizes(asked, side, ks), BASE_TILE, leverage, fields)
