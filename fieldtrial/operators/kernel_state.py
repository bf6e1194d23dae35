"""Kernel regressions kept as sums, so that new observations cost only themselves.

A campaign's state holds its basis (inducing points and the scale of its features, fixed when it is
made), the sums over its observations that the weights depend on, and the weights of the last solve.
Adding rows adds to the sums; solving reads the sums, not the rows, and gives what fitting all rows
on that basis gives. A state can hold bagged replicas: their sums are made in the same pass, with
hashed Poisson weights per row. Replica 0 is always the whole sample.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_int, hash_u
from ..functions.vectors import matrix
from ..session import cut_lineage, join_small
from .campaign_models import campaign_scale
from .models import NOISE, rbf
from .neighbours import BASE_TILE, pair_sizes, tile_grid

DOUBLES = T.ArrayType(T.DoubleType())
BASIS = ["z", "x_mean", "x_std"]
# Poisson weights above this have a probability below 1e-10.
MOST_COPIES = 12


def standard(x: str | Column, mean: str = "x_mean", std: str = "x_std") -> Column:
    return F.zip_with(F.zip_with(x, mean, lambda v, m: v - m), std, lambda v, s: v / s)


def kernel_basis(
    observed: DataFrame, keys: Sequence[str], point: str = "point_id", m: int = 50, seed: int | str = 42
) -> DataFrame:
    """Keys, ``z`` (at most ``m`` standardized observations, drawn by hash), ``x_mean`` and ``x_std``."""
    ks = list(keys)
    scale = campaign_scale(observed, ks).select(*ks, "x_mean", "x_std")
    drawn = observed.select(*ks, point, "x").withColumn(
        "_h", hash_int(str(seed), "inducing", *[F.col(k) for k in ks], F.col(point))
    )
    order = W.partitionBy(*ks).orderBy("_h", point)
    drawn = drawn.withColumn("_b", F.row_number().over(order)).where(F.col("_b") <= m)
    # At most m points per campaign.
    points = drawn.groupBy(*ks).agg(F.array_sort(F.collect_list(F.struct("_b", "x"))).alias("_z"))
    scaled = F.transform("_z.x", lambda x: standard(x))
    return cut_lineage(points.join(scale, ks).select(*ks, scaled.alias("z"), "x_mean", "x_std"), "basis")


def poisson_weight(u: Column) -> Column:
    """The Poisson(1) count whose distribution function first exceeds ``u``."""
    out, term, below = F.lit(0.0), math.exp(-1), 0.0
    for k in range(MOST_COPIES):
        below += term
        term /= k + 1
        out = out + F.when(u >= F.lit(below), 1.0).otherwise(0.0)
    return out


def bag_weights(replicas: int, keys: Sequence[str], point: str, seed: int | str) -> Column:
    """The weights of a row: 1, then a hashed Poisson count for every replica."""
    own = F.array(F.lit(1.0))
    if not replicas:
        return own
    parts = [F.col(k) for k in keys] + [F.col(point)]
    bags = F.transform(
        F.sequence(F.lit(1), F.lit(replicas)), lambda r: poisson_weight(hash_u(str(seed), "bag", r, *parts))
    )
    return F.concat(own, bags)


def kernel_sums(
    rows: DataFrame, basis: DataFrame, keys: Sequence[str], weights: Column, point: str = "point_id", length: float = 1.0
) -> DataFrame:
    """Keys and ``sums``: per weight the numbers w, wy, wyy, wk (m), wyk (m) and wkk' (m x m).

    Blocks of rows add up their own part, so a campaign of any size is many tasks.
    """
    ks = list(keys)
    asked = rows.select(
        *ks, F.col(point).alias("_q"), F.col("x").alias("_qx"), F.col("y").cast("double").alias("y"), weights.alias("_w")
    )
    side = basis.select(*ks, F.lit(0).cast("long").alias("_b"), *BASIS)

    def partial(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        one = right.iloc[0]
        z = np.stack([np.asarray(v, dtype=float) for v in one["z"]])
        k = rbf((matrix(left["_qx"]) - np.asarray(one["x_mean"])) / np.asarray(one["x_std"]), z, length)
        y, parts = left["y"].to_numpy(float), []
        for w in matrix(left["_w"]).T:
            wk = k * w[:, None]
            parts += [[w.sum(), w @ y, w @ (y * y)], wk.sum(0), wk.T @ y, (wk.T @ k).ravel()]
        return pd.DataFrame({"sums": pd.Series([np.concatenate(parts)], dtype=object)})

    tiles = tile_grid(
        asked, side, ks, pair_sizes(asked, side, ks), BASE_TILE, partial, [T.StructField("sums", DOUBLES)]
    )
    entry = tiles.select(*ks, F.posexplode("sums").alias("_i", "_v")).groupBy(*ks, "_i").agg(F.sum("_v").alias("_v"))
    # One row per number; a campaign has (1 + replicas) (3 + 2 m + m m) of them.
    whole = entry.groupBy(*ks).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_s"))
    return whole.select(*ks, F.col("_s._v").alias("sums"))


def _parts(flat: np.ndarray, m: int) -> list[tuple]:
    """The sums of every replica: w, wy, wyy, wk, wyk, wkk'."""
    each = flat.reshape(-1, 3 + 2 * m + m * m)
    return [(*r[:3], r[3 : 3 + m], r[3 + m : 3 + 2 * m], r[3 + 2 * m :].reshape(m, m)) for r in each]


def solve_sums(flat: np.ndarray, z: np.ndarray, noise: float, length: float) -> tuple[list, list, list]:
    """Weights, label means and label deviations per replica; an empty replica is the whole sample."""
    m = len(z)
    kmm = rbf(z, z, length) + 1e-6 * np.eye(m)
    parts = _parts(flat, m)
    out = []
    for part in parts:
        n, sy, syy, k1, ky, kk = part if part[0] > 0 else parts[0]
        mean = sy / n
        std = math.sqrt(max(syy / n - mean * mean, 0.0))
        std = std if std > 1e-12 * (1.0 + abs(mean)) else 1.0
        out.append((np.linalg.solve(kk + noise * kmm, (ky - mean * k1) / std), mean, std))
    return [w.tolist() for w, _, _ in out], [m for _, m, _ in out], [s for _, _, s in out]


_SOLVED = T.StructType(
    [T.StructField("w", T.ArrayType(DOUBLES)), T.StructField("y_mean", DOUBLES), T.StructField("y_std", DOUBLES)]
)


def solved(state: DataFrame, refit_every: int = 1, noise: float = NOISE, length: float = 1.0) -> DataFrame:
    """States whose weights are due are solved again; ``refitted`` says which.

    They are due when no weights are there yet, or when ``refit_every`` observations have come since
    ``n_fit``. The others keep theirs.
    """
    n = F.col("sums")[0]
    due = F.col("n_fit").isNull() | (n - F.col("n_fit") >= refit_every)

    @F.pandas_udf(_SOLVED)
    def solve(flat: pd.Series, z: pd.Series, due: pd.Series, w: pd.Series, mean: pd.Series, std: pd.Series) -> pd.DataFrame:
        rows = []
        for s, c, again, *old in zip(flat, z, due, w, mean, std):
            centres = np.stack([np.asarray(v, dtype=float) for v in c])
            rows.append(solve_sums(np.asarray(s, dtype=float), centres, noise, length) if again else old)
        return pd.DataFrame(rows, columns=["w", "y_mean", "y_std"])

    marked = state.withColumn("refitted", due)
    fitted = marked.withColumn("_m", solve("sums", "z", "refitted", "w", "y_mean", "y_std"))
    return fitted.withColumns(
        {
            "w": F.col("_m.w"), "y_mean": F.col("_m.y_mean"), "y_std": F.col("_m.y_std"),
            "n_fit": F.when(F.col("refitted"), n).otherwise(F.col("n_fit")),
        }
    ).drop("_m")


def new_state(basis: DataFrame, sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A state without weights."""
    return basis.join(sums, list(keys)).select(
        *keys, *BASIS, "sums", F.lit(None).cast("double").alias("n_fit"),
        F.lit(None).cast("array<array<double>>").alias("w"), F.lit(None).cast("array<double>").alias("y_mean"),
        F.lit(None).cast("array<double>").alias("y_std"),
    )


def added(state: DataFrame, sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state after rows whose sums are given."""
    more = sums.withColumnRenamed("sums", "_more")
    both = F.zip_with("sums", F.coalesce("_more", F.transform("sums", lambda v: F.lit(0.0))), lambda a, b: a + b)
    return state.join(more, list(keys), "left").withColumn("sums", both).drop("_more")


def predicted(
    state: DataFrame, rows: DataFrame, keys: Sequence[str], point: str = "point_id", noise: float = NOISE, length: float = 1.0
) -> DataFrame:
    """Rows with ``means`` and ``stds``: the posterior of every replica of their campaign's state."""
    ks = list(keys)
    kept = [c for c in rows.columns if c not in (*ks, point, "x")]
    asked = rows.select(*ks, F.col(point).alias("_q"), F.col("x").alias("_qx"), *kept)
    side = state.select(*ks, F.lit(0).cast("long").alias("_b"), *BASIS, "w", F.col("y_mean"), F.col("y_std"))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        one = right.iloc[0]
        z, w = (np.stack([np.asarray(v, dtype=float) for v in one[c]]) for c in ("z", "w"))
        mean, std = (np.asarray(one[c], dtype=float) for c in ("y_mean", "y_std"))
        inverse = np.linalg.inv(rbf(z, z, length) + 1e-6 * np.eye(len(z)))
        k = rbf((matrix(left["_qx"]) - np.asarray(one["x_mean"])) / np.asarray(one["x_std"]), z, length)
        spread = np.sqrt(np.maximum(1.0 - (k * (k @ inverse)).sum(1) + noise, 1e-6))
        return left.assign(means=list(k @ w.T * std + mean), stds=list(spread[:, None] * std))

    fields = [asked.schema[c] for c in ("_q", "_qx", *kept)] + [T.StructField(c, DOUBLES) for c in ("means", "stds")]
    scored = tile_grid(asked, side, ks, pair_sizes(asked, side, ks), BASE_TILE, score, fields)
    return scored.withColumnRenamed("_q", point).withColumnRenamed("_qx", "x")


def ensemble(means: Column, stds: Column) -> tuple[Column, Column]:
    """Mean and deviation over the replicas after the first: variance of means plus mean of variances."""
    bags, spreads = F.slice(means, 2, F.size(means)), F.slice(stds, 2, F.size(stds))
    n = F.size(bags).cast("double")
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    mean = add(bags) / n
    between = add(F.transform(bags, lambda v: (v - mean) * (v - mean))) / n
    return mean, F.sqrt(between + add(F.transform(spreads, lambda s: s * s)) / n)


def campaign_state(
    observed: DataFrame, keys: Sequence[str], point: str = "point_id", m: int = 50, replicas: int = 0,
    seed: int | str = 42, noise: float = NOISE, length: float = 1.0,
) -> DataFrame:
    """A solved state of all observations, one row per campaign."""
    basis = kernel_basis(observed, keys, point, m, seed)
    sums = kernel_sums(observed, basis, keys, bag_weights(replicas, keys, point, seed), point, length)
    return solved(new_state(basis, sums, keys), 1, noise, length)


def precision_state(
    observed: DataFrame, noise_at: DataFrame, keys: Sequence[str], point: str = "point_id", m: int = 50,
    seed: int | str = 42, noise: float = NOISE, length: float = 1.0,
) -> DataFrame:
    """A solved state in which a row weighs noise / (noise + its own standardized noise variance).

    ``noise_at`` has the keys, the point and ``noise_var`` in the units of y squared.
    """
    ks = list(keys)
    spread = observed.groupBy(*ks).agg(F.var_pop("y").alias("_v"))
    rows = join_small(observed.join(noise_at, [*ks, point]), spread, ks)
    share = F.col("noise_var") / F.when(F.col("_v") > 0, F.col("_v")).otherwise(1.0)
    basis = kernel_basis(observed, keys, point, m, seed)
    sums = kernel_sums(rows, basis, keys, F.array(F.lit(noise) / (F.lit(noise) + share)), point, length)
    return solved(new_state(basis, sums, keys), 1, noise, length)
