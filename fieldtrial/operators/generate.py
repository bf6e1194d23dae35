"""Campaign seeds, generated points, candidate pools and hide splits.

All random numbers are hashes of (seed, keys, ids), so the result does not depend on how the
rows are partitioned and a recomputed task yields the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_int, hash_normal, hash_u, py_normal, py_u_open
from ..functions.vectors import clip, from_unit, matrix
from ..session import join_small
from .exact import hash_row_number

CHUNK = 100_000


def key_cols(keys: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def campaigns(
    cells: DataFrame,
    n_pools: int,
    n_competitions: int,
    random_state: int = 42,
    pool_stride: int = 100_000,
    hashed_pools: bool = True,
) -> DataFrame:
    """One row per cell, pool and competition, with the pool seed and the competition seed.

    ``hashed_pools=False`` with stride 1000 gives the plain pool seeds of the hard mode.
    """
    pool = F.explode(F.sequence(F.lit(0), F.lit(n_pools - 1)))
    comp = F.explode(F.sequence(F.lit(0), F.lit(n_competitions - 1)))
    rows = cells.withColumn("pool", pool).withColumn("competition", comp)
    synth = hash_int(F.concat(F.lit("synth_"), F.col("pool").cast("string")), mod=100_000)
    each = hash_int(F.concat(F.lit("comp_"), F.col("competition").cast("string")), mod=10_000)
    pool_seed = F.lit(random_state) + F.col("pool") * pool_stride
    return rows.withColumn(
        "pool_seed", (pool_seed + synth if hashed_pools else pool_seed).cast("bigint")
    ).withColumn(
        "competition_seed",
        (F.lit(random_state) + synth + F.col("competition") * 10_000 + each).cast("bigint"),
    )


def open_race_campaigns(cells: DataFrame, n_competitions: int, random_state: int = 42):
    """Open Race competitions are seeded by their index alone."""
    comp = F.explode(F.sequence(F.lit(0), F.lit(n_competitions - 1)))
    return cells.withColumn("competition", comp).withColumn(
        "competition_seed", (F.lit(random_state) + F.col("competition")).cast("bigint")
    )


def numbered(df: DataFrame, n: Column, name: str) -> DataFrame:
    """``n`` rows numbered from 0 per input row, spread over the tasks in chunks."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = df.withColumn("_n", n.cast("bigint")).where("_n > 0")
    last = F.floor((F.col("_n") - 1) / CHUNK)
    chunks = chunks.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    first = F.col("_chunk") * CHUNK
    return (
        chunks.repartition(parts, "_chunk", *df.columns[:1])
        .withColumn(name, F.explode(F.sequence(first, F.least(first + CHUNK, F.col("_n")) - 1)))
        .drop("_n", "_chunk")
    )


def unit_vector(d: int, *parts) -> Column:
    """``d`` uniform coordinates."""
    return F.array(*[hash_u(*parts, str(j)) for j in range(d)])


def uniform_points(
    limits: DataFrame, keys: Sequence[str], n: Column, d: int, seed: int | str
) -> DataFrame:
    """``n`` uniform points inside the bounds of each key."""
    points = numbered(limits, n, "point_id")
    u = unit_vector(d, str(seed), *key_cols(keys), F.col("point_id"))
    return points.select(*keys, "point_id", from_unit(u, F.col("low"), F.col("high")).alias("x"))


def latin_hypercube(
    points: DataFrame, keys: Sequence[str], point: str, d: int, seed: int | str
) -> DataFrame:
    """Unit-cube coordinates for the given points, one per stratum and dimension.

    The stratum of a point is its rank by a hash within (keys, dimension).
    """
    spread = points.select(
        *keys, point, F.explode(F.array(*[F.lit(j) for j in range(d)])).alias("dim")
    ).withColumn("_h", hash_int(str(seed), *key_cols(keys), F.col(point), F.col("dim")))
    ranked = hash_row_number(spread, [*keys, "dim"], "_h", [point], "_rank")
    total = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    jitter = hash_u(str(seed), "jitter", *key_cols(keys), F.col(point), F.col("dim"))
    placed = join_small(ranked, total, keys).withColumn(
        "_v", (F.col("_rank") - 1 + jitter) / F.col("_total")
    )
    # A point has d rows here.
    ordered = F.array_sort(F.collect_list(F.struct("dim", "_v")))
    return (
        placed.groupBy(*keys, point)
        .agg(ordered.alias("_c"))
        .select(*keys, point, F.col("_c._v").alias("u"))
    )


def scale_points(points: DataFrame, limits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unit coordinates ``u`` placed in the bounds of their key as ``x``."""
    return (
        join_small(points, limits, keys)
        .withColumn("x", from_unit(F.col("u"), F.col("low"), F.col("high")))
        .drop("u", "low", "high")
    )


def manifold_pool(
    data: DataFrame,
    keys: Sequence[str],
    row: str,
    n: Column,
    d: int,
    seed: int | str,
    jitter: float = 0.15,
) -> DataFrame:
    """Pool points near the data: resampled rows plus Gaussian jitter, clipped to the range.

    ``n`` points are drawn per key; it may use the column ``rows``.
    """
    indexed = hash_row_number(
        data.withColumn("_h", hash_int(str(seed), "row", *key_cols(keys), F.col(row))),
        keys, "_h", [row], "_idx",
    ).select(*keys, F.col("_idx").alias("_pick"), "x")
    spread = (
        data.select(*keys, F.posexplode("x").alias("dim", "v"))
        .groupBy(*keys, "dim")
        .agg(
            F.min("v").alias("low"), F.max("v").alias("high"), F.stddev_pop("v").alias("s"),
            F.count(F.lit(1)).alias("rows"),
        )
    )
    ordered = F.array_sort(F.collect_list(F.struct("dim", "low", "high", "s")))
    shape = spread.groupBy(*keys).agg(ordered.alias("_s"), F.max("rows").alias("rows")).select(
        *keys, "rows", F.col("_s.low").alias("low"), F.col("_s.high").alias("high"),
        F.col("_s.s").alias("s"),
    )
    slots = numbered(shape, n, "point_id")
    who = [str(seed), *key_cols(keys), F.col("point_id")]
    slots = slots.withColumn("_pick", hash_int(*who, "pick") % F.col("rows") + 1)
    noise = F.array(*[hash_normal(*who, str(j)) for j in range(d)])
    step = F.zip_with(noise, "s", lambda z, s: z * (s + F.lit(1e-9)) * F.lit(jitter))
    moved = F.zip_with("x", step, lambda a, b: a + b)
    return slots.join(indexed, [*keys, "_pick"]).select(
        *keys, "point_id", clip(moved, F.col("low"), F.col("high")).alias("x")
    )


def subsample(df: DataFrame, row: str, seed: int | str, n: int) -> DataFrame:
    """``n`` rows without replacement, or all rows where there are no more."""
    return df.orderBy(hash_int(str(seed), F.col(row)), row).limit(n)


def target_points(pool: DataFrame, keys: Sequence[str], point: str = "point_id") -> DataFrame:
    """Row with the largest label per key, the smallest id on ties."""
    best = F.max_by(F.struct(point, "y"), F.struct("y", (-F.col(point)).alias("_p")))
    return (
        pool.groupBy(*keys)
        .agg(best.alias("_b"))
        .select(*keys, F.col(f"_b.{point}").alias("target_id"), F.col("_b.y").alias("target_value"))
    )


def hide_split(
    pool: DataFrame,
    keys: Sequence[str],
    fraction: float,
    seed: int | str,
    point: str = "point_id",
) -> DataFrame:
    """Mark ``int(n * fraction)`` points per key as hidden; the target is always among them."""
    targets = target_points(pool, keys, point)
    sizes = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    small = targets.join(sizes, list(keys)).withColumn(
        "_others", F.floor(F.col("_n") * F.lit(fraction)) - 1
    )
    marked = join_small(pool, small, keys).withColumn(
        "is_target", F.col(point) == F.col("target_id")
    )
    hashed = marked.withColumn("_h", hash_int(str(seed), *key_cols(keys), F.col(point)))
    ranked = hash_row_number(hashed, [*keys, "is_target"], "_h", [point], "_rank")
    hidden = F.col("is_target") | (F.col("_rank") <= F.col("_others"))
    return ranked.withColumn("hidden", hidden).drop(
        "_n", "_others", "_h", "_rank", "target_id", "target_value"
    )


def hide_splits(
    pool: DataFrame, keys: Sequence[str], fractions: Sequence[float], seed: int | str
) -> DataFrame:
    """One split per hidden fraction."""
    out = None
    for f in fractions:
        part = hide_split(pool, keys, f, f"{seed}|{f}").withColumn("hidden_fraction", F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out


def matern_waves(d: int, n_waves: int, length: float, seed: int | str):
    """Random frequencies, phases and weights of a Matern-5/2 surface."""
    freq = np.empty((d, n_waves))
    for k in range(n_waves):
        chi = sum(py_normal(seed, "chi", k, i) ** 2 for i in range(5))
        for j in range(d):
            freq[j, k] = py_normal(seed, "freq", k, j) * math.sqrt(5.0 / chi) / length
    phase = np.array([2 * math.pi * py_u_open(seed, "phase", k) for k in range(n_waves)])
    weight = np.array([py_normal(seed, "weight", k) for k in range(n_waves)])
    return freq, phase, weight * math.sqrt(2.0 / n_waves)


def synthetic_dataset(
    points: DataFrame,
    point: str,
    d: int,
    seed: int | str = 42,
    noise: float = 0.1,
    length: float = 0.3,
    n_waves: int = 64,
) -> DataFrame:
    """Latin-hypercube features with a smooth random target rescaled to 0-10 plus noise."""
    freq, phase, weight = matern_waves(d, n_waves, length, seed)

    @F.pandas_udf(T.DoubleType())
    def surface(u: pd.Series) -> pd.Series:
        return pd.Series(np.cos(matrix(u) @ freq + phase) @ weight)

    one = points.withColumn("_all", F.lit(0))
    placed = latin_hypercube(one, ["_all"], point, d, seed).withColumn("_f", surface("u"))
    span = F.broadcast(
        placed.groupBy("_all").agg(F.min("_f").alias("_lo"), F.max("_f").alias("_hi"))
    )
    level = F.when(
        F.col("_hi") > F.col("_lo"), (F.col("_f") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    ).otherwise(F.lit(0.0))
    return placed.join(span, "_all").select(
        point,
        F.col("u").alias("x"),
        (level * 10 + F.lit(noise) * hash_normal(str(seed), "noise", F.col(point))).alias("y"),
        F.lit(noise * noise).alias("y_var"),
    )


def label_pool(
    pool: DataFrame, predict, seed: int | str, point: str = "point_id", noise: float = 0.0
) -> DataFrame:
    """Predictions as labels; ``predict`` adds a ``prediction`` column, noise is optional."""
    labelled = predict(pool)
    y = F.col("prediction")
    if noise > 0:
        y = y + F.lit(noise) * hash_normal(str(seed), "label", F.col(point))
    return labelled.withColumn("y", y).drop("prediction")
