"""Layers that make a response surface harder."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_normal, py_normal, py_u_open
from ..functions.vectors import dot, sqdist, sqnorm, total, vec


def add_noise(
    df: DataFrame, sigma: float, ids: Sequence, by: str | None = None, out: str = "y"
) -> DataFrame:
    """Gaussian noise on ``y``.

    The scale is ``sigma``; ``by="value"`` makes it ``|y| * sigma + 0.01`` and ``by="radius"``
    ``sigma * (1 + 0.5 * |x|^2)``. ``ids`` are the hash parts of a row.
    """
    if by == "value":
        scale = F.abs("y") * F.lit(sigma) + F.lit(0.01)
    elif by == "radius":
        scale = F.lit(sigma) * (F.lit(1.0) + F.lit(0.5) * sqnorm(F.col("x")))
    else:
        scale = F.lit(sigma)
    return df.withColumn(out, F.col("y") + scale * hash_normal(*ids))


def random_modes(
    low: Sequence[float], high: Sequence[float], n_modes: int, seed: int | str
) -> list[tuple[float, list[float]]]:
    """Weights (flat Dirichlet) and centres of the modes."""
    raw = [-math.log(py_u_open(seed, "weight", i)) for i in range(n_modes)]
    return [
        (
            raw[i] / sum(raw),
            [a + py_u_open(seed, "centre", i, j) * (b - a) for j, (a, b) in enumerate(zip(low, high))],
        )
        for i in range(n_modes)
    ]


def multimodal(
    df: DataFrame,
    modes: Sequence[tuple[float, Sequence[float]]],
    separation: float = 2.0,
    base=total,
    out: str = "y",
) -> DataFrame:
    """Weighted sum of ``base(x - centre)`` under a Gaussian bump around each centre."""
    x = F.col("x")
    value: Column = F.lit(0.0)
    for weight, centre in modes:
        shifted = F.zip_with(x, vec(centre), lambda v, c: v - c)
        bump = F.exp(-sqdist(x, vec(centre)) / F.lit(2.0 * separation * separation))
        value = value + F.lit(weight) * base(shifted) * bump
    return df.withColumn(out, value)


def add_bumps(df: DataFrame, n_modes: int, separation: float = 2.0, out: str = "y") -> DataFrame:
    """Extra bumps ``0.5 * exp(-|x - i * separation|^2)`` for i = 1 .. n_modes - 1."""
    value = F.col("y")
    for i in range(1, n_modes):
        offset = F.lit(i * separation)
        away = sqnorm(F.transform("x", lambda v: v - offset))
        value = value + F.lit(0.5) * F.exp(-away)
    return df.withColumn(out, value)


def random_planes(
    low: Sequence[float], high: Sequence[float], n: int, seed: int | str
) -> list[tuple[list[float], list[float]]]:
    """Unit normals and points of ``n`` hyperplanes."""
    planes = []
    for i in range(n):
        normal = np.array([py_normal(seed, "normal", i, j) for j in range(len(low))])
        point = [
            a + py_u_open(seed, "point", i, j) * (b - a) for j, (a, b) in enumerate(zip(low, high))
        ]
        planes.append(((normal / np.linalg.norm(normal)).tolist(), point))
    return planes


def plane_jumps(
    df: DataFrame,
    planes: Sequence[tuple[Sequence[float], Sequence[float]]],
    strength: float = 2.0,
    out: str = "y",
) -> DataFrame:
    """Add ``strength`` on the positive side of every plane."""
    value = F.col("y")
    for normal, point in planes:
        side = dot(F.zip_with("x", vec(point), lambda v, p: v - p), vec(normal))
        value = value + F.when(side > 0, F.lit(strength)).otherwise(F.lit(0.0))
    return df.withColumn(out, value)


def threshold_jumps(
    df: DataFrame, n: int, strength: float = 2.0, out: str = "y"
) -> DataFrame:
    """Add ``strength`` for each boundary i / (n + 1) that some coordinate exceeds."""
    value = F.col("y")
    for i in range(1, n + 1):
        boundary = F.lit(i / (n + 1))
        above = F.exists("x", lambda v: v > boundary)
        value = value + F.when(above, F.lit(strength)).otherwise(F.lit(0.0))
    return df.withColumn(out, value)
