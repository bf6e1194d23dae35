"""Reproducible random numbers from md5, the same on every executor and in plain SQL."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 4294967296.0  # 2 ** 32


def _label(parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def hash_int(*parts, mod: int | None = None) -> Column:
    """First 32 bits of md5 over the ``|``-joined parts; Python values are literals."""
    value = F.conv(F.substring(F.md5(_label(parts)), 1, 8), 16, 10).cast("long")
    return value % F.lit(mod).cast("long") if mod else value


def hash_u(*parts) -> Column:
    """Uniform number in [0, 1)."""
    return hash_int(*parts) / F.lit(HASH_RANGE)


def hash_u_open(*parts) -> Column:
    """Uniform number in (0, 1), safe under a logarithm."""
    return (hash_int(*parts) + F.lit(0.5)) / F.lit(HASH_RANGE)


def hash_normal(*parts) -> Column:
    """Standard normal number by the Box-Muller transform."""
    radius = F.sqrt(F.lit(-2.0) * F.log(hash_u_open(*parts, "r")))
    return radius * F.cos(F.lit(2.0 * math.pi) * hash_u_open(*parts, "a"))


# The same numbers on the driver, for small parameter matrices.


def py_hash_int(*parts) -> int:
    return int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:8], 16)


def py_u_open(*parts) -> float:
    return (py_hash_int(*parts) + 0.5) / HASH_RANGE


def py_normal(*parts) -> float:
    radius = math.sqrt(-2.0 * math.log(py_u_open(*parts, "r")))
    return radius * math.cos(2.0 * math.pi * py_u_open(*parts, "a"))
