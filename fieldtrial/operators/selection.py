"""Choosing, checking and revealing batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import hash_int
from .generate import key_cols


def hidden_points(
    pool: DataFrame, revealed: DataFrame, keys: Sequence[str], point: str = "point_id"
) -> DataFrame:
    """Pool points that have not been revealed."""
    return pool.join(revealed.select(*keys, point), [*keys, point], "left_anti")


def select_batch(
    scored: DataFrame, keys: Sequence[str], batch: int, point: str = "point_id"
) -> DataFrame:
    """The ``batch`` best scores per campaign, the smallest id on ties.

    Only rows among the ``batch`` best of their part of a campaign reach the final sort.
    """
    order = [F.col("score").desc_nulls_last(), F.col(point)]
    w = W.partitionBy(*keys).orderBy(*order)
    scored = _best_of_parts(scored, keys, order, batch, point)
    return scored.withColumn("batch_position", F.row_number().over(w)).where(
        F.col("batch_position") <= batch
    )


# Spark itself keeps the best rows of a task before the shuffle up to this batch.
GROUP_LIMIT = 1000
PARTS = 64


def _best_of_parts(
    df: DataFrame, keys: Sequence[str], order: Sequence, batch: int, point: str
) -> DataFrame:
    """Rows among the ``batch`` first of their part; parts are dealt by a hash of the point."""
    if batch <= GROUP_LIMIT:
        return df
    part = F.pmod(F.xxhash64(point), F.lit(PARTS)).alias("_part")
    w = W.partitionBy(*keys, "_part").orderBy(*order)
    ranked = df.select("*", part).withColumn("_in", F.row_number().over(w))
    return ranked.where(F.col("_in") <= batch).drop("_part", "_in")


def sanitize_batch(
    proposals: DataFrame,
    hidden: DataFrame,
    keys: Sequence[str],
    batch: int,
    seed: int | str,
    point: str = "point_id",
) -> DataFrame:
    """Distinct hidden proposals in order, topped up with random hidden points to ``batch``."""
    at = [*keys, point]
    kept = (
        proposals.groupBy(*at)
        .agg(F.min("position").alias("_o"))
        .join(hidden.select(*at), at, "left_semi")
        .withColumn("_tier", F.lit(0))
    )
    who = hash_int(str(seed), *key_cols(keys), F.col(point))
    rest = (
        hidden.select(*at)
        .join(kept, at, "left_anti")
        .select(*at, who.cast("bigint").alias("_o"), F.lit(1).alias("_tier"))
    )
    w = W.partitionBy(*keys).orderBy("_tier", "_o", point)
    both = kept.select(*at, F.col("_o").cast("bigint").alias("_o"), "_tier").unionByName(rest)
    both = _best_of_parts(both, keys, [F.col(c) for c in ("_tier", "_o", point)], batch, point)
    return (
        both.withColumn("batch_position", F.row_number().over(w))
        .where(F.col("batch_position") <= batch)
        .select(*at, "batch_position", (F.col("_tier") == 1).alias("is_fill"))
    )
