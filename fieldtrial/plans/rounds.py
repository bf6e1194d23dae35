"""Selection rounds in which every campaign advances in the same job."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.generate import target_points
from ..operators.selection import hidden_points, select_batch
from ..session import cut_lineage, join_small, scratch_path

# A scorer takes (hidden rows, observed rows) and returns the hidden rows with a ``score``.
Scorer = Callable[[DataFrame, DataFrame], DataFrame]


def al_round(
    pool: DataFrame,
    revealed: DataFrame,
    scorer: Scorer,
    keys: Sequence[str],
    batch: int,
    targets: DataFrame,
    point: str = "point_id",
) -> DataFrame:
    """Score the hidden rows of every open campaign and pick ``batch`` of them.

    A campaign is open until its target has been revealed. The result has keys, point, value,
    batch position, the best value before the round and the number of hidden rows.
    """
    at = [*keys, point]
    goal = targets.select(*keys, F.col("target_id").alias(point))
    finished = revealed.join(goal, at, "left_semi").select(*keys).distinct()
    open_pool = join_small(pool, finished, keys, "left_anti")
    observed = open_pool.join(revealed.select(*at), at, "left_semi")
    hidden = hidden_points(open_pool, revealed, keys, point)
    best = observed.groupBy(*keys).agg(F.max("y").alias("current_best"))
    left = hidden.groupBy(*keys).agg(F.count(F.lit(1)).alias("hidden_remaining"))
    picks = select_batch(scorer(hidden, observed), keys, batch, point)
    return (
        picks.join(best, list(keys), "left")
        .join(left, list(keys))
        .select(
            *keys, "batch_position", point, F.col("y").alias("value"), "current_best",
            "hidden_remaining",
        )
    )


def run_rounds(
    pool: DataFrame,
    revealed: DataFrame,
    scorer: Scorer,
    keys: Sequence[str],
    batch: int = 1,
    cap: int | None = None,
    point: str = "point_id",
) -> DataFrame:
    """Play rounds until every target is found, or ``cap`` rounds have passed if that is given.

    ``revealed`` holds the initially known points. The picks of a round are written to the shared
    folder, one part per step, so a plan never spans more than one round. The result is the
    evaluation history.
    """
    spark = pool.sparkSession
    at = [*keys, point]
    targets = cut_lineage(target_points(pool, keys, point), "targets")
    start = cut_lineage(revealed.select(*at), "revealed")
    path = scratch_path(spark, "rounds")
    schema = None
    for step in itertools.count() if cap is None else range(cap):
        known = start
        if step:
            done = spark.read.schema(schema).parquet(path)
            known = start.unionByName(done.select(*at))
        picks = al_round(pool, known, scorer, keys, batch, targets, point)
        schema = picks.schema.add("step", "integer")
        part = f"{path}/step={step}"
        picks.write.mode("overwrite").parquet(part)
        if spark.read.schema(picks.schema).parquet(part).isEmpty():
            break
    return spark.read.schema(schema).parquet(path)


def outcomes(history: DataFrame, pool: DataFrame, keys: Sequence[str], point: str = "point_id"):
    """Steps to target, success and final best per campaign."""
    targets = target_points(pool, keys, point)
    hit = F.col(point) == F.col("target_id")
    return (
        join_small(history, targets, keys)
        .groupBy(*keys)
        .agg(
            (F.max("step") + 1).alias("steps_to_target"),
            F.max(hit).alias("found_target"),
            F.greatest(F.max("value"), F.max("current_best")).alias("final_best"),
        )
    )
