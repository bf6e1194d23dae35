"""Trajectories over steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact import running

BLOCK = 100_000


def best_so_far(df: DataFrame, keys: Sequence[str], block_size: int = BLOCK) -> DataFrame:
    """Running maximum of ``value`` by ``step``."""
    return running(df, keys, "step", {"best": ("max", "value")}, block_size)


def current_best(
    df: DataFrame, keys: Sequence[str], seed: str | None = None, block_size: int = BLOCK
) -> DataFrame:
    """Best value before each step; ``seed`` names a column with the initially revealed best."""
    out = running(df, keys, "step", {"current_best": ("max", "value")}, block_size, False)
    if seed:
        out = out.withColumn("current_best", F.greatest("current_best", seed))
    return out


def mean_trajectory(
    df: DataFrame, group: Sequence[str], run: Sequence[str], block_size: int = BLOCK
) -> DataFrame:
    """Mean best-so-far per step, each run held at its last value up to the longest run.

    The tails are not written out: the runs that ended before a step enter as a running sum of
    their last values and a running count. Steps run from 0 to the longest run of the group; a
    step nobody reports and no ended run covers has a null mean. A run reports a step once.
    """
    best = best_so_far(df, [*group, *run], block_size)
    seen = best.groupBy(*group, "step").agg(
        F.sum("best").alias("s"), F.count("best").alias("c"),
    )
    last = best.groupBy(*group, *run).agg(F.max("step").alias("last"), F.max("best").alias("best"))
    ended = last.groupBy(*group, (F.col("last") + 1).alias("step")).agg(
        F.sum("best").alias("es"), F.count(F.lit(1)).alias("ec")
    )
    longest = last.groupBy(*group).agg(F.max("last").alias("max_step"))
    steps = longest.select(*group, F.explode(F.sequence(F.lit(0), F.col("max_step"))).alias("step"))
    at = [*group, "step"]
    grid = steps.join(seen, at, "left").join(ended, at, "left")
    filled = running(
        grid, group, "step", {"tail_s": ("sum", "es"), "tail_c": ("sum", "ec")}, block_size
    )
    n = F.coalesce("c", F.lit(0)) + F.coalesce("tail_c", F.lit(0))
    s = F.coalesce("s", F.lit(0.0)) + F.coalesce("tail_s", F.lit(0.0))
    return filled.select(*at, F.when(n > 0, s / n).alias("mean_best"), n.alias("n_runs"))


def eval_schedule(campaigns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Evaluations used after each step: ``R`` at step 0, then batches of ``B`` up to ``S``."""
    left = F.col("S") - F.col("R")
    n_steps = F.ceil(left / F.col("B")).cast("int")
    steps = campaigns.select(
        *keys, "S", "R", "B", F.explode(F.sequence(F.lit(0), n_steps)).alias("step")
    )
    used = F.col("R") + F.least(F.col("step") * F.col("B"), left)
    before = F.col("R") + F.least((F.col("step") - 1) * F.col("B"), left)
    size = F.when(F.col("step") == 0, F.col("R")).otherwise(used - before)
    return steps.select(
        *keys, "step", size.cast("int").alias("batch_size"), used.cast("int").alias("evaluations")
    )


def cube_bars(facts: DataFrame, config: Sequence[str]) -> DataFrame:
    """Mean steps per optimizer for every dataset and, as dataset ``all``, across datasets."""
    base = [*config, "optimizer"]
    keys = [F.col(c) for c in (*base, "dataset")]
    grouped = facts.groupingSets([keys, keys[:-1]], *keys).agg(
        F.avg("mean_steps").alias("mean_steps"),
        F.grouping("dataset").alias("_all"),
    )
    name = F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("dataset"))
    return grouped.select(*base, name.alias("dataset"), "mean_steps")


def cube_lines(facts: DataFrame, config: Sequence[str], block_size: int = BLOCK) -> DataFrame:
    """Average curve across datasets; a dataset leaves the mean where its curve ends."""
    keys = [*config, "optimizer"]
    mean = facts.groupBy(*keys, "step").agg(F.avg("value").alias("value"))
    return best_so_far(mean, keys, block_size).select(*keys, "step", "best")


def available_optimizers(facts: DataFrame, config: dict) -> DataFrame:
    """Optimizers that have data for a configuration."""
    for c, v in config.items():
        facts = facts.where(F.col(c) == v)
    return facts.select("optimizer").distinct()


def has_data(facts: DataFrame, config: dict) -> bool:
    return not available_optimizers(facts, config).isEmpty()
