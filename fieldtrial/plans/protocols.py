"""The two protocols for many campaigns at once.

Hide-the-Label counts the steps until the best pool point is revealed. Open Race looks for the best
value within a fixed number of evaluations.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import clip
from ..operators import designs, generate, kernel_state, scoring, stats
from ..operators.campaign_models import campaign_posterior, campaign_scale, fit_campaigns, score_campaigns
from ..operators.curves import running
from ..operators.neighbours import drop_evaluated, first_occurrence, knn, match_design, top_up
from ..operators.prep import scale_pm1
from ..operators.selection import select_batch
from ..operators.surfaces import fit_surfaces, surface_values
from ..session import cut_lineage, join_small, scratch_path
from .rounds import Scorer, outcomes, run_rounds

# Size of a candidate table.
MIN_CANDIDATES = 1000
CANDIDATES_PER_DIM = 500
CANDIDATES_PER_PICK = 50

# Fixed values of the strategies: the factors of a grid and the runs of a hypercube or a fraction.
DESIGN_FACTORS, DESIGN_RUNS, FRACTION_RUNS = 10, 50, 2000

RANDOM_ORDERS = ("RANDOM", "DE_DIRECT")


def fixed_order(
    name: str, pool: DataFrame, keys: Sequence[str], d: int, seed: int | str
) -> DataFrame:
    """Visiting order of a strategy that does not look at revealed values.

    ``pool`` holds the hidden points, to which the design is scaled and matched.
    """
    if name in RANDOM_ORDERS:
        return designs.random_order(pool, keys, seed)
    limits = stats.bounds(pool, keys)
    factors = min(d, DESIGN_FACTORS)
    if name == "LATIN_HYPERCUBE":
        sizes = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
        sized = limits.join(sizes, list(keys))
        runs = designs.lhs_runs(sized, keys, F.col("rows"), d, seed, DESIGN_RUNS)
        matches = first_occurrence(knn(runs, pool, 1, keys, "run", "point_id"), keys)
    elif name == "PLACKETT_BURMAN":
        runs = designs.plackett_burman(limits, keys, d, seed)
        matches = match_design(runs, scale_pm1(pool, limits, keys), keys)
    elif name == "BOX_BEHNKEN":
        matches = match_design(designs.box_behnken(limits, keys, d), pool, keys)
    else:
        make = {
            "FULL_FACTORIAL": designs.full_factorial,
            "CENTRAL_COMPOSITE": designs.central_composite,
            "FRACTIONAL_FACTORIAL": lambda b, k, n: designs.fractional_factorial(
                b, k, n, seed=seed, max_runs=FRACTION_RUNS
            ),
        }[name]
        matches = match_design(make(limits, keys, factors), pool, keys, factors=factors)
    return designs.design_order(pool, matches, keys, seed)


def gp_ei(keys: Sequence[str], m: int = 50, length: float = 1.0) -> Scorer:
    """Scorer: expected improvement over the best posterior mean, one kernel model per campaign."""

    def score(hidden: DataFrame, observed: DataFrame) -> DataFrame:
        observed = cut_lineage(observed, "seen")
        model = fit_campaigns(observed, keys, m=m, length=length)
        seen = score_campaigns(model, observed, keys, length=length)
        best = scoring.denoised_best(seen, keys)
        asked = score_campaigns(model, hidden, keys, length=length)
        ei = scoring.expected_improvement(F.col("mean"), F.col("std"), F.col("best"))
        return join_small(asked, best, keys).withColumn("score", ei)

    return score


def gp_value(keys: Sequence[str], kappa: float = 1.0, m: int = 50, length: float = 1.0) -> Scorer:
    """Scorer: predicted value plus ``kappa`` deviations, one kernel model per campaign."""

    def score(hidden: DataFrame, observed: DataFrame) -> DataFrame:
        asked = campaign_posterior(observed, hidden, keys, m=m, length=length)
        return asked.withColumn("score", scoring.ucb(F.col("mean"), F.col("std"), kappa))

    return score


def d_optimal(keys: Sequence[str], order: int = 1) -> Scorer:
    """Scorer: gain in det(X'X) of a polynomial model."""
    return lambda hidden, observed: scoring.d_optimal(observed, hidden, keys, order=order)


def polynomial_value(keys: Sequence[str], order: int = 2) -> Scorer:
    """Scorer: the value that a least-squares surface of all terms up to ``order`` predicts."""

    def score(hidden: DataFrame, observed: DataFrame) -> DataFrame:
        surfaces = fit_surfaces(observed, keys, order)
        asked = surface_values(surfaces, hidden, keys, order)
        return asked.withColumn("score", scoring.predicted_value(F.col("mean")))

    return score


def noise_aware_ei(keys: Sequence[str], m: int = 50, length: float = 1.0, k: int = 10) -> Scorer:
    """Scorer: expected improvement under model and local noise.

    Each observation weighs by the noise of its neighbourhood, the best value is the largest
    posterior mean, and candidates get the noise of theirs; neighbours are those in the
    standardized features of a campaign.
    """

    def score(hidden: DataFrame, observed: DataFrame) -> DataFrame:
        scale = cut_lineage(campaign_scale(observed, keys).select(*keys, "x_mean", "x_std"), "scale")

        def standardized(rows: DataFrame) -> DataFrame:
            placed = join_small(rows, scale, keys, computed=True)
            return placed.withColumn("x", kernel_state.standard("x")).drop("x_mean", "x_std")

        seen = cut_lineage(standardized(observed), "seen")
        asked = cut_lineage(standardized(hidden), "asked")
        noise = scoring.observation_noise(seen, keys, k)
        model = cut_lineage(kernel_state.precision_state(seen, noise, keys, m=m, length=length), "model")
        best = (
            kernel_state.predicted(model, seen, keys, length=length)
            .groupBy(*keys)
            .agg(F.max(F.col("means")[0]).alias("best"))
        )
        queries = asked.withColumnRenamed("point_id", "query_id")
        local = scoring.local_noise(seen, queries, keys, k).withColumnRenamed("query_id", "point_id")
        rated = kernel_state.predicted(model, asked, keys, length=length).withColumns(
            {"mean": F.col("means")[0], "std": F.col("stds")[0]}
        )
        rated = join_small(rated.drop("means", "stds").join(local, [*keys, "point_id"]), best, keys)
        gain = scoring.noise_aware_ei(F.col("mean"), F.col("std"), F.col("noise_var"), F.col("best"))
        return rated.withColumn("score", gain)

    return score


def hide_the_label_order(
    pool: DataFrame,
    name: str,
    keys: Sequence[str],
    d: int,
    fraction: float,
    batch: int = 1,
    seed: int | str = 42,
) -> DataFrame:
    """Steps to target of a fixed-order strategy, without replaying its rounds."""
    split = cut_lineage(generate.hide_split(pool, keys, fraction, seed), "split")
    hidden = split.where("hidden")
    order = fixed_order(name, hidden.select(*keys, "point_id", "x", "y"), keys, d, seed)
    return designs.steps_from_order(order, generate.target_points(pool, keys), keys, batch)


def hide_the_label(
    pool: DataFrame,
    scorer: Scorer,
    keys: Sequence[str],
    fraction: float,
    batch: int = 1,
    cap: int | None = None,
    seed: int | str = 42,
) -> DataFrame:
    """Steps to target, success and final best of a scoring strategy per campaign."""
    pool = cut_lineage(pool, "pool")
    split = generate.hide_split(pool, keys, fraction, seed)
    history = run_rounds(pool, split.where("NOT hidden"), scorer, keys, batch, cap)
    return outcomes(history, pool, keys)


def open_race(
    limits: DataFrame,
    evaluate: Callable[[DataFrame], DataFrame],
    scorer: Scorer,
    keys: Sequence[str],
    d: int,
    budget: int = 200,
    initial: int = 10,
    batch: int = 1,
    seed: int | str = 42,
) -> DataFrame:
    """Best value so far per campaign and step.

    ``limits`` has the bounds of each campaign, ``evaluate`` adds ``y`` to rows with keys,
    ``point_id`` and ``x``. Each step draws a Latin-hypercube candidate table, drops evaluated
    points, scores the rest and evaluates the best ``batch``. Evaluations are written to the shared
    folder, one part per step.
    """
    spark = limits.sparkSession
    limits = cut_lineage(limits.select(*keys, "low", "high"), "limits")
    path = scratch_path(spark, "race")
    columns = [*keys, "point_id", "x", "y"]
    wanted = max(MIN_CANDIDATES, CANDIDATES_PER_DIM * d, CANDIDATES_PER_PICK * batch)
    base = generate.numbered(limits, F.lit(wanted), "point_id").select(*keys, "point_id")
    unit = generate.latin_hypercube(base, keys, "point_id", d, seed)
    # The candidate table has one seed, so it is made once.
    table = cut_lineage(generate.scale_points(unit, limits, keys), "candidates")
    first = generate.uniform_points(limits, keys, F.lit(initial), d, f"{seed}|initial")
    first = first.withColumn("point_id", -F.col("point_id") - 1)
    n_steps = -(-(budget - initial) // batch)
    schema = None
    for step in range(n_steps + 1):
        if step == 0:
            picked = first
        else:
            seen = spark.read.schema(schema).parquet(path)
            left = drop_evaluated(table, seen, limits, keys)
            left = top_up(left, seen, limits, keys, wanted // 2, d, f"{seed}|{step}")
            size = min(batch, budget - initial - (step - 1) * batch)
            picked = select_batch(scorer(left, seen.drop("step")), keys, size)
        inside = clip(F.col("x"), F.col("low"), F.col("high"))
        placed = join_small(picked.select(*keys, "point_id", "x"), limits, keys, computed=True)
        done = evaluate(placed.withColumn("x", inside).drop("low", "high")).select(*columns)
        schema = done.schema.add("step", "integer")
        done.write.mode("overwrite").parquet(f"{path}/step={step}")
    best = spark.read.schema(schema).parquet(path).groupBy(*keys, "step").agg(
        F.max("y").alias("value"), F.count(F.lit(1)).alias("n")
    )
    return running(
        best, keys, "step",
        {"best_value_so_far": ("max", "value"), "evaluations": ("sum", "n")},
    ).select(*keys, "step", "evaluations", "best_value_so_far")
