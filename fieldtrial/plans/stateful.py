"""Selection rounds whose strategies remember: a state table per campaign is carried along.

A strategy has four steps, all on tables with one row or many per campaign:

* ``start(observed)`` makes the state from the first observations,
* ``advance(state, observed, fresh)`` takes the rows revealed since into it,
* ``score(state, hidden, observed)`` returns the hidden rows with a ``score``,
* ``settle(state, scored)`` is the state after the scores of the round are known.

State and picks of every round are written to the shared folder, so a plan spans one round and a lost
executor costs one.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_normal
from ..functions.vectors import total
from ..operators import kernel_state as ks
from ..operators import scoring
from ..operators.campaign_models import campaign_posterior, campaign_scale
from ..operators.generate import target_points
from ..operators.models import NOISE
from ..operators.selection import hidden_points, select_batch
from ..session import cut_lineage, join_small, scratch_path


class KernelImprovement:
    """Expected improvement over the best posterior mean, from one kernel regression per campaign.

    The sums of the regression take in each round's new rows only. Its weights are solved again when
    ``refit_every`` observations have come since they were, and in between the strategy works with the
    old ones. With ``replicas`` the mean and deviation are those of an ensemble of bagged regressions
    and the score has the bonus of a tenth of the deviation.
    """

    def __init__(
        self, keys: Sequence[str], m: int = 50, length: float = 1.0, noise: float = NOISE,
        refit_every: int = 10, replicas: int = 0, seed: int | str = 42, point: str = "point_id",
    ):
        self.keys, self.m, self.length, self.noise = list(keys), m, length, noise
        self.refit_every, self.replicas, self.seed, self.point = refit_every, replicas, seed, point

    def _sums(self, rows: DataFrame, basis: DataFrame) -> DataFrame:
        weights = ks.bag_weights(self.replicas, self.keys, self.point, self.seed)
        return ks.kernel_sums(rows, basis, self.keys, weights, self.point, self.length)

    def _predicted(self, state: DataFrame, rows: DataFrame) -> DataFrame:
        out = ks.predicted(state, rows, self.keys, self.point, self.noise, self.length)
        if self.replicas:
            mean, std = ks.ensemble(F.col("means"), F.col("stds"))
        else:
            mean, std = F.col("means")[0], F.col("stds")[0]
        return out.withColumns({"mean": mean, "std": std}).drop("means", "stds")

    def start(self, observed: DataFrame) -> DataFrame:
        basis = ks.kernel_basis(observed, self.keys, self.point, self.m, self.seed)
        state = ks.solved(ks.new_state(basis, self._sums(observed, basis), self.keys), 1, self.noise, self.length)
        state = cut_lineage(state, "fitted")
        return self._with_best(state, observed, state)

    def _with_best(self, state: DataFrame, rows: DataFrame, models: DataFrame) -> DataFrame:
        best = self._predicted(models, rows).groupBy(*self.keys).agg(F.max("mean").alias("best"))
        return state.join(best, self.keys, "left")

    def advance(self, state: DataFrame, observed: DataFrame, fresh: DataFrame) -> DataFrame:
        """Rows that came count in the sums; where the weights are solved again the best mean is too."""
        more = self._sums(fresh, state)
        grown = ks.added(state.drop("refitted"), more, self.keys)
        grown = cut_lineage(ks.solved(grown, self.refit_every, self.noise, self.length), "fitted")
        kept = grown.where("NOT refitted").withColumnRenamed("best", "_old")
        kept = self._with_best(kept, fresh, kept)
        kept = kept.withColumn("best", F.greatest("_old", F.coalesce("best", "_old"))).drop("_old")
        again = grown.where("refitted").drop("best")
        again = self._with_best(again, join_small(observed, again.select(*self.keys), self.keys), again)
        return kept.unionByName(again)

    def score(self, state: DataFrame, hidden: DataFrame, observed: DataFrame) -> DataFrame:
        asked = self._predicted(state, hidden)
        asked = join_small(asked, state.select(*self.keys, "best"), self.keys)
        gain = scoring.ei_bonus if self.replicas else scoring.expected_improvement
        return asked.withColumn("score", gain(F.col("mean"), F.col("std"), F.col("best")))

    def settle(self, state: DataFrame, scored: DataFrame) -> DataFrame:
        return state


class AdaptiveSubspace:
    """Search in a random subspace, inside a trust region around the best observation.

    The state has the feature scale and label shift of the first observations, the sums from which
    feature relevance follows, the relevance (renewed in the first three rounds and then in every
    fifth), the projection (drawn at first and in every tenth round, its rows weighted by relevance)
    and the radius, which grows and shrinks with the scores and widens where it holds no candidate.
    ``fit`` is a function (observed, candidates) -> candidates with ``mean`` and ``std``.
    """

    def __init__(self, keys: Sequence[str], m: int = 50, length: float = 1.0, radius: float = 0.3,
                 seed: int | str = 42, fit=None, point: str = "point_id"):
        self.keys, self.radius, self.seed, self.point = list(keys), radius, seed, point
        self.fit = fit or (lambda seen, asked: campaign_posterior(seen, asked, self.keys, m=m, length=length))

    def _moments(self, rows: DataFrame, frame: DataFrame) -> DataFrame:
        """Sums of scaled features and shifted labels, per campaign."""
        placed = join_small(rows.select(*self.keys, "x", "y"), frame.select(*self.keys, "x_mean", "x_std", "y_shift"), self.keys)
        label = F.col("y") - F.col("y_shift")
        flat = placed.select(*self.keys, label.alias("y"), F.posexplode(ks.standard("x")).alias("dim", "v"))
        dims = flat.groupBy(*self.keys, "dim").agg(
            F.sum("v").alias("sx"), F.sum(F.col("v") * F.col("v")).alias("sxx"), F.sum(F.col("v") * F.col("y")).alias("sxy"),
            F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"),
        )
        each = F.struct("dim", "sx", "sxx", "sxy", "n", "sy", "syy")
        wide = dims.groupBy(*self.keys).agg(F.array_sort(F.collect_list(each)).alias("_a"))
        return wide.select(*self.keys, F.transform("_a", lambda a: F.array(*[a[c] for c in ("sx", "sxx", "sxy", "n", "sy", "syy")])).alias("moments"))

    def _relevance(self):
        """0.7 |correlation| + 0.3 variance / largest variance, from the sums of each dimension."""

        def measures(a):
            sx, sxx, sxy, n, sy, syy = (a[i] for i in range(6))
            var = F.greatest(sxx / n - (sx / n) * (sx / n), F.lit(0.0))
            spread = F.sqrt(var * F.greatest(syy / n - (sy / n) * (sy / n), F.lit(0.0)))
            corr = F.when(spread > 0, F.abs((sxy / n - (sx / n) * (sy / n)) / spread)).otherwise(F.lit(0.0))
            return F.struct(corr.alias("corr"), var.alias("var"))

        each = F.transform("moments", measures)
        top = F.array_max(F.transform(each, lambda e: e["var"]))
        return F.transform(each, lambda e: F.lit(0.7) * e["corr"] + F.lit(0.3) * e["var"] / (top + F.lit(1e-6)))

    def _projection(self):
        parts = [F.col(k) for k in self.keys]
        share = F.transform("relevance", lambda r: r / total(F.col("relevance")))

        def row(s, i):
            draw = lambda j: hash_normal(str(self.seed), "project", *parts, F.col("iteration"), i, j)
            return F.transform(F.sequence(F.lit(0), F.col("dims") - 1), lambda j: draw(j) * F.sqrt(s + 0.1))

        return F.transform(share, row)

    def _unit_columns(self, rows):
        norms = F.transform(
            F.sequence(F.lit(0), F.col("dims") - 1),
            lambda j: F.sqrt(total(F.transform(rows, lambda r: F.get(r, j) * F.get(r, j)))),
        )
        return F.transform(rows, lambda r: F.zip_with(r, norms, lambda v, n: v / F.when(n > 0, n).otherwise(1.0)))

    def _renewed(self, state: DataFrame) -> DataFrame:
        """The state at the start of its next round."""
        state = state.withColumn("iteration", F.col("iteration") + 1)
        relevant = (F.col("iteration") <= 3) | (F.col("iteration") % 5 == 0)
        state = state.withColumn("relevance", F.when(relevant, self._relevance()).otherwise(F.col("relevance")))
        again = F.col("projection").isNull() | (F.col("iteration") % 10 == 0)
        state = state.withColumn("_p", F.when(again, self._projection()))
        fresh = self._unit_columns(F.col("_p"))
        return state.withColumn("projection", F.when(again, fresh).otherwise(F.col("projection"))).drop("_p")

    def start(self, observed: DataFrame) -> DataFrame:
        scale = campaign_scale(observed, self.keys)
        frame = cut_lineage(scale.select(*self.keys, "x_mean", "x_std", F.col("y_mean").alias("y_shift")), "frame")
        state = frame.join(self._moments(observed, frame), self.keys)
        n, width = F.col("moments")[0][3], F.size("moments")
        dims = F.greatest(F.least(F.greatest(F.floor(n / 3), F.lit(3)), F.floor(width / 2), F.lit(8)), F.lit(1))
        return self._renewed(
            state.select(
                *self.keys, "x_mean", "x_std", "y_shift", "moments", dims.cast("int").alias("dims"),
                F.lit(0).alias("iteration"), F.lit(None).cast("array<double>").alias("relevance"),
                F.lit(None).cast("array<array<double>>").alias("projection"), F.lit(float(self.radius)).alias("radius"),
            )
        )

    def advance(self, state: DataFrame, observed: DataFrame, fresh: DataFrame) -> DataFrame:
        more = self._moments(fresh, state).withColumnRenamed("moments", "_more")
        grown = state.join(more, self.keys, "left")
        both = F.zip_with("moments", "_more", lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
        return self._renewed(grown.withColumn("moments", F.coalesce(both, "moments")).drop("_more"))

    def _embedded(self, rows: DataFrame, state: DataFrame) -> DataFrame:
        side = state.select(*self.keys, "x_mean", "x_std", "projection", "dims")
        placed = join_small(rows, side, self.keys).withColumn("_s", ks.standard("x"))
        at = F.transform(
            F.sequence(F.lit(0), F.col("dims") - 1),
            lambda j: total(F.zip_with("_s", "projection", lambda v, r: v * F.get(r, j))),
        )
        return placed.withColumn("x", at).drop("_s", "x_mean", "x_std", "projection", "dims")

    def score(self, state: DataFrame, hidden: DataFrame, observed: DataFrame) -> DataFrame:
        seen = cut_lineage(self._embedded(observed, state), "seen")
        near = scoring.trust_region(self._embedded(hidden, state), seen, state.select(*self.keys, "radius"), self.keys)
        near = cut_lineage(near.drop("radius", "distance"), "near")
        best = seen.groupBy(*self.keys).agg(F.max("y").alias("best"))
        asked = join_small(self.fit(seen, near), best, self.keys)
        return asked.withColumn("score", scoring.ei_bonus(F.col("mean"), F.col("std"), F.col("best")))

    def settle(self, state: DataFrame, scored: DataFrame) -> DataFrame:
        level = scored.groupBy(*self.keys).agg(F.max("level").alias("_level"))
        wide = state.join(level, self.keys, "left").withColumn(
            "radius", F.when(F.col("_level") != 1.0, F.col("radius") * 1.5).otherwise(F.col("radius"))
        )
        radius = scoring.next_radius(scored, wide.select(*self.keys, "radius"), self.keys)
        settled = wide.drop("_level").withColumnRenamed("radius", "_old").join(radius, self.keys, "left")
        return settled.withColumn("radius", F.coalesce("radius", "_old")).drop("_old")


def play(
    pool: DataFrame,
    revealed: DataFrame,
    strategy,
    keys: Sequence[str],
    batch: int = 1,
    cap: int | DataFrame | None = None,
    point: str = "point_id",
) -> tuple[DataFrame, DataFrame]:
    """Rounds of a strategy with state: the history of picks, and the state after every round.

    ``pool`` has keys, point, x and y; ``revealed`` the points known at first. A campaign plays until
    its best point is revealed, its points are used up or its cap is reached: ``cap`` is a number of
    rounds for all, or a table of keys and ``cap`` (none for a campaign that is not in it).
    """
    spark, at = pool.sparkSession, [*keys, point]
    pool = cut_lineage(pool.select(*at, "x", "y"), "pool")
    goal = cut_lineage(target_points(pool, keys, point).select(*keys, F.col("target_id").alias(point)), "targets")
    limits = cut_lineage(cap.select(*keys, "cap"), "caps") if isinstance(cap, DataFrame) else None
    known = cut_lineage(revealed.select(*at), "revealed")
    picks_path, state_path = scratch_path(spark, "picks"), scratch_path(spark, "states")
    state = fresh = None
    schemas: dict[str, object] = {}
    for step in itertools.count() if cap is None or limits is not None else range(cap):
        shown = known
        if step:
            shown = known.unionByName(spark.read.schema(schemas["picks"]).parquet(picks_path).select(*at))
        over = goal.join(shown, at, "left_semi").select(*keys)
        if limits is not None:
            over = over.unionByName(limits.where(F.col("cap") <= step).select(*keys))
        open_pool = join_small(pool, over.distinct(), keys, "left_anti")
        observed = cut_lineage(open_pool.join(shown, at, "left_semi"), "observed")
        hidden = hidden_points(open_pool, shown, keys, point)
        if step == 0:
            state = cut_lineage(strategy.start(observed), "state")
        else:
            still = state.join(observed.select(*keys).distinct(), list(keys), "left_semi")
            state = cut_lineage(strategy.advance(still, observed, observed.join(fresh, at, "left_semi")), "state")
        scored = cut_lineage(strategy.score(state, hidden, observed), "scored")
        picks = select_batch(scored, keys, batch, point).select(*at, "batch_position", F.col("y").alias("value"), "score")
        part = f"{picks_path}/step={step}"
        picks.write.mode("overwrite").parquet(part)
        fresh = spark.read.schema(picks.schema).parquet(part).select(*at)
        schemas["picks"] = picks.schema.add("step", "integer")
        state = strategy.settle(state, scored)
        part = f"{state_path}/step={step}"
        state.write.mode("overwrite").parquet(part)
        state = spark.read.schema(state.schema).parquet(part)
        schemas["states"] = state.schema.add("step", "integer")
        if fresh.isEmpty():
            break
    if not schemas:
        raise ValueError("cap must be at least 1")
    return (
        spark.read.schema(schemas["picks"]).parquet(picks_path),
        spark.read.schema(schemas["states"]).parquet(state_path),
    )
