"""Rounds that carry state, ensembles, noise-aware choice and response surfaces.

The models of these queries have one inducing point, for which a fit is a quotient of sums; the
rounds are unrolled in the SQL. Surfaces are solved there by Gauss-Jordan steps.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from fieldtrial.operators import generate, kernel_state, models, scoring, stats
from fieldtrial.operators.campaign_models import campaign_posterior
from fieldtrial.operators.selection import select_batch
from fieldtrial.operators.surfaces import fit_surfaces, surface_values
from fieldtrial.plans import protocols, stateful

from .generation_queries import split_sql
from .inputs import POOL, pool, rounded
from .registry import query, s_cdf, s_hash, s_normal, s_pdf, s_u, table

C = ["campaign"]
KMM = "(1 + 1e-6::DOUBLE)"
NOISE = "0.1::DOUBLE"


def _or_one(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} ELSE 1.0::DOUBLE END"


def _ei_sql(mean: str, std: str, best: str, bonus: str = "0", floor: bool = True) -> str:
    z = f"(({mean} - {best}) / greatest({std}, 1e-6::DOUBLE))"
    value = f"(({mean} - {best}) * {s_cdf(z)} + greatest({std}, 1e-6::DOUBLE) * {s_pdf(z)} + {bonus})"
    return f"greatest({value}, 0.0::DOUBLE)" if floor else value


def _basis_sql(seen: str, points: str = "pool") -> str:
    """``basis`` (one inducing point and the feature scale) and ``kp``, every point's kernel value."""
    inducing = s_hash("'42'", "'inducing'", "campaign", "point_id")
    return f"""scale AS (SELECT campaign, avg(x1) AS m1, {_or_one("stddev_pop(x1)")} AS s1, avg(x2) AS m2,
      {_or_one("stddev_pop(x2)")} AS s2 FROM {seen} GROUP BY 1),
    drawn AS (SELECT campaign, x1 AS z1, x2 AS z2 FROM {seen}
      QUALIFY row_number() OVER (PARTITION BY campaign ORDER BY {inducing}, point_id) = 1),
    kp AS (SELECT p.campaign, point_id, y, x1, x2, exp(-0.5::DOUBLE * (power((x1 - z1) / s1, 2)
      + power((x2 - z2) / s2, 2))) AS k FROM {points} p JOIN scale USING (campaign) JOIN drawn USING (campaign))"""


def _fit_sql(rows: str, w: str = "1.0::DOUBLE", by: str = "campaign") -> str:
    """Weight, label mean and deviation per campaign of rows with k and y."""
    return f"""(SELECT {by}, n, my, sy, ((sky - my * sk) / sy) / (skk + {NOISE} * {KMM}) AS w FROM (
      SELECT *, CASE WHEN sqrt(greatest(syy / n - my * my, 0)) > 1e-12::DOUBLE * (1 + abs(my))
        THEN sqrt(greatest(syy / n - my * my, 0)) ELSE 1.0::DOUBLE END AS sy FROM (
        SELECT {by}, sum({w}) AS n, sum({w} * y) / sum({w}) AS my, sum({w} * y * y) AS syy,
          sum({w} * k) AS sk, sum({w} * k * y) AS sky, sum({w} * k * k) AS skk FROM {rows} GROUP BY {by})))"""


STD = f"sqrt(greatest(1 - k * k / {KMM} + {NOISE}, 1e-6::DOUBLE)) * sy"


class _RoundedImprovement(stateful.KernelImprovement):
    """Scores at 6 decimals, so that ties are ties in SQL too."""

    def score(self, state, hidden, observed):
        return super().score(state, hidden, observed).withColumn("score", F.round("score", 6))


class _RoundedSubspace(stateful.AdaptiveSubspace):
    def score(self, state, hidden, observed):
        return super().score(state, hidden, observed).withColumn("score", F.round("score", 6))


def _refit_sql(rounds: int, batch: int, every: int) -> str:
    parts = []
    for i in range(rounds):
        if i == 0:
            parts.append("seen0 AS (SELECT campaign, point_id FROM split WHERE NOT hidden)")
        else:
            parts.append(
                f"seen{i} AS (SELECT * FROM seen{i - 1} UNION ALL SELECT campaign, point_id FROM picks{i - 1})"
            )
        parts.append(f"""open{i} AS (SELECT kp.* FROM kp WHERE campaign NOT IN
      (SELECT campaign FROM split JOIN seen{i} USING (campaign, point_id) WHERE is_target)),
    obs{i} AS (SELECT o.* FROM open{i} o JOIN seen{i} USING (campaign, point_id)),
    all{i} AS {_fit_sql(f"obs{i}")}""")
        if i == 0:
            parts.append("fit0 AS (SELECT *, n AS n_fit FROM all0)")
        else:
            old, new = f"fit{i - 1}", f"all{i}"
            due = f"{new}.n - {old}.n_fit >= {every}"
            cells = ", ".join(f"CASE WHEN {due} THEN {new}.{c} ELSE {old}.{c} END AS {c}" for c in ("my", "sy", "w"))
            parts.append(f"""fit{i} AS (SELECT campaign, {cells},
      CASE WHEN {due} THEN {new}.n ELSE {old}.n_fit END AS n_fit FROM {new} JOIN {old} USING (campaign))""")
        parts.append(f"""best{i} AS (SELECT campaign, max(k * w * sy + my) AS best FROM obs{i} JOIN fit{i} USING (campaign)
      GROUP BY 1),
    post{i} AS (SELECT o.campaign, point_id, y, k * w * sy + my AS mean, {STD} AS std, best FROM open{i} o
      JOIN fit{i} USING (campaign) JOIN best{i} USING (campaign)
      WHERE (o.campaign, point_id) NOT IN (SELECT campaign, point_id FROM seen{i})),
    picks{i} AS (SELECT campaign, point_id, score, row_number() OVER (PARTITION BY campaign ORDER BY score DESC, point_id)
      AS batch_position FROM (SELECT *, round({_ei_sql("mean", "std", "best")}, 6) AS score FROM post{i})
      QUALIFY batch_position <= {batch})""")
    union = " UNION ALL ".join(
        f"""SELECT campaign, point_id, CAST({i} AS INTEGER) AS step, CAST(batch_position AS INTEGER) AS batch_position,
    score, CAST(n_fit AS BIGINT) AS n_fit FROM picks{i} JOIN fit{i} USING (campaign)"""
        for i in range(rounds)
    )
    first = "(SELECT p.* FROM split p WHERE NOT hidden)"
    return f"WITH {POOL}, {split_sql('0.9', '5')}, {_basis_sql(first)}, {', '.join(parts)} {union}"


@query("m23_refit_rounds", _refit_sql(3, 6, 10))
def refit_rounds(spark, sf):
    """Three rounds of every brand; the weights are solved again after ten observations."""
    p = pool(spark, sf)
    split = generate.hide_split(p, C, 0.9, 5)
    strategy = _RoundedImprovement(C, m=1, refit_every=10)
    picks, states = stateful.play(p, split.where("NOT hidden"), strategy, C, 6, 3)
    fitted = states.select("campaign", "step", F.col("n_fit").cast("long").alias("n_fit"))
    out = picks.join(fitted, ["campaign", "step"])
    return out.select("campaign", "point_id", "step", "batch_position", "score", "n_fit")


def _subspace_sql(rounds: int, batch: int) -> str:
    draw = lambda i: s_normal("'42'", "'project'", "campaign", "'1'", f"'{i}'", "'0'")
    inducing = s_hash("'42'", "'inducing'", "campaign", "point_id")
    parts = [
        "seen0 AS (SELECT campaign, point_id FROM split WHERE NOT hidden)",
        f"""frame AS (SELECT campaign, avg(x1) AS m1, {_or_one("stddev_pop(x1)")} AS s1, avg(x2) AS m2,
      {_or_one("stddev_pop(x2)")} AS s2 FROM split WHERE NOT hidden GROUP BY 1),
    moment AS (SELECT campaign, coalesce(abs(covar_pop(u1, y) / nullif(stddev_pop(u1) * stddev_pop(y), 0)), 0) AS c1,
      coalesce(abs(covar_pop(u2, y) / nullif(stddev_pop(u2) * stddev_pop(y), 0)), 0) AS c2, var_pop(u1) AS v1,
      var_pop(u2) AS v2 FROM (SELECT campaign, y, (x1 - m1) / s1 AS u1, (x2 - m2) / s2 AS u2
        FROM split JOIN frame USING (campaign) WHERE NOT hidden) GROUP BY 1),
    relevant AS (SELECT campaign, 0.7::DOUBLE * c1 + 0.3::DOUBLE * v1 / (greatest(v1, v2) + 1e-6::DOUBLE) AS r1,
      0.7::DOUBLE * c2 + 0.3::DOUBLE * v2 / (greatest(v1, v2) + 1e-6::DOUBLE) AS r2 FROM moment),
    raw AS (SELECT campaign, {draw(0)} * sqrt(r1 / (r1 + r2) + 0.1::DOUBLE) AS p1,
      {draw(1)} * sqrt(r2 / (r1 + r2) + 0.1::DOUBLE) AS p2 FROM relevant),
    placed AS (SELECT s.campaign, point_id, y, is_target, ((x1 - m1) / s1 * p1 + (x2 - m2) / s2 * p2)
      / sqrt(p1 * p1 + p2 * p2) AS e FROM split s JOIN frame USING (campaign) JOIN raw USING (campaign))""",
        "radius0 AS (SELECT campaign, 0.3::DOUBLE AS radius FROM frame)",
    ]
    for i in range(rounds):
        if i:
            parts.append(
                f"seen{i} AS (SELECT * FROM seen{i - 1} UNION ALL SELECT campaign, point_id FROM picks{i - 1})"
            )
        parts.append(f"""open{i} AS (SELECT * FROM placed WHERE campaign NOT IN
      (SELECT campaign FROM placed JOIN seen{i} USING (campaign, point_id) WHERE is_target)),
    obs{i} AS (SELECT o.* FROM open{i} o JOIN seen{i} USING (campaign, point_id)),
    centre{i} AS (SELECT campaign, e AS c, y AS best FROM obs{i}
      QUALIFY row_number() OVER (PARTITION BY campaign ORDER BY y DESC, point_id) = 1),
    dist{i} AS (SELECT o.*, abs(e - c) AS distance, radius, best FROM open{i} o JOIN centre{i} USING (campaign)
      JOIN radius{i} USING (campaign) WHERE (o.campaign, point_id) NOT IN (SELECT campaign, point_id FROM seen{i})),
    level{i} AS (SELECT campaign, CASE WHEN min(distance) <= any_value(radius) THEN 1.0::DOUBLE
      WHEN min(distance) <= any_value(radius) * 1.5::DOUBLE THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END AS level
      FROM dist{i} GROUP BY 1),
    near{i} AS (SELECT * FROM dist{i} JOIN level{i} USING (campaign) WHERE level = 0 OR distance <= radius * level),
    scale{i} AS (SELECT campaign, avg(e) AS me, {_or_one("stddev_pop(e)")} AS se, avg(y) AS my,
      {_or_one("stddev_pop(y)")} AS sy FROM obs{i} GROUP BY 1),
    drawn{i} AS (SELECT campaign, e AS z FROM obs{i}
      QUALIFY row_number() OVER (PARTITION BY campaign ORDER BY {inducing}, point_id) = 1),
    model{i} AS (SELECT campaign, any_value(z) AS z, any_value(se) AS se, any_value(my) AS my, any_value(sy) AS sy,
      sum(k * u) / (sum(k * k) + {NOISE} * {KMM}) AS w FROM (SELECT campaign, z, se, my, sy, (y - my) / sy AS u,
        exp(-0.5::DOUBLE * power((e - z) / se, 2)) AS k FROM obs{i} JOIN scale{i} USING (campaign)
        JOIN drawn{i} USING (campaign)) GROUP BY 1),
    post{i} AS (SELECT campaign, point_id, best, level, k * w * sy + my AS mean, {STD} AS std FROM (
      SELECT n.*, exp(-0.5::DOUBLE * power((e - z) / se, 2)) AS k, w, my, sy FROM near{i} n
      JOIN model{i} USING (campaign))),
    scored{i} AS (SELECT *, round({_ei_sql("mean", "std", "best", "0.1::DOUBLE * greatest(std, 1e-6::DOUBLE)", False)}, 6)
      AS score FROM post{i}),
    picks{i} AS (SELECT campaign, point_id, score, row_number() OVER (PARTITION BY campaign ORDER BY score DESC, point_id)
      AS batch_position FROM scored{i} QUALIFY batch_position <= {batch}),
    radius{i + 1} AS (SELECT campaign, least(greatest(any_value(radius) * CASE WHEN any_value(level) <> 1 THEN 1.5::DOUBLE
      ELSE 1.0::DOUBLE END * CASE WHEN max(score) - avg(score) > stddev_pop(score) * (1 + 1e-9::DOUBLE) THEN 0.9::DOUBLE ELSE 1.1::DOUBLE END,
      0.1::DOUBLE), 1.0::DOUBLE) AS radius FROM scored{i} JOIN radius{i} USING (campaign) GROUP BY 1)""")
    union = " UNION ALL ".join(
        f"""SELECT campaign, point_id, CAST({i} AS INTEGER) AS step, CAST(batch_position AS INTEGER) AS batch_position,
    score, round(radius, 6) AS radius FROM picks{i} JOIN radius{i + 1} USING (campaign)"""
        for i in range(rounds)
    )
    return f"WITH {POOL}, {split_sql('0.9', '5')}, {', '.join(parts)} {union}"


@query("m23_subspace_rounds", _subspace_sql(2, 4))
def subspace_rounds(spark, sf):
    """Two rounds in a random subspace with a trust region, for every brand."""
    p = pool(spark, sf)
    split = generate.hide_split(p, C, 0.9, 5)
    picks, states = stateful.play(p, split.where("NOT hidden"), _RoundedSubspace(C, m=1), C, 4, 2)
    out = picks.join(states.select("campaign", "step", F.round("radius", 6).alias("radius")), ["campaign", "step"])
    return out.select("campaign", "point_id", "step", "batch_position", "score", "radius")


BAGS = 4


def _ensemble_sql() -> str:
    draw, passed = s_u("'42'", "'bag'", "r", "campaign", "point_id"), []
    term, below = math.exp(-1), 0.0
    for k in range(kernel_state.MOST_COPIES):
        below += term
        term /= k + 1
        passed.append(f"CAST({draw} >= {below!r}::DOUBLE AS INTEGER)")
    first = "(SELECT p.* FROM split p WHERE NOT hidden)"
    return f"""WITH {POOL}, {split_sql("0.9", "5")}, {_basis_sql(first)},
    obs AS (SELECT kp.* FROM kp JOIN split USING (campaign, point_id) WHERE NOT hidden),
    bag AS (SELECT *, CAST({" + ".join(passed)} AS DOUBLE) AS c
      FROM obs, (SELECT unnest(range(1, {BAGS + 1})) AS r)),
    filled AS (SELECT *, CASE WHEN sum(c) OVER (PARTITION BY campaign, r) > 0 THEN c ELSE 1.0::DOUBLE END AS cw
      FROM bag),
    fits AS {_fit_sql("filled", "cw", "campaign, r")},
    each AS (SELECT campaign, point_id, hidden, k * w * sy + my AS mean, {STD} AS std
      FROM kp JOIN fits USING (campaign) JOIN split USING (campaign, point_id)),
    joined AS (SELECT campaign, point_id, any_value(hidden) AS hidden, avg(mean) AS mean,
      sqrt(var_pop(mean) + avg(std * std)) AS std FROM each GROUP BY 1, 2),
    top AS (SELECT campaign, max(mean) AS best FROM joined WHERE NOT hidden GROUP BY 1)
    SELECT campaign, point_id, round(mean, 6) AS mean, round(std, 6) AS std,
      round({_ei_sql("mean", "std", "best", "0.1::DOUBLE * greatest(std, 1e-6::DOUBLE)", False)}, 6) AS score
    FROM joined JOIN top USING (campaign) WHERE hidden"""


@query("m12_ensemble_ei", _ensemble_sql())
def ensemble_ei(spark, sf):
    """Mean, spread and improvement with bonus of four bagged regressions per brand."""
    split = generate.hide_split(pool(spark, sf), C, 0.9, 5)
    observed, hidden = split.where("NOT hidden"), split.where("hidden")
    strategy = stateful.KernelImprovement(C, m=1, replicas=BAGS)
    scored = strategy.score(strategy.start(observed), hidden, observed)
    return rounded(scored.select("campaign", "point_id", "mean", "std", "score"))


_NOISY = f"""WITH {POOL}, {split_sql("0.9", "5")},
    sc AS (SELECT campaign, avg(x1) AS m1, {_or_one("stddev_pop(x1)")} AS s1, avg(x2) AS m2,
      {_or_one("stddev_pop(x2)")} AS s2 FROM split WHERE NOT hidden GROUP BY 1),
    u AS (SELECT campaign, point_id, y, hidden, (x1 - m1) / s1 AS x1, (x2 - m2) / s2 AS x2
      FROM split JOIN sc USING (campaign)),
    seen AS (SELECT * FROM u WHERE NOT hidden),
    med AS (SELECT campaign, median(y) AS med, count(*) AS n, var_pop(y) AS v FROM seen GROUP BY 1),
    sig AS (SELECT campaign, 1.4826::DOUBLE * median(abs(y - med)) + 1e-9::DOUBLE AS sigma, any_value(n) AS n,
      any_value(v) AS v FROM seen JOIN med USING (campaign) GROUP BY 1),
    near AS (SELECT a.campaign, a.point_id, a.hidden, b.y, row_number() OVER (PARTITION BY a.campaign, a.point_id ORDER BY
      sqrt(power(a.x1 - b.x1, 2) + power(a.x2 - b.x2, 2)), b.point_id) AS nn FROM u a JOIN seen b ON a.campaign = b.campaign),
    noise AS (SELECT campaign, point_id, greatest(var_pop(y), 0.1::DOUBLE * any_value(sigma) * any_value(sigma))
      + 1e-9::DOUBLE AS noise_var FROM near JOIN sig USING (campaign)
      WHERE nn <= CASE WHEN hidden THEN 10 ELSE least(10, greatest(n - 1, 1)) END GROUP BY 1, 2),
    {_basis_sql("seen", "u")},
    obs AS (SELECT kp.*, {NOISE} / ({NOISE} + noise_var / {_or_one("v")}) AS cw FROM kp
      JOIN seen USING (campaign, point_id) JOIN noise USING (campaign, point_id) JOIN sig USING (campaign)),
    fit AS {_fit_sql("(SELECT campaign, k, y, cw FROM obs)", "cw")},
    best AS (SELECT campaign, max(k * w * sy + my) AS best FROM obs JOIN fit USING (campaign) GROUP BY 1),
    post AS (SELECT kp.campaign, kp.point_id, k * w * sy + my AS mean, {STD} AS std, noise_var, best FROM kp
      JOIN u USING (campaign, point_id) JOIN fit USING (campaign) JOIN best USING (campaign)
      JOIN noise USING (campaign, point_id) WHERE hidden),
    joined AS (SELECT *, sqrt(std * std + noise_var) AS se FROM post)
    SELECT campaign, point_id, round(mean, 5) AS mean, round(std, 5) AS std, round(noise_var, 5) AS noise_var,
      round((mean - best) * {s_cdf("((mean - best) / se)")} + se * {s_pdf("((mean - best) / se)")}
        + 0.01::DOUBLE * std, 5) AS score FROM joined"""


@query("m14_noise_aware_scores", _NOISY)
def noise_aware(spark, sf):
    """Improvement under model and local noise for the hidden points of every brand."""
    split = generate.hide_split(pool(spark, sf), C, 0.9, 5)
    scored = protocols.noise_aware_ei(C, m=1)(split.where("hidden"), split.where("NOT hidden"))
    return rounded(scored.select("campaign", "point_id", "mean", "std", "noise_var", "score"), 5)


def gauss_sql(name: str, source: str, key: str, p: int) -> str:
    """Rows of ``source`` (key, a: p rows of p numbers and more) with their left block eliminated.

    The common table ``name`` has key, k and a; at k = p + 1 the left block is the identity.
    """
    return f"""{name} AS (SELECT {key}, 1 AS k, a FROM {source}
      UNION ALL SELECT {key}, k + 1, list_transform(a, lambda row_, i: list_transform(row_, lambda v, j:
        CASE WHEN i = k THEN v / a[k][k] ELSE v - row_[k] * a[k][j] / a[k][k] END))
      FROM {name} WHERE k <= {p})"""


_V = "[1.0::DOUBLE, u1, u2, u1 * u1, u1 * u2, u2 * u2]"


def _unit_terms(rows: str) -> str:
    return f"""sc AS (SELECT campaign, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2
      FROM {rows} GROUP BY 1),
    t AS (SELECT campaign, point_id, y, hidden, {_V} AS v FROM (SELECT p.*, (x1 - m1) / s1 AS u1, (x2 - m2) / s2 AS u2
      FROM split p JOIN sc USING (campaign)))"""


def _with_extra(extra) -> str:
    rows = []
    for i in range(1, 7):
        cells = [f"sum(v[{i}] * v[{j}])" for j in range(1, 7)]
        rows.append("[" + ", ".join(cells + extra(i)) + "]")
    return "[" + ", ".join(rows) + "]"


_CURVED = POOL.replace("p_retailprice + p_size * 3 AS y", "ln(1 + p_retailprice) * p_size AS y")


@query(
    "m23_polynomial_value",
    f"""WITH RECURSIVE {_CURVED}, {split_sql("0.5", "5")}, {_unit_terms("(SELECT * FROM split WHERE NOT hidden)")},
    sums AS (SELECT campaign, {_with_extra(lambda i: [f"sum(v[{i}] * y)"])} AS a FROM t WHERE NOT hidden GROUP BY 1),
    {gauss_sql("steps", "sums", "campaign", 6)},
    coef AS (SELECT campaign, list_transform(a, lambda row_: row_[7]) AS w FROM steps WHERE k = 7)
    SELECT campaign, point_id, round(list_dot_product(v, w), 5) AS mean, CAST(row_number() OVER (PARTITION BY campaign
      ORDER BY round(list_dot_product(v, w), 5) DESC, point_id) AS INTEGER) AS batch_position
    FROM t JOIN coef USING (campaign) WHERE hidden QUALIFY batch_position <= 5""",
)
def polynomial_value(spark, sf):
    """The five hidden points of every brand with the largest second-order prediction."""
    p = pool(spark, sf).withColumn("y", F.log1p(F.col("x")[1]) * F.col("x")[0])
    split = generate.hide_split(p, C, 0.5, 5)
    scored = protocols.polynomial_value(C)(split.where("hidden"), split.where("NOT hidden"))
    picks = select_batch(scored.withColumn("score", F.round("score", 5)), C, 5)
    return picks.select("campaign", "point_id", F.col("score").alias("mean"), "batch_position")


@query(
    "m2_campaign_surfaces",
    f"""WITH RECURSIVE {_CURVED}, split AS (SELECT *, false AS hidden FROM pool), {_unit_terms("split")},
    sums AS (SELECT campaign, {_with_extra(lambda i: [f"sum(v[{i}] * y)"])} AS a FROM t GROUP BY 1),
    {gauss_sql("steps", "sums", "campaign", 6)},
    coef AS (SELECT campaign, list_transform(a, lambda row_: row_[7]) AS w FROM steps WHERE k = 7)
    SELECT campaign, point_id, round(list_dot_product(v, w), 5) AS mean FROM t JOIN coef USING (campaign)""",
)
def campaign_surfaces(spark, sf):
    """A full second-order surface per brand, with squares and the product."""
    p = pool(spark, sf).withColumn("y", F.log1p(F.col("x")[1]) * F.col("x")[0])
    out = surface_values(fit_surfaces(p, C), p, C)
    return rounded(out.select("campaign", "point_id", "mean"), 5)


@query(
    "m21_d_optimal_second_order",
    f"""WITH RECURSIVE {POOL}, {split_sql("0.5", "5")}, {_unit_terms("split")},
    sums AS (SELECT campaign, {_with_extra(lambda i: [f"{float(i == j)}::DOUBLE" for j in range(1, 7)])} AS a
      FROM t WHERE NOT hidden GROUP BY 1),
    {gauss_sql("steps", "sums", "campaign", 6)},
    inv AS (SELECT campaign, list_transform(a, lambda row_: row_[7:12]) AS m FROM steps WHERE k = 7),
    lev AS (SELECT campaign, point_id, list_dot_product(v, list_transform(m, lambda row_: list_dot_product(row_, v)))
      AS score FROM t JOIN inv USING (campaign) WHERE hidden)
    SELECT campaign, point_id, round(round(score, 8), 6) AS score, CAST(row_number() OVER (PARTITION BY campaign
      ORDER BY round(score, 8) DESC, point_id) AS INTEGER) AS batch_position FROM lev QUALIFY batch_position <= 5""",
)
def d_optimal_second(spark, sf):
    """The five hidden points of every brand that add most to a second-order design."""
    p = pool(spark, sf)
    scale = p.groupBy(*C).agg(*[F.array(*[f(F.col("x")[i]) for i in range(2)]).alias(n)
                                for n, f in (("x_mean", F.avg), ("x_std", F.stddev_pop))])
    split = generate.hide_split(p, C, 0.5, 5).join(F.broadcast(scale), C)
    split = split.withColumn("x", kernel_state.standard("x")).drop("x_mean", "x_std")
    scored = scoring.d_optimal(split.where("NOT hidden"), split.where("hidden"), C, order=2)
    picks = select_batch(scored.withColumn("score", F.round("score", 8)), C, 5)
    return rounded(picks.select("campaign", "point_id", "score", "batch_position"))


@query(
    "m8_campaign_posterior_sums",
    f"""WITH {POOL}, {split_sql("0.9", "5")}, {_basis_sql("(SELECT p.* FROM split p WHERE NOT hidden)")},
    obs AS (SELECT kp.* FROM kp JOIN split USING (campaign, point_id) WHERE NOT hidden), fit AS {_fit_sql("obs")}
    SELECT campaign, point_id, round(k * w * sy + my, 6) AS mean, round({STD}, 6) AS std
    FROM kp JOIN fit USING (campaign)""",
)
def campaign_posterior_sums(spark, sf):
    """One kernel model per brand, with one inducing point, on all points of the brand."""
    p = pool(spark, sf)
    observed = generate.hide_split(p, C, 0.9, 5).where("NOT hidden")
    return rounded(campaign_posterior(observed, p, C, m=1).select("campaign", "point_id", "mean", "std"))


@query(
    "m23_gp_ei_picks",
    f"""SELECT campaign, point_id, score, batch_position FROM ({_refit_sql(1, 10, 10)})""",
)
def gp_ei_picks(spark, sf):
    """One round of expected improvement by the scorer that fits anew in every round."""
    split = generate.hide_split(pool(spark, sf), C, 0.9, 5)
    scored = protocols.gp_ei(C, m=1)(split.where("hidden"), split.where("NOT hidden"))
    picks = select_batch(scored.withColumn("score", F.round("score", 6)), C, 10)
    return picks.select("campaign", "point_id", "score", "batch_position")


@query(
    "m22_pca2_pool",
    f"""WITH {POOL}, c AS (SELECT var_samp(x1) AS a, covar_samp(x1, x2) AS b, var_samp(x2) AS d FROM pool),
    e AS (SELECT *, (a + d) / 2 + sqrt(power((a - d) / 2, 2) + b * b) AS l1 FROM c),
    v AS (SELECT b / sqrt(b * b + power(l1 - a, 2)) AS v1, (l1 - a) / sqrt(b * b + power(l1 - a, 2)) AS v2 FROM e),
    s AS (SELECT v1 * sign(CASE WHEN abs(v1) >= abs(v2) THEN v1 ELSE v2 END) AS v1,
      v2 * sign(CASE WHEN abs(v1) >= abs(v2) THEN v1 ELSE v2 END) AS v2 FROM v),
    w AS (SELECT v1, v2, -v2 * sign(CASE WHEN abs(v2) > abs(v1) THEN -v2 ELSE v1 END) AS w1,
      v1 * sign(CASE WHEN abs(v2) > abs(v1) THEN -v2 ELSE v1 END) AS w2 FROM s)
    SELECT campaign, point_id, round(x1 * v1 + x2 * v2, 5) AS pc1, round(x1 * w1 + x2 * w2, 5) AS pc2 FROM pool, w""",
)
def pca_pool(spark, sf):
    """Both principal components of the pool's two features."""
    scores, _ = models.pca2(pool(spark, sf))
    return rounded(scores.select("campaign", "point_id", "pc1", "pc2"), 5)


@query(
    "a20_surrogates_pool",
    f"""WITH {POOL}, s AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2,
      avg(y) AS my, stddev_pop(y) AS sy FROM pool),
    k AS (SELECT y AS label, exp(-0.5::DOUBLE * (power((x1 - 25) / s1, 2) + power((x2 - 1500) / s2, 2))) AS k,
      (y - my) / sy AS y, my, sy FROM pool, s),
    f AS (SELECT sum(k * k) AS a, sum(k * y) AS b FROM k),
    p AS (SELECT config, label, k * b / (a + {NOISE} * ridge) * sy + my AS mean FROM k, f,
      (VALUES ('nystrom', 1.1::DOUBLE), ('vfe', {KMM})) AS c(config, ridge))
    SELECT config, round(avg(power(label - mean, 2)), 4) AS mse,
      round(1 - avg(power(label - mean, 2)) / var_pop(label), 6) AS r2 FROM p GROUP BY 1""",
)
def surrogates_pool(spark, sf):
    """Two kernel models of the pool with one inducing point, compared by error and fit."""
    z = np.array([[25.0, 1500.0]])
    configs = {
        "nystrom": (lambda df: df, lambda df: models.fit_nystrom(df, z), "mean"),
        "vfe": (lambda df: df, lambda df: models.fit_vfe(df, z), "mean"),
    }
    out = models.compare_surrogates(pool(spark, sf), configs)
    return out.select("config", F.round("mse", 4).alias("mse"), F.round("r2", 6).alias("r2"))


@query(
    "m1_forest_stump",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS v, l_extendedprice AS y FROM lineitem),
    steps AS (SELECT DISTINCT v FROM l),
    cuts AS (SELECT v, (v + lead(v) OVER (ORDER BY v)) / 2 AS cut FROM steps),
    gain AS (SELECT cut, sum(y) FILTER (WHERE l.v <= cut) AS a, count(*) FILTER (WHERE l.v <= cut) AS n,
      sum(y) FILTER (WHERE l.v > cut) AS b, count(*) FILTER (WHERE l.v > cut) AS m
      FROM cuts, l WHERE cut IS NOT NULL GROUP BY cut),
    best AS (SELECT cut, a / n AS low, b / m AS high FROM gain ORDER BY a * a / n + b * b / m DESC LIMIT 1)
    SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN v <= cut THEN low ELSE high END, 4) AS mean,
      0.0::DOUBLE AS std FROM l, best""",
)
def forest_stump(spark, sf):
    """A forest of one tree with one split of the discounts, grown on all rows."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.array("l_discount").alias("x"), F.col("l_extendedprice").alias("y")
    )
    out = models.fit_forest(lines, trees=1, depth=1, bootstrap=False).predict(lines)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("mean", 4).alias("mean"), "std")


# All nine second-order terms of three standardized features, and the label, in one row.
_TERMS3 = ["u1", "u2", "u3", "u1 * u1", "u1 * u2", "u1 * u3", "u2 * u2", "u2 * u3", "u3 * u3"]
_ROWS10 = ", ".join(
    "[" + ", ".join([f"sum(v[{i}] * v[{j}])" for j in range(1, 11)] + [f"sum(v[{i}] * y)"]) + "]" for i in range(1, 11)
)
QUADRATIC3 = f"""s AS (SELECT avg(l_quantity) m1, stddev_pop(l_quantity) s1, avg(l_discount) m2,
      stddev_pop(l_discount) s2, avg(l_tax) m3, stddev_pop(l_tax) s3 FROM lineitem),
    t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, y, [1.0::DOUBLE, {", ".join(_TERMS3)}] AS v FROM (
      SELECT *, l_extendedprice AS y, (l_quantity - m1) / s1 AS u1, (l_discount - m2) / s2 AS u2, (l_tax - m3) / s3 AS u3
      FROM lineitem, s)),
    sums AS (SELECT 1 AS one, [{_ROWS10}] AS a FROM t),
    {gauss_sql("steps", "sums", "one", 10)},
    coef AS (SELECT list_transform(a, lambda row_: row_[11]) AS w FROM steps WHERE k = 11),
    pred AS (SELECT t.*, list_dot_product(v, w) AS p FROM t, coef)"""


def _surface(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array("l_quantity", "l_discount", "l_tax").alias("x"),
        F.col("l_extendedprice").alias("y"),
    )
    return models.fit_quadratic(lines).predict(lines)


@query(
    "m2_quadratic_all",
    f"""WITH RECURSIVE {QUADRATIC3} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(p, 1) AS prediction
    FROM pred""",
)
def quadratic_all(spark, sf):
    """The response surface of price over quantity, discount and tax with all squares and products."""
    out = _surface(spark, sf)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("prediction", 1).alias("prediction"))


@query(
    "a9_regression_fit_all",
    f"""WITH RECURSIVE {QUADRATIC3} SELECT round(avg((y - p) * (y - p)), 2) AS mse,
    round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, count(*) AS n FROM pred""",
)
def regression_all(spark, sf):
    """Error and fit of the surface over all three features."""
    out = stats.regression_fit(_surface(spark, sf), "y", "prediction")
    return out.select(F.round("mse", 2).alias("mse"), F.round("r2", 6).alias("r2"), "n")
