"""Acquisition, model and round queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrial.operators import difficulty, generate, models, prep, scoring, selection, stats
from fieldtrial.plans import rounds

from .generation_queries import split_sql
from .inputs import POOL, POOL3, PREDICTIONS, VECTORS, pool, pool3, predictions, rounded, vectors
from .registry import query, s_cdf, s_hash, s_normal, s_pdf, table

C = ["campaign"]


def _with_best(spark, sf):
    p = predictions(spark, sf)
    return p.join(scoring.denoised_best(p, C), C)


def _scored(spark, sf, score, digits=6):
    return rounded(
        _with_best(spark, sf).select("campaign", "point_id", score.alias("score")), digits
    )


def _ei_sql(scale: str, extra: str = "", floor: bool = False) -> str:
    """Improvement over best with deviation ``s`` = scale."""
    z = "((mean - best) / s)"
    ei = f"((mean - best) * {s_cdf(z)} + s * {s_pdf(z)}{extra})"
    ei = f"greatest({ei}, 0.0::DOUBLE)" if floor else ei
    return f"""WITH {PREDICTIONS}, joined AS (SELECT p.*, best, greatest(std, 1e-6::DOUBLE) AS s0,
    {scale} AS s FROM predictions p JOIN best USING (campaign))
    SELECT campaign, point_id, round({ei}, 6) AS score FROM joined"""


@query("m10_expected_improvement", _ei_sql("greatest(std, 1e-6::DOUBLE)", floor=True))
def m10(spark, sf):
    return _scored(
        spark, sf, scoring.expected_improvement(F.col("mean"), F.col("std"), F.col("best"))
    )


@query(
    "m11_denoised_best",
    f"WITH {PREDICTIONS} SELECT campaign, round(best, 6) AS best FROM best",
)
def m11(spark, sf):
    return rounded(scoring.denoised_best(predictions(spark, sf), C))


@query("m12_ei_bonus", _ei_sql("greatest(std, 1e-6::DOUBLE)", " + 0.1::DOUBLE * s0"))
def m12(spark, sf):
    return _scored(spark, sf, scoring.ei_bonus(F.col("mean"), F.col("std"), F.col("best")))


@query(
    "m13_noise_aware_ei",
    _ei_sql(
        "sqrt(power(greatest(std, 1e-8::DOUBLE), 2) + noise_var)",
        " + 0.01::DOUBLE * greatest(std, 1e-8::DOUBLE)",
    ),
)
def m13(spark, sf):
    return _scored(
        spark, sf,
        scoring.noise_aware_ei(F.col("mean"), F.col("std"), F.col("noise_var"), F.col("best")),
    )


@query(
    "m14_ucb",
    f"""WITH {PREDICTIONS} SELECT campaign, point_id,
    round(mean + 1.0::DOUBLE * greatest(std, 1e-6), 6) AS score,
    round(mean + 0.1::DOUBLE * greatest(std, 1e-6), 6) AS simple_score FROM predictions""",
)
def m14(spark, sf):
    mean, std = F.col("mean"), F.col("std")
    return rounded(
        predictions(spark, sf).select(
            "campaign", "point_id", scoring.ucb(mean, std).alias("score"),
            scoring.ucb(mean, std, 0.1).alias("simple_score"),
        )
    )


@query(
    "m15_predicted_value",
    f"""WITH {PREDICTIONS} SELECT campaign, point_id, round(mean, 6) AS score,
    CAST(row_number() OVER w AS INTEGER) AS batch_position FROM predictions
    WINDOW w AS (PARTITION BY campaign ORDER BY mean DESC, point_id)
    QUALIFY row_number() OVER w <= 10""",
)
def m15(spark, sf):
    scored = predictions(spark, sf).withColumn("score", scoring.predicted_value(F.col("mean")))
    out = selection.select_batch(scored, C, 10)
    return rounded(out.select("campaign", "point_id", "score", "batch_position"))


@query(
    "w6_select_batch",
    f"""WITH {PREDICTIONS} SELECT campaign, point_id, round(mean + greatest(std, 1e-6), 6) AS score,
    CAST(row_number() OVER w AS INTEGER) AS batch_position FROM predictions
    WINDOW w AS (PARTITION BY campaign ORDER BY mean + greatest(std, 1e-6) DESC, point_id)
    QUALIFY row_number() OVER w <= 20""",
)
def w6(spark, sf):
    scored = predictions(spark, sf).withColumn(
        "score", scoring.ucb(F.col("mean"), F.col("std"))
    )
    out = selection.select_batch(scored, C, 20)
    return rounded(out.select("campaign", "point_id", "score", "batch_position"))


SIGMA = """sigma AS (SELECT {g} 1.4826::DOUBLE * median(abs(y - med)) + 1e-9::DOUBLE AS sigma
  FROM (SELECT *, median(y) OVER ({p}) AS med FROM {t}) GROUP BY ALL)"""


@query(
    "m17_mad_sigma",
    f"""WITH {POOL}, {SIGMA.format(g="campaign,", p="PARTITION BY campaign", t="pool")}
    SELECT campaign, round(sigma, 6) AS sigma FROM sigma""",
)
def m17(spark, sf):
    return rounded(scoring.mad_sigma(pool(spark, sf), C))


@query(
    "m16_local_noise",
    f"""WITH {VECTORS}, {SIGMA.format(g="", p="", t="vectors")},
    near AS (SELECT a.vec_id AS query_id, b.y FROM vectors a, vectors b
      QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY
        sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: power(p[1] - p[2], 2)))), b.vec_id) <= 10)
    SELECT query_id, round(greatest(var_pop(y), 0.1::DOUBLE * any_value(sigma) * any_value(sigma))
      + 1e-9::DOUBLE, 6) AS noise_var FROM near, sigma GROUP BY 1""",
)
def m16(spark, sf):
    v = vectors(spark, sf)
    observed = v.withColumnRenamed("vec_id", "point_id")
    return rounded(scoring.local_noise(observed, v.withColumnRenamed("vec_id", "query_id")))


FLAT = """flat AS (SELECT vec_id, y, unnest(x) AS v, unnest(range(64)) AS dim FROM vectors),
per AS (SELECT dim, abs(covar_pop(v, y) / (stddev_pop(v) * stddev_pop(y))) AS c, var_pop(v) AS s
  FROM flat GROUP BY 1),
rel AS (SELECT dim, 0.7::DOUBLE * coalesce(c, 0) + 0.3::DOUBLE * s / (max(s) OVER () + 1e-6::DOUBLE)
  AS relevance FROM per)"""


@query(
    "m18_feature_relevance",
    f"""WITH {VECTORS}, {FLAT} SELECT CAST(dim AS INTEGER) AS dim, round(relevance, 6) AS relevance
    FROM rel""",
)
def m18(spark, sf):
    return rounded(scoring.feature_relevance(vectors(spark, sf)))


@query(
    "m19_project",
    f"""WITH {VECTORS}, {FLAT},
    raw AS (SELECT dim, j, {s_normal("'8'", "'project'", "dim", "j")}
      * sqrt(relevance / sum(relevance) OVER (PARTITION BY j) + 0.1::DOUBLE) AS w
      FROM rel, (SELECT unnest(range(8)) AS j)),
    unit AS (SELECT dim, j, w / sqrt(sum(w * w) OVER (PARTITION BY j)) AS w FROM raw)
    SELECT vec_id, CAST(j AS INTEGER) AS j, round(sum(v * w), 6) AS v
    FROM flat JOIN unit USING (dim) GROUP BY 1, 2""",
)
def m19(spark, sf):
    v = vectors(spark, sf)
    out = scoring.project(v, scoring.feature_relevance(v), 8, 8)
    return rounded(out.select("vec_id", F.posexplode("x").alias("j", "v")))


UNIT = """scaled AS (SELECT campaign, point_id, y, is_target, hidden,
      2 * (x1 - a1) / (b1 - a1) - 1 AS x1, 2 * (x2 - a2) / (b2 - a2) - 1 AS x2 FROM split JOIN
      (SELECT campaign, min(x1) a1, max(x1) b1, min(x2) a2, max(x2) b2 FROM pool GROUP BY 1)
      USING (campaign))"""


def _split_scaled(spark, sf, fraction, seed):
    p = pool(spark, sf)
    split = generate.hide_split(p, C, fraction, seed)
    scaled = prep.scale_pm1(split, stats.bounds(p, C), C)
    return scaled.where("hidden"), scaled.where("NOT hidden")


@query(
    "m20_trust_region",
    f"""WITH {POOL}, {split_sql("0.9", "5")}, {UNIT},
    centre AS (SELECT campaign, [x1, x2] AS c FROM scaled WHERE NOT hidden
      QUALIFY row_number() OVER (PARTITION BY campaign ORDER BY y DESC, point_id) = 1),
    near AS (SELECT s.campaign, point_id, sqrt(power(x1 - c[1], 2) + power(x2 - c[2], 2)) AS distance,
      0.02::DOUBLE + length(s.campaign) * 0.01::DOUBLE AS radius
      FROM scaled s JOIN centre USING (campaign) WHERE hidden),
    lvl AS (SELECT *, CASE WHEN min(distance) OVER w <= radius THEN 1.0::DOUBLE
      WHEN min(distance) OVER w <= radius * 1.5 THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END AS level
      FROM near WINDOW w AS (PARTITION BY campaign))
    SELECT campaign, point_id, round(distance, 6) AS distance, level FROM lvl
    WHERE level = 0 OR distance <= radius * level""",
)
def m20(spark, sf):
    hidden, observed = _split_scaled(spark, sf, 0.9, 5)
    radius = observed.select("campaign").distinct().withColumn(
        "radius", F.lit(0.02) + F.length("campaign") * F.lit(0.01)
    )
    out = scoring.trust_region(hidden, observed, radius, C)
    return rounded(out.select("campaign", "point_id", "distance", "level"))


@query(
    "m20_next_radius",
    f"""WITH {PREDICTIONS} SELECT campaign, round(least(greatest(0.5::DOUBLE *
    CASE WHEN max(mean) > avg(mean) + stddev_pop(mean) THEN 0.9::DOUBLE ELSE 1.1::DOUBLE END, 0.1), 1.0), 6)
    AS radius FROM predictions GROUP BY 1""",
)
def m20_radius(spark, sf):
    scored = predictions(spark, sf).withColumn("score", F.col("mean"))
    radius = scored.select("campaign").distinct().withColumn("radius", F.lit(0.5))
    return rounded(scoring.next_radius(scored, radius, C))


@query(
    "m21_d_optimal",
    f"""WITH {POOL}, {split_sql("0.8", "5")}, {UNIT},
    m AS (SELECT campaign, CAST(count(*) AS DOUBLE) a, sum(x1) b, sum(x2) c, sum(x1 * x1) d,
      sum(x1 * x2) e, sum(x2 * x2) f FROM scaled WHERE NOT hidden GROUP BY 1),
    k AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM m),
    lev AS (SELECT s.campaign, point_id, ((d * f - e * e) + x1 * x1 * (a * f - c * c)
      + x2 * x2 * (a * d - b * b) + 2 * x1 * (c * e - b * f) + 2 * x2 * (b * e - c * d)
      + 2 * x1 * x2 * (b * c - a * e)) / det AS score
      FROM scaled s JOIN k USING (campaign) WHERE hidden)
    SELECT campaign, point_id, round(score, 6) AS score, CAST(row_number() OVER w AS INTEGER)
      AS batch_position FROM lev
    WINDOW w AS (PARTITION BY campaign ORDER BY round(score, 9) DESC, point_id)
    QUALIFY row_number() OVER w <= 5""",
)
def m21(spark, sf):
    hidden, observed = _split_scaled(spark, sf, 0.8, 5)
    scored = scoring.d_optimal(observed, hidden, C).withColumn("score", F.round("score", 9))
    out = selection.select_batch(scored, C, 5)
    return rounded(out.select("campaign", "point_id", "score", "batch_position"))


def _lines(spark, sf):
    """Order lines as a regression table: price from quantity, discount and tax."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.array("l_quantity", "l_discount", "l_tax").alias("x"),
        F.col("l_extendedprice").alias("y"),
    )


@query("m1_forest")
def m1(spark, sf):
    """Forest prediction and tree spread; training depends on the forest's own random choices."""
    lines = _lines(spark, sf)
    out = models.fit_forest(lines, trees=10).predict(lines)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "mean", "std")


QUADRATIC = """s AS (SELECT avg(q) m1, avg(q * q) m2, avg(y) my, var_pop(q) s11,
    covar_pop(q, q * q) s12, var_pop(q * q) s22, covar_pop(q, y) s1y, covar_pop(q * q, y) s2y
    FROM (SELECT l_quantity AS q, l_extendedprice AS y FROM lineitem)),
coef AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
    (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s),
pred AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS y,
    my + b1 * (l_quantity - m1) + b2 * (l_quantity * l_quantity - m2) AS p FROM lineitem, coef)"""


def _quadratic(spark, sf):
    lines = _lines(spark, sf).withColumn("x", F.slice("x", 1, 1))
    return models.fit_quadratic(lines).predict(lines)


@query(
    "m2_quadratic",
    f"""WITH {QUADRATIC} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    round(p, 3) AS prediction FROM pred""",
)
def m2(spark, sf):
    out = _quadratic(spark, sf)
    return rounded(
        out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "prediction"), 3
    )


@query(
    "a9_regression_fit",
    f"""WITH {QUADRATIC} SELECT round(avg((y - p) * (y - p)), 2) AS mse,
    round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, count(*) AS n FROM pred""",
)
def a9(spark, sf):
    out = stats.regression_fit(_quadratic(spark, sf), "y", "prediction")
    return out.select(F.round("mse", 2).alias("mse"), F.round("r2", 6).alias("r2"), "n")


@query("m3_inducing_points")
def m3(spark, sf):
    centres = models.inducing_points(vectors(spark, sf), 50)
    return spark.createDataFrame(
        [(i, [float(v) for v in c]) for i, c in enumerate(centres)], "centre int, x array<double>"
    )


@query(
    "m4_kernel_features",
    f"""WITH {VECTORS}, flat AS (SELECT vec_id, y, unnest(x) AS v, unnest(range(64)) AS dim FROM vectors),
    z AS (SELECT y AS label, dim, avg(v) AS c FROM flat GROUP BY 1, 2)
    SELECT vec_id, CAST(label AS INTEGER) AS m, round(exp(-0.5::DOUBLE * sum(power(v - c, 2))), 6) AS k
    FROM flat JOIN z USING (dim) GROUP BY 1, 2""",
)
def m4(spark, sf):
    v = vectors(spark, sf)
    z = models.centroids(v, "y")
    out = v.select("vec_id", models.kernel_features(F.col("x"), z).alias("k"))
    return rounded(out.select("vec_id", F.posexplode("k").alias("m", "k")))


def _kernel(spark, sf, fit):
    """Fit on all vectors with 50 inducing points and predict them; compared in the tests."""
    v = vectors(spark, sf)
    z = models.inducing_points(v, 50)
    return fit(v, z, length=8.0).predict(v).select("vec_id", "y", "mean", "std")


@query("m5_nystrom")
def m5(spark, sf):
    return _kernel(spark, sf, models.fit_nystrom)


@query("m6_fitc")
def m6(spark, sf):
    return _kernel(spark, sf, models.fit_fitc)


@query("m7_vfe")
def m7(spark, sf):
    return _kernel(spark, sf, models.fit_vfe)


@query(
    "m8_posterior",
    f"""WITH {POOL}, k AS (SELECT campaign, point_id, exp(-0.5::DOUBLE * power((x1 - 25) / 20.0::DOUBLE, 2))
    AS k, y FROM pool), f AS (SELECT sum(k * k) AS a, sum(k * y) AS b FROM k)
    SELECT campaign, point_id, round(k * b / (a + 0.1::DOUBLE * (1 + 1e-6::DOUBLE)), 6) AS mean,
    round(sqrt(greatest(1 - k * k / (1 + 1e-6::DOUBLE) + 0.1::DOUBLE, 1e-6::DOUBLE)), 6) AS std
    FROM k, f""",
)
def m8(spark, sf):
    """One inducing point, for which the posterior has a short closed form."""
    import numpy as np

    p = pool(spark, sf).withColumn("x", F.slice("x", 1, 1))
    model = models.fit_vfe(p, np.array([[25.0]]), length=20.0, standardize=False)
    return rounded(model.predict(p).select("campaign", "point_id", "mean", "std"))


# One inducing point (25, 1500) on standardized rows: the sums of both models have one entry.
_SCALED = f"""WITH {{POOL}}, s AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2,
      stddev_pop(x2) AS s2, avg(y) AS my, stddev_pop(y) AS sy FROM pool),
    k AS (SELECT campaign, point_id, exp(-0.5::DOUBLE * (power((x1 - 25) / s1, 2)
      + power((x2 - 1500) / s2, 2))) AS k, (y - my) / sy AS y, my, sy FROM pool, s)"""


@query(
    "m7_vfe_raw_pool",
    _SCALED.format(POOL=POOL) + """, f AS (SELECT sum(k * k) AS a, sum(k * y) AS b FROM k)
    SELECT campaign, point_id, round(k * b / (a + 0.1::DOUBLE * (1 + 1e-6::DOUBLE)) * sy + my, 6) AS mean,
    round(sqrt(greatest(1 - k * k / (1 + 1e-6::DOUBLE) + 0.1::DOUBLE, 1e-6::DOUBLE)) * sy, 6) AS std
    FROM k, f""",
)
def m7_raw(spark, sf):
    """The variational model in the units of the pool."""
    return _raw_pool(spark, sf, models.fit_vfe)


@query(
    "m5_nystrom_raw_pool",
    _SCALED.format(POOL=POOL) + """, f AS (SELECT sum(k * k) AS a, sum(k * y) AS b FROM k)
    SELECT campaign, point_id, round(k * b / (a + 0.1::DOUBLE * 1.1::DOUBLE) * sy + my, 6) AS mean,
    round(sqrt(0.1::DOUBLE) * sy, 6) AS std FROM k, f""",
)
def m5_raw(spark, sf):
    """The Nyström model in the units of the pool."""
    return _raw_pool(spark, sf, models.fit_nystrom)


@query(
    "m6_fitc_raw_pool",
    _SCALED.format(POOL=POOL) + """, w AS (SELECT *, 1 / (greatest(1 - k * k, 1e-6::DOUBLE) + 0.1::DOUBLE) AS w FROM k),
    f AS (SELECT sum(k * k * w) AS a, sum(k * y * w) AS b FROM w)
    SELECT campaign, point_id, round(k * b / (a + 1) * sy + my, 6) AS mean,
    round(sqrt(greatest(1 - k * k + 0.1::DOUBLE, 1e-6::DOUBLE)) * sy, 6) AS std FROM w, f""",
)
def m6_raw(spark, sf):
    """The weighted model in the units of the pool."""
    return _raw_pool(spark, sf, models.fit_fitc)


def _raw_pool(spark, sf, fit):
    import numpy as np

    p = pool(spark, sf)
    model = fit(p, np.array([[25.0, 1500.0]]))
    return rounded(model.predict(p).select("campaign", "point_id", "mean", "std"))


@query(
    "m9_median_distance",
    f"""WITH {VECTORS}, placed AS (SELECT *, row_number() OVER (
        ORDER BY {s_hash("'42'", "vec_id")}, vec_id) AS at, count(*) OVER () AS n FROM vectors),
    drawn AS (SELECT ({s_hash("'42'", "'i'", "r")} * 1048576 + {s_hash("'42'", "'i'", "r", "'low'")} % 1048576)
          % n + 1 AS i, ({s_hash("'42'", "'j'", "r")} * 1048576 + {s_hash("'42'", "'j'", "r", "'low'")} % 1048576)
          % n + 1 AS j FROM (SELECT unnest(range(20000)) AS r), (SELECT any_value(n) AS n FROM placed)),
    pairs AS (
      SELECT sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: power(p[1] - p[2], 2)))) AS d
      FROM drawn JOIN placed a ON a.at = i JOIN placed b ON b.at = j)
    SELECT round(median(d), 6) AS median_distance FROM pairs WHERE d > 0""",
)
def m9(spark, sf):
    return rounded(models.median_distance(vectors(spark, sf), "vec_id"))


@query("m22_pca2")
def m22(spark, sf):
    v = vectors(spark, sf)
    both = v.withColumn("x", F.concat("x", F.array("y")))
    scores, share = models.pca2(both)
    return scores.select("vec_id", "pc1", "pc2", F.lit(share[0] + share[1]).alias("explained"))


@query("a20_compare_surrogates")
def a20(spark, sf):
    lines = _lines(spark, sf)
    who = ["c", *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey")]]
    configs = {
        "forest": (lambda d: d, lambda d: models.fit_forest(d, trees=5), "mean"),
        "forest_noisy": (
            lambda d: difficulty.add_noise(d, 0.2, who, by="value"),
            lambda d: models.fit_forest(d, trees=5),
            "mean",
        ),
        "quadratic": (lambda d: d, models.fit_quadratic, "prediction"),
    }
    return models.compare_surrogates(lines, configs)


def _start(spark, sf, fraction):
    split = generate.hide_split(pool(spark, sf), C, fraction, 5)
    return split.where("NOT hidden")


def _by_size(hidden, observed):
    """Highest second feature first."""
    return hidden.withColumn("score", F.col("x")[1])


@query(
    "m23_run_rounds",
    f"""WITH {POOL}, {split_sql("0.5", "5")},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY x2 DESC, point_id) AS pos
      FROM split WHERE hidden),
    goal AS (SELECT campaign, (pos - 1) // 5 AS last FROM ranked WHERE is_target)
    SELECT campaign, point_id, CAST((pos - 1) // 5 AS INTEGER) AS step,
      CAST((pos - 1) % 5 + 1 AS INTEGER) AS batch_position, round(y, 6) AS value
    FROM ranked JOIN goal USING (campaign) WHERE (pos - 1) // 5 <= last""",
)
def m23(spark, sf):
    history = rounds.run_rounds(
        pool(spark, sf), _start(spark, sf, 0.5), _by_size, C, batch=5
    )
    return rounded(history.select("campaign", "point_id", "step", "batch_position", "value"))


def _local_mean(hidden, observed):
    """Adaptive scorer: mean value of the nearest three observations."""
    from fieldtrial.operators.neighbours import knn

    near = knn(hidden.withColumnRenamed("point_id", "query_id"), observed, 3, C)
    values = observed.select("campaign", "point_id", "y")
    score = near.join(values, ["campaign", "point_id"]).groupBy(
        "campaign", F.col("query_id").alias("point_id")
    ).agg(F.avg("y").alias("score"))
    return hidden.join(score, ["campaign", "point_id"])


@query("m23_adaptive_rounds")
def m23_adaptive(spark, sf):
    p = pool(spark, sf)
    history = rounds.run_rounds(p, _start(spark, sf, 0.9), _local_mean, C, batch=20)
    return rounds.outcomes(history, p, C)
