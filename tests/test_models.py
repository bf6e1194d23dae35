import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldtrial.operators import difficulty, models, scoring

RNG = np.random.default_rng(5)
X = RNG.normal(size=(120, 3))
Y = np.sin(X[:, 0]) + X[:, 1] ** 2 - 0.5 * X[:, 2]


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, [float(v) for v in x], float(y)) for i, (x, y) in enumerate(zip(X, Y))]
    return spark.createDataFrame(rows, "id long, x array<double>, y double").repartition(3)


def predicted(model, df):
    out = model.predict(df).orderBy("id").toPandas()
    return out["mean"].to_numpy(), out["std"].to_numpy()


def test_nystrom_equals_the_full_system(data):
    z, noise = X[:15], 0.1
    kmm, knm = models.rbf(z, z) + noise * np.eye(15), models.rbf(X, z)
    q = knm @ np.linalg.solve(kmm, knm.T) + noise * np.eye(len(X))
    expected = knm @ np.linalg.solve(kmm, knm.T @ np.linalg.solve(q, Y))
    mean, std = predicted(models.fit_nystrom(data, z, standardize=False), data)
    np.testing.assert_allclose(mean, expected, atol=1e-8)
    np.testing.assert_allclose(std, np.sqrt(0.1))


def test_fitc_and_vfe_equal_their_formulas(data):
    z, noise = X[:15], 0.1
    kmm, knm = models.rbf(z, z), models.rbf(X, z)
    inv = np.linalg.inv(kmm)
    missed = np.maximum(1 - np.sum(knm * (inv @ knm.T).T, axis=1), 1e-6) + noise
    w = np.linalg.solve(knm.T @ (knm / missed[:, None]) + inv, knm.T @ (Y / missed))
    mean, std = predicted(models.fit_fitc(data, z, standardize=False), data)
    np.testing.assert_allclose(mean, knm @ w, atol=1e-6)
    var = np.maximum(1 - np.sum(knm * (inv @ knm.T).T, axis=1) + noise, 1e-6)
    np.testing.assert_allclose(std, np.sqrt(var), atol=1e-6)
    kj = kmm + 1e-6 * np.eye(15)
    w = np.linalg.solve(knm.T @ knm + noise * kj, knm.T @ Y)
    mean, _ = predicted(models.fit_vfe(data, z, standardize=False), data)
    np.testing.assert_allclose(mean, knm @ w, atol=1e-6)


def test_standardized_models_do_not_depend_on_units(data):
    z = X[:15]
    moved = data.withColumn("x", F.transform("x", lambda v: v * 500 + 2000)).withColumn("y", F.col("y") * 30 + 1027)
    for fit in (models.fit_nystrom, models.fit_fitc, models.fit_vfe):
        mean, std = predicted(fit(data, z), data)
        far, wide = predicted(fit(moved, z * 500 + 2000), moved)
        np.testing.assert_allclose(far, mean * 30 + 1027, rtol=1e-6)
        np.testing.assert_allclose(wide, std * 30, rtol=1e-6)
        assert np.abs(mean - Y).mean() < 0.5 * np.abs(Y - Y.mean()).mean()


def test_quadratic_recovers_a_quadratic(data, spark):
    exact = data.withColumn("y", 1 + 2 * F.col("x")[0] - F.col("x")[1] * F.col("x")[2] + F.pow(F.col("x")[0], 2))
    out = models.fit_quadratic(exact).predict(exact).toPandas()
    np.testing.assert_allclose(out["prediction"], out["y"], atol=1e-6)


def test_forest_mean_is_the_mean_of_its_trees(data):
    model = models.fit_forest(data, trees=5, depth=4)
    out = model.predict(data)
    whole = model.model.setFeaturesCol("_vec").transform(models._vector(data)).select("id", "prediction")
    both = out.join(whole, "id").toPandas()
    np.testing.assert_allclose(both["mean"], both["prediction"])
    assert (both["std"] >= 0).all() and both["std"].max() > 0


def test_changed_training_rows_are_computed_once(data, spark):
    computed = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def louder(y):
        computed.add(1)
        return 2.0 * y

    configs = {
        "plain": (lambda d: d, lambda d: models.fit_forest(d, trees=2, depth=2), "mean"),
        "loud": (lambda d: d.withColumn("y", louder("y")), lambda d: models.fit_forest(d, trees=2, depth=2), "mean"),
    }
    rows = {r["config"]: r for r in models.compare_surrogates(data, configs).collect()}
    assert computed.value == len(X) and rows["loud"]["mse"] > rows["plain"]["mse"]


def test_a_forest_mean_evaluates_the_forest_once(data):
    out = models.fit_forest(data, trees=5, depth=2).predict(data).select("mean")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("UDF") == 2  # vector, forest


def test_inducing_points(data):
    assert len(models.inducing_points(data, 500)) == 120
    assert models.inducing_points(data, 8).shape == (8, 3)


def test_median_distance_ignores_zeros(spark):
    df = spark.createDataFrame(
        [(1, [0.0]), (2, [0.0]), (3, [1.0]), (4, [5.0])], "id long, x array<double>"
    )
    # Distances 1, 1, 4, 4, 5, 5 and zeros: the pairs are drawn, and 4 is in the middle of many.
    assert models.median_distance(df, "id", 4000).first()[0] == 4.0
    same = spark.createDataFrame([(1, [2.0, 2.0]), (2, [2.0, 2.0])], "id long, x array<double>")
    assert models.median_distance(same, "id").first()[0] == pytest.approx(2**0.5)


def test_pca_scores(data):
    scores, share = models.pca2(data)
    got = scores.orderBy("id").toPandas()
    cov = np.cov(X.T)
    values, vectors = np.linalg.eigh(cov)
    for name, column in (("pc1", -1), ("pc2", -2)):
        v = vectors[:, column]
        v = v * np.sign(v[np.abs(v).argmax()])
        np.testing.assert_allclose(got[name], X @ v, atol=1e-8)
    np.testing.assert_allclose(share, values[::-1][:2] / values.sum())


def test_d_optimal_ranks_like_the_determinant(spark, data):
    one = data.withColumn("campaign", F.lit("c"))
    observed, cands = one.where("id < 20"), one.where("id >= 20")
    got = scoring.d_optimal(observed, cands, ["campaign"]).toPandas().set_index("id")["score"]
    design = np.column_stack([np.ones(20), X[:20]])
    info = design.T @ design
    dets = {i: np.linalg.det(info + np.outer(np.r_[1, X[i]], np.r_[1, X[i]])) for i in range(20, 120)}
    assert got.idxmax() == max(dets, key=dets.get)
    few = scoring.d_optimal(one.where("id < 2"), cands, ["campaign"])
    assert few.where("score is null or isnan(score)").count() == 0


def test_trust_region_levels(spark):
    cands = spark.createDataFrame(
        [("near", 1, [0.1]), ("near", 2, [0.9]), ("wide", 1, [0.4]), ("wide", 2, [0.9]),
         ("none", 1, [3.0]), ("none", 2, [4.0])], "campaign string, point_id long, x array<double>")
    observed = spark.createDataFrame(
        [(c, [0.0], 5.0) for c in ("near", "wide", "none")] + [("near", [9.0], 1.0)],
        "campaign string, x array<double>, y double")
    radius = observed.select("campaign").distinct().withColumn("radius", F.lit(0.3))
    got = scoring.trust_region(cands, observed, radius, ["campaign"]).collect()
    assert sorted((r["campaign"], r["point_id"], r["level"]) for r in got) == [
        ("near", 1, 1.0), ("none", 1, 0.0), ("none", 2, 0.0), ("wide", 1, 1.5)]


def test_expected_improvement_limits(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 0.0), (2.0, 1.0)], "mean double, std double")
    ei = scoring.expected_improvement(F.col("mean"), F.col("std"), F.lit(2.0))
    got = [r[0] for r in df.select(ei).collect()]
    assert got[0] == pytest.approx(0.0, abs=1e-6) and got[1] == pytest.approx(1.0, abs=1e-6)
    assert got[2] == pytest.approx(0.3989423, abs=1e-6)


def test_constant_feature_has_no_correlation(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1.0), ([1.0, 4.0], 2.0)], "x array<double>, y double")
    got = {r["dim"]: r["relevance"] for r in scoring.feature_relevance(df).collect()}
    assert got[0] == 0.0 and got[1] == pytest.approx(1.0, abs=1e-5)


def test_noise_is_repeatable_and_centred(spark):
    df = spark.range(4000).select("id", F.lit(0.0).alias("y"))
    a = difficulty.add_noise(df, 2.0, ["s", F.col("id")]).toPandas().sort_values("id")["y"]
    b = difficulty.add_noise(df.repartition(7), 2.0, ["s", F.col("id")]).toPandas().sort_values("id")["y"]
    assert a.tolist() == b.tolist()
    assert abs(a.mean()) < 0.15 and a.std() == pytest.approx(2.0, abs=0.1)


def test_gram_by_key(spark):
    rows = pd.DataFrame({"k": ["a", "b", "a"], "x": [[1.0, 2.0], [0.0, 1.0], [3.0, 1.0]], "y": [1.0, 2.0, 3.0]})
    got = {r["k"]: r for r in scoring.gram(spark.createDataFrame(rows), ["k"], "x", "y").collect()}
    assert got["a"]["xtx"] == [10.0, 5.0, 5.0, 5.0] and got["a"]["xty"] == [10.0, 5.0] and got["a"]["n"] == 2
    assert got["b"]["xtx"] == [0.0, 0.0, 0.0, 1.0]
