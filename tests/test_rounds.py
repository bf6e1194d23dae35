"""Strategies with state, against plain NumPy versions of their rounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrial.operators import kernel_state as ks
from fieldtrial.operators import scoring, surfaces
from fieldtrial.operators.models import rbf
from fieldtrial.plans import protocols, stateful

KEYS = ["campaign"]
RNG = np.random.default_rng(5)
X = {"a": RNG.normal(size=(70, 3)), "b": RNG.normal(size=(40, 3)) * 4 + 1}
Y = {c: np.sin(x[:, 0]) + 0.3 * x[:, 1] ** 2 - 0.2 * x[:, 2] for c, x in X.items()}


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(c, i, [float(v) for v in p], float(Y[c][i])) for c, x in X.items() for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "campaign string, point_id long, x array<double>, y double").cache()


def fit(c, rows, z, mean, std, weight=None, noise=0.1):
    """Weights, label mean and deviation on a given basis."""
    y, w = Y[c][rows], np.ones(len(rows)) if weight is None else weight
    k = rbf((X[c][rows] - mean) / std, z)
    my = (w @ y) / w.sum()
    sy = math.sqrt((w @ (y * y)) / w.sum() - my * my)
    a = k.T @ (k * w[:, None]) + noise * (rbf(z, z) + 1e-6 * np.eye(len(z)))
    return np.linalg.solve(a, k.T @ (w * (y - my) / sy)), my, sy


def basis(row):
    return np.array(row["z"]), np.array(row["x_mean"]), np.array(row["x_std"])


def test_added_rows_equal_a_full_fit(pool):
    first, more = pool.where("point_id < 20"), pool.where("point_id >= 20 AND point_id < 33")
    strategy = stateful.KernelImprovement(KEYS, m=8, refit_every=10)
    state = strategy.start(first)
    grown = strategy.advance(state, pool.where("point_id < 33"), more)
    for row in grown.collect():
        c, rows = row["campaign"], np.arange(33)
        assert row["refitted"] and row["n_fit"] == 33
        w, my, sy = fit(c, rows, *basis(row))
        np.testing.assert_allclose(row["w"][0], w, atol=1e-7)
        assert row["y_mean"][0] == pytest.approx(my) and row["y_std"][0] == pytest.approx(sy)
        k = rbf((X[c][rows] - row["x_mean"]) / row["x_std"], np.array(row["z"]))
        assert row["best"] == pytest.approx((k @ w * sy + my).max())


def test_weights_wait_until_they_are_due(pool):
    strategy = stateful.KernelImprovement(KEYS, m=8, refit_every=10)
    state = strategy.start(pool.where("point_id < 20"))
    old = {r["campaign"]: r for r in state.collect()}
    grown = strategy.advance(state, pool.where("point_id < 25"), pool.where("point_id >= 20 AND point_id < 25"))
    for row in grown.collect():
        c = row["campaign"]
        assert not row["refitted"] and row["n_fit"] == 20 and row["sums"][0] == 25
        assert row["w"] == old[c]["w"]
        k = rbf((X[c][:25] - row["x_mean"]) / row["x_std"], np.array(row["z"]))
        mean = k @ np.array(row["w"][0]) * row["y_std"][0] + row["y_mean"][0]
        assert row["best"] == pytest.approx(mean.max())


def test_bagged_replicas(pool):
    observed, asked = pool.where("point_id < 30"), pool.where("point_id >= 30")
    strategy = stateful.KernelImprovement(KEYS, m=6, replicas=5)
    state = strategy.start(observed)
    drawn = observed.select("campaign", "point_id", ks.bag_weights(5, KEYS, "point_id", 42).alias("w")).collect()
    weights = {c: np.array([r["w"] for r in sorted(drawn, key=lambda r: r["point_id"]) if r["campaign"] == c]) for c in X}
    scored = strategy.score(state, asked, observed).toPandas()
    for row in state.collect():
        c, rows = row["campaign"], np.arange(30)
        z, mean, std = basis(row)
        inverse = np.linalg.inv(rbf(z, z) + 1e-6 * np.eye(len(z)))
        mine = scored[scored.campaign == c].sort_values("point_id")
        k = rbf((X[c][30:] - mean) / std, z)
        spread = np.sqrt(np.maximum(1 - (k * (k @ inverse)).sum(1) + 0.1, 1e-6))
        means, stds = [], []
        for r in range(1, 6):
            w, my, sy = fit(c, rows, z, mean, std, weights[c][:, r])
            means.append(k @ w * sy + my)
            stds.append(spread * sy)
        np.testing.assert_allclose(mine["mean"], np.mean(means, 0), atol=1e-6)
        np.testing.assert_allclose(mine["std"], np.sqrt(np.var(means, 0) + np.mean(np.square(stds), 0)), atol=1e-6)
    assert abs(np.concatenate(list(weights.values()))[:, 1:].mean() - 1) < 0.15


def test_an_empty_replica_is_the_whole_sample(spark):
    rows = [("c", 0, [0.0], 1.0), ("c", 1, [1.0], 3.0)]
    two = spark.createDataFrame(rows, "campaign string, point_id long, x array<double>, y double")
    state = ks.campaign_state(two, KEYS, m=2, replicas=30).first()
    bags = ks.bag_weights(30, KEYS, "point_id", 42)
    drawn = [r["w"] for r in two.select(bags.alias("w")).collect()]
    empty = [r for r in range(31) if not sum(d[r] for d in drawn)]
    assert empty and all(state["y_mean"][r] == 2.0 for r in empty)


def test_rounds_end_at_the_target_or_the_cap(spark, pool):
    known = pool.where("point_id < 12")
    caps = spark.createDataFrame([("a", 1)], "campaign string, cap int")
    picks, states = stateful.play(pool, known, stateful.KernelImprovement(KEYS, m=10, refit_every=4), KEYS, 6, caps)
    played = picks.groupBy("campaign").agg(F.max("step").alias("last"), F.collect_set("point_id").alias("all")).collect()
    played = {r["campaign"]: r for r in played}
    assert played["a"]["last"] == 0 and len(played["a"]["all"]) == 6
    target = int(Y["b"].argmax())
    assert target < 12 or target in played["b"]["all"]
    assert picks.groupBy("campaign", "point_id").count().where("count > 1").isEmpty()
    assert states.groupBy("campaign", "step").count().where("count > 1").isEmpty()


def test_subspace_rounds(pool):
    known = pool.where("point_id < 12 AND campaign = 'a'")
    strategy = stateful.AdaptiveSubspace(KEYS, m=20)
    picks, states = stateful.play(pool.where("campaign = 'a'"), known, strategy, KEYS, 2, 3)
    rows = {(r["campaign"], r["step"]): r for r in states.collect()}
    for c in ("a",):
        first = rows[c, 0]
        mean, std = X[c][:12].mean(0), X[c][:12].std(0)
        np.testing.assert_allclose(first["x_mean"], mean)
        u = (X[c][:12] - mean) / std
        corr = [abs(np.corrcoef(u[:, i], Y[c][:12])[0, 1]) for i in range(3)]
        relevance = 0.7 * np.array(corr) + 0.3 * u.var(0) / (u.var(0).max() + 1e-6)
        np.testing.assert_allclose(first["relevance"], relevance, atol=1e-9)
        np.testing.assert_allclose(np.linalg.norm(np.array(first["projection"]), axis=0), 1.0)
        assert first["dims"] == 1 and first["iteration"] == 1
        steps = [rows[c, s] for s in range(3) if (c, s) in rows]
        assert all(0.1 <= r["radius"] <= 1.0 for r in steps)
        assert all(r["projection"] == first["projection"] for r in steps)
        if len(steps) == 3:
            assert steps[2]["relevance"] != steps[1]["relevance"] != steps[0]["relevance"]


def test_noise_at_the_observations(pool):
    got = scoring.observation_noise(pool.where("point_id < 8"), KEYS, 10).toPandas()
    for c in X:
        x, y = X[c][:8], Y[c][:8]
        sigma = 1.4826 * np.median(np.abs(y - np.median(y))) + 1e-9
        mine = got[got.campaign == c].sort_values("point_id")["noise_var"]
        for i, value in enumerate(mine):
            near = np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:7]
            assert value == pytest.approx(max(y[near].var(), 0.1 * sigma**2) + 1e-9)


def test_precision_weights(pool):
    observed = pool.where("point_id < 15")
    noise = observed.select("campaign", "point_id", (F.col("point_id") * 0.01).alias("noise_var"))
    for row in ks.precision_state(observed, noise, KEYS, m=5).collect():
        c, rows = row["campaign"], np.arange(15)
        w = 0.1 / (0.1 + rows * 0.01 / Y[c][:15].var())
        np.testing.assert_allclose(row["w"][0], fit(c, rows, *basis(row), w)[0], atol=1e-7)


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_design_vectors(spark, order):
    from itertools import combinations_with_replacement

    x = [2.0, -3.0, 0.5]
    got = spark.createDataFrame([(x,)], "x array<double>").select(surfaces.design_vector(F.col("x"), order)).first()[0]
    want = [math.prod(x[i] for i in t) for k in range(order + 1) for t in combinations_with_replacement(range(3), k)]
    assert got == pytest.approx(want)


def test_surfaces_and_leverage_of_second_order(pool):
    observed, hidden = pool.where("point_id < 25"), pool.where("point_id >= 25")
    got = protocols.polynomial_value(KEYS)(hidden, observed).toPandas()
    gain = scoring.d_optimal(observed, hidden, KEYS, order=2).toPandas()
    for c in X:
        def terms(x):
            one = [np.ones(len(x))] + [x[:, i] for i in range(3)]
            return np.stack(one + [x[:, i] * x[:, j] for i in range(3) for j in range(i, 3)], 1)

        v, w = terms(X[c][:25]), terms(X[c][25:])
        coef = np.linalg.lstsq(v, Y[c][:25], rcond=None)[0]
        mine = got[got.campaign == c].sort_values("point_id")
        np.testing.assert_allclose(mine["score"], w @ coef, rtol=1e-6, atol=1e-6)
        mine = gain[gain.campaign == c].sort_values("point_id")
        base = np.linalg.slogdet(v.T @ v)[1]
        for score, row in zip(mine["score"], w):
            assert np.log1p(score) == pytest.approx(np.linalg.slogdet(v.T @ v + np.outer(row, row))[1] - base, abs=1e-6)


def test_surface_with_fewer_points_than_terms(pool):
    few, rest = pool.where("point_id < 4"), pool.where("point_id >= 4")
    got = protocols.polynomial_value(KEYS)(rest, few)
    assert got.where("score IS NULL OR isnan(score)").isEmpty()
    assert protocols.polynomial_value(KEYS)(few, few).where("abs(score - y) > 1e-4").isEmpty()
