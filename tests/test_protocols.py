import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrial.operators import stats
from fieldtrial.operators.campaign_models import campaign_posterior
from fieldtrial.operators.models import rbf
from fieldtrial.plans import protocols

KEYS = ["campaign"]
RNG = np.random.default_rng(11)
X = {"a": RNG.normal(size=(60, 2)), "b": RNG.normal(size=(25, 2))}


@pytest.fixture(scope="module")
def pool(spark):
    rows = [
        (c, i, [float(v) for v in p], float(np.exp(-((p - 0.3) ** 2).sum())))
        for c, x in X.items() for i, p in enumerate(x)
    ]
    return spark.createDataFrame(rows, "campaign string, point_id long, x array<double>, y double")


def test_posterior_is_fitted_per_campaign(pool):
    got = campaign_posterior(pool.where("point_id < 20"), pool, KEYS, m=50).toPandas()
    labels = pool.toPandas().sort_values("point_id")
    for c, x in X.items():
        mine = got[got.campaign == c].sort_values("point_id")
        target = labels.loc[labels.campaign == c, "y"].to_numpy()[:20]
        x = (x - x[:20].mean(0)) / x[:20].std(0)
        obs, k = x[:20], rbf(x, x[:20])
        kmm = rbf(obs, obs) + 1e-6 * np.eye(20)
        unit = (target - target.mean()) / target.std()
        w = np.linalg.solve(rbf(obs, obs) @ rbf(obs, obs) + 0.1 * kmm, rbf(obs, obs) @ unit)
        np.testing.assert_allclose(mine["mean"], k @ w * target.std() + target.mean(), atol=1e-5)
        var = np.maximum(1 - (k * (k @ np.linalg.inv(kmm))).sum(1) + 0.1, 1e-6)
        np.testing.assert_allclose(mine["std"], np.sqrt(var) * target.std(), atol=1e-4)


def test_scoring_strategy_finds_every_target(pool):
    got = protocols.hide_the_label(pool, protocols.gp_ei(KEYS, m=20), KEYS, 0.8, batch=8, cap=8).collect()
    assert len(got) == 2 and all(r["found_target"] for r in got)
    assert all(1 <= r["steps_to_target"] <= 6 for r in got)


@pytest.mark.parametrize("name", ["RANDOM", "FULL_FACTORIAL", "PLACKETT_BURMAN", "LATIN_HYPERCUBE"])
def test_fixed_orders_reach_the_target(pool, name):
    got = protocols.hide_the_label_order(pool, name, KEYS, 2, 0.8, batch=4).collect()
    assert {r["campaign"] for r in got} == {"a", "b"}
    for r in got:
        hidden = int(len(X[r["campaign"]]) * 0.8)
        assert 1 <= r["position"] <= hidden and r["steps_to_target"] == -(-r["position"] // 4)


def test_open_race_spends_its_budget(spark, pool):
    limits = stats.bounds(pool, KEYS)

    def evaluate(df):
        return df.withColumn("y", -F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))

    def by_value(hidden, observed):
        return hidden.withColumn("score", F.aggregate("x", F.lit(0.0), lambda a, v: a - v * v))

    got = protocols.open_race(limits, evaluate, by_value, KEYS, 2, budget=15, initial=5, batch=4).toPandas()
    for _, part in got.groupby("campaign"):
        part = part.sort_values("step")
        assert part["evaluations"].tolist() == [5, 9, 13, 15]
        assert part["best_value_so_far"].is_monotonic_increasing
        assert part["best_value_so_far"].iloc[-1] > -0.05


def test_used_up_candidates_are_replaced(spark):
    from fieldtrial.operators.neighbours import top_up

    limits = spark.createDataFrame([("c", [0.0], [1.0])], "campaign string, low array<double>, high array<double>")
    none = spark.createDataFrame([], "campaign string, point_id long, x array<double>")
    history = spark.createDataFrame([("c", 1, [0.5])], none.schema)
    assert top_up(none, history, limits, KEYS, 30, 1, 1).count() == 30
