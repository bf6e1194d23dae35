import math

import numpy as np
import pandas as pd
import pytest

from fieldtrial.functions.special import beta_cdf, beta_quantile, chi2_tail
from fieldtrial.operators import compare, stats


def frame(spark, values, datasets=None):
    rows = [
        ((datasets or {}).get(i, "d"), "Batch1", 0, o, i, float(v) if v is not None else None)
        for (i, o), v in values.items()
    ]
    return spark.createDataFrame(
        rows, "dataset string, batch string, competition_idx int, optimizer string, "
        "instance string, m double"
    )


TABLE = {
    ("i1", "a"): 1, ("i1", "b"): 2, ("i1", "c"): 3,
    ("i2", "a"): 1, ("i2", "b"): 3, ("i2", "c"): 2,
    ("i3", "a"): 2, ("i3", "b"): 2, ("i3", "c"): 5,
    ("i4", "a"): 4, ("i4", "b"): 6,
}


def test_ranks_share_ties_and_skip_nulls(spark):
    df = frame(spark, {**TABLE, ("i4", "c"): None})
    got = {(r["instance"], r["optimizer"]): r["rank"] for r in stats.instance_ranks(df, "m").collect()}
    assert got[("i3", "a")] == got[("i3", "b")] == 1.5
    assert got[("i3", "c")] == 3 and ("i4", "c") not in got and got[("i4", "b")] == 2


def test_friedman_by_hand(spark):
    # Complete blocks i1..i3, rank sums 3.5, 6.5, 8; one tie group of two.
    raw = 12 / (3 * 3 * 4) * (3.5**2 + 6.5**2 + 8**2) - 3 * 3 * 4
    expected = raw / (1 - 6 / (3 * 8 * 3))
    row = compare.friedman(frame(spark, TABLE), "m").first()
    assert (row["n_blocks"], row["n_treatments"]) == (3, 3)
    assert row["statistic"] == pytest.approx(expected)
    assert row["p_value"] == pytest.approx(math.exp(-expected / 2))


def test_friedman_needs_two_blocks_and_three_treatments(spark):
    one = {k: v for k, v in TABLE.items() if k[0] == "i1"}
    two = {k: v for k, v in TABLE.items() if k[1] != "c"}
    for values in (one, two, {}):
        row = compare.friedman(frame(spark, values), "m").first()
        assert row["statistic"] is None and row["p_value"] is None


def test_duplicates_are_averaged(spark):
    df = frame(spark, TABLE).unionByName(frame(spark, {("i1", "a"): 3}))
    got = {(r["optimizer_a"], r["optimizer_b"], r["instance"]): r["diff"]
           for r in compare.pair_diffs(df, "m").collect()}
    assert got[("a", "b", "i1")] == 0 and got[("a", "c", "i3")] == -3 and len(got) == 10


def test_chi_square_tail():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert chi2_tail(9.487729036781154, 4) == pytest.approx(0.05)
    assert chi2_tail(22.362032494826938, 13) == pytest.approx(0.05)


def test_beta_quantile_inverts():
    p = np.linspace(0.001, 0.999, 25)
    for a, b in ((1, 1), (3, 3), (50, 51), (5000, 5001)):
        np.testing.assert_allclose(beta_cdf(beta_quantile(p, a, b), a, b), p, atol=1e-10)


def test_sign_flip_extremes(spark):
    n = 40
    values = {(f"i{j}", o): (j % 7 + 5 if o == "b" else 0) for j in range(n) for o in "ab"}
    rows = compare.sign_flip_test(compare.pair_diffs(frame(spark, values), "m")).collect()
    assert rows[0]["p_value"] == 0.0
    same = {(f"i{j}", o): 1 for j in range(n) for o in "ab"}
    rows = compare.sign_flip_test(compare.pair_diffs(frame(spark, same), "m")).collect()
    assert rows[0]["p_value"] == 1.0


def test_sign_flip_agrees_with_exact_enumeration(spark):
    d = [3.0, -1.0, 2.0, 5.0, -2.0, 4.0, 1.0, 0.5]
    values = {}
    for j, v in enumerate(d):
        values[(f"i{j}", "a")], values[(f"i{j}", "b")] = v, 0.0
    signs = np.array(np.meshgrid(*[[-1, 1]] * len(d))).reshape(len(d), -1)
    exact = np.mean(np.abs(np.array(d) @ signs) >= abs(sum(d)) - 1e-12)
    got = compare.sign_flip_test(compare.pair_diffs(frame(spark, values), "m")).first()["p_value"]
    assert got == pytest.approx(exact, abs=0.05)


@pytest.mark.parametrize("n", [7, 60, 201])
def test_bootstrap_interval_matches_resampling(spark, n):
    rng = np.random.default_rng(n)
    d = rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame(
        {"optimizer_a": "a", "optimizer_b": "b", "instance": [str(i) for i in range(n)], "diff": d}))
    direct = np.median(d[rng.integers(0, n, size=(20000, n))], axis=1)
    for hot_rows in (10**6, 5):
        got = compare.bootstrap_medians(df, 1000, hot_rows).toPandas()["median"].to_numpy()
        assert len(got) == 1000
        spread = direct.std()
        for q in (0.1, 0.5, 0.9):
            assert abs(np.quantile(got, q) - np.quantile(direct, q)) < 0.35 * spread + 1e-9
    ci = compare.bootstrap_ci(df).first()
    assert ci["ci_lower"] <= np.median(d) <= ci["ci_upper"]


def test_holm_rule_and_null_last(spark):
    df = spark.createDataFrame(
        [("a", "b", 0.04), ("a", "c", 0.01), ("b", "c", None)],
        "optimizer_a string, optimizer_b string, p_value double",
    )
    got = {(r[0], r[1]): r["adjusted_p_value"] for r in compare.holm(df).collect()}
    assert got[("a", "c")] == pytest.approx(0.03) and got[("a", "b")] == pytest.approx(0.08)
    assert got[("b", "c")] is None
    crossed = spark.createDataFrame(
        [("a", "b", 0.03), ("a", "c", 0.02)], "optimizer_a string, optimizer_b string, p_value double"
    )
    plain = {r[1]: r["adjusted_p_value"] for r in compare.holm(crossed).collect()}
    running = {r[1]: r["adjusted_p_value"] for r in compare.holm(crossed, True).collect()}
    assert plain == {"c": 0.04, "b": 0.03} and running == {"c": 0.04, "b": 0.04}


def test_population_and_sample_deviation(spark):
    df = spark.createDataFrame(
        [("a", 1, True, 5.0), ("a", 3, False, float("nan"))],
        "optimizer string, steps_to_target int, found_target boolean, final_best double",
    )
    htl = stats.htl_stats(df).first()
    assert htl["std_steps"] == 1.0 and htl["success_rate"] == 0.5 and htl["mean_final_best"] == 5.0
    se = stats.mean_se(df, "steps_to_target").first()
    assert se["se"] == pytest.approx(math.sqrt(2) / math.sqrt(2))
    assert stats.mean_se(df.limit(1), "steps_to_target").first()["se"] == 0.0


def test_constant_prediction_scores(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "y double, p double")
    row = stats.regression_fit(df, "y", "p").first()
    assert row["mse"] == 1.0 and row["r2"] == 0.0
    flat = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y double, p double")
    assert stats.regression_fit(flat, "y", "p").first()["mse"] == 0.0


def test_wide_and_long_paths_agree(spark, monkeypatch):
    df = frame(spark, {**TABLE, ("i4", "c"): None, ("i5", "a"): 2, ("i5", "c"): 2}).unionByName(
        frame(spark, {("i1", "a"): 5})
    )

    def everything():
        return [
            sorted(map(tuple, part.collect()), key=str)
            for part in (
                stats.instance_ranks(df, "m"), stats.instance_ranks(df, "m", False),
                compare.complete_blocks(df, "m"), compare.friedman(df, "m"), compare.pair_diffs(df, "m"),
                stats.rank_optimizers(df, "m"),
            )
        ]

    wide = everything()
    monkeypatch.setattr(stats, "MAX_WIDE", 1)
    assert everything() == wide
