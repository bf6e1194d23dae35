import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldtrial.operators import exact

RNG = np.random.default_rng(1)


@pytest.fixture(scope="module")
def skewed(spark):
    """Group a holds most rows, and one value most of those."""
    values = np.concatenate([np.full(4000, 7.0), RNG.normal(size=3001)])
    rows = pd.DataFrame({"g": ["a"] * 7001 + ["b"] * 40 + ["c"], "v": np.concatenate(
        [values, RNG.normal(size=40), [3.5]])})
    return spark.createDataFrame(rows), rows


@pytest.mark.parametrize("hot_rows", [10**6, 100, 10])
def test_quantiles_agree_with_numpy_on_every_path(skewed, hot_rows):
    df, rows = skewed
    probs = {"low": 0.025, "mid": 0.5, "high": 0.975}
    got = exact.agg_with_quantiles(
        df, ["g"], "v", probs, [F.count("v").alias("n")], hot_rows
    ).toPandas().set_index("g")
    for g, part in rows.groupby("g"):
        assert got.loc[g, "n"] == len(part)
        for name, p in probs.items():
            assert got.loc[g, name] == pytest.approx(np.quantile(part["v"], p), abs=1e-12)


def test_quantiles_without_keys(skewed):
    df, rows = skewed
    for hot_rows in (10**6, 10):
        got = exact.agg_with_quantiles(df, [], "v", {"m": 0.3}, (), hot_rows).first()
        assert got["m"] == pytest.approx(np.quantile(rows["v"], 0.3), abs=1e-12)


def test_order_statistics_return_each_position(spark, skewed):
    df, rows = skewed
    targets = spark.createDataFrame(
        [("a", 7001, "s", [0, 10, 3500, 7000])], "g string, _n bigint, slot string, positions array<bigint>"
    )
    expected = np.sort(rows.loc[rows.g == "a", "v"])
    for hot_rows in (10**6, 10):
        got = exact.order_statistics(df, ["g"], "v", targets, hot_rows).toPandas()
        found = dict(zip(got["position"], got["value"]))
        assert found == {p: expected[p] for p in (0, 10, 3500, 7000)}


def test_row_number_over_blocks(spark):
    df = spark.range(5000).select(
        F.col("id"), (F.col("id") % 3).alias("k"),
        F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long").alias("h"),
    )
    got = exact.hash_row_number(df, ["k"], "h", ["id"], "rn").toPandas()
    for _, part in got.groupby("k"):
        ordered = part.sort_values(["h", "id"])
        assert ordered["rn"].tolist() == list(range(1, len(part) + 1))


@pytest.mark.parametrize("block_size", [1, 7, 1000])
@pytest.mark.parametrize("current", [True, False])
def test_running_values_do_not_depend_on_the_block(spark, block_size, current):
    rows = pd.DataFrame({"k": ["x"] * 30 + ["y"] * 5, "t": [*range(30), 0, 9, 10, 11, 50],
                         "v": RNG.normal(size=35)})
    got = exact.running(
        spark.createDataFrame(rows), ["k"], "t", {"m": ("max", "v"), "s": ("sum", "v")},
        block_size, current,
    ).toPandas()
    for k, part in rows.groupby("k"):
        mine = got[got.k == k].sort_values("t")
        top, acc = part["v"].cummax(), part["v"].cumsum()
        if not current:
            top, acc = top.shift(), acc.shift()
        np.testing.assert_allclose(mine["m"].to_numpy(float), top.to_numpy())
        np.testing.assert_allclose(mine["s"].to_numpy(float), acc.to_numpy())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_small_side_join_is_the_same_on_every_path(spark, how):
    from fieldtrial.session import join_small

    rows = [("hot", i) for i in range(50)] + [(f"k{i}", i) for i in range(10)] + [(None, -1)]
    df = spark.createDataFrame(rows, "k string, v int")
    small = spark.createDataFrame([("hot", 1.0), ("k1", 2.0), ("k2", 3.0)], "k string, w double")
    expected = sorted(df.join(small, ["k"], how).collect(), key=str)
    for limits in ({}, {"max_rows": 1}, {"max_rows": 1, "hot_rows": 5}):
        assert sorted(join_small(df, small, "k", how, **limits).collect(), key=str) == expected
