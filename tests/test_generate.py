import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrial.functions.hashing import hash_int, hash_normal, py_hash_int, py_normal
from fieldtrial.operators import generate, selection, stats
from fieldtrial.plans import rounds

KEYS = ["campaign"]


@pytest.fixture(scope="module")
def pool(spark):
    """Two campaigns, one far larger; several points share the largest label."""
    a = spark.range(900).select(F.lit("big").alias("campaign"), F.col("id").alias("point_id"))
    b = spark.range(40).select(F.lit("small").alias("campaign"), F.col("id").alias("point_id"))
    return a.union(b).select(
        "*",
        F.array(F.col("point_id") / 10, (F.col("point_id") % 7).cast("double")).alias("x"),
        (F.col("point_id") % 20).cast("double").alias("y"),
    )


def test_driver_and_column_hashes_agree(spark):
    row = spark.range(1).select(hash_int("a", "b", "3").alias("h"), hash_normal("a", "b").alias("z")).first()
    assert row["h"] == py_hash_int("a", "b", 3) and row["z"] == pytest.approx(py_normal("a", "b"))


def test_latin_hypercube_fills_every_stratum(pool):
    unit = generate.latin_hypercube(pool, KEYS, "point_id", 3, 1).toPandas()
    for _, part in unit.groupby("campaign"):
        u = np.stack(part["u"])
        n = len(u)
        for j in range(3):
            assert sorted(np.floor(u[:, j] * n).astype(int)) == list(range(n))


def test_hide_split_counts_and_target(pool):
    out = generate.hide_split(pool, KEYS, 0.95, 7).toPandas()
    for name, n in (("big", 900), ("small", 40)):
        part = out[out.campaign == name]
        assert part["hidden"].sum() == int(n * 0.95)
        target = part[part.is_target]
        assert target["point_id"].tolist() == [19] and target["hidden"].all()
    tiny = generate.hide_split(pool, KEYS, 0.0, 7).where("hidden").collect()
    assert sorted(r["point_id"] for r in tiny) == [19, 19]


def test_points_stay_in_bounds(pool):
    limits = stats.bounds(pool, KEYS)
    uniform = generate.uniform_points(limits, KEYS, F.lit(200), 2, 5)
    near = generate.manifold_pool(pool, KEYS, "point_id", F.lit(150), 2, 5)
    for df, n in ((uniform, 200), (near, 150)):
        rows = df.join(limits, KEYS).toPandas()
        assert rows.groupby("campaign").size().tolist() == [n, n]
        x, low, high = (np.stack(rows[c]) for c in ("x", "low", "high"))
        assert (x >= low).all() and (x <= high).all()


def test_result_does_not_depend_on_partitions(pool):
    def drawn(df):
        out = generate.manifold_pool(df, KEYS, "point_id", F.lit(60), 2, 5)
        return np.stack(out.orderBy("campaign", "point_id").toPandas()["x"])

    np.testing.assert_allclose(drawn(pool), drawn(pool.repartition(13)), rtol=1e-12)


def test_subsample(spark):
    assert generate.subsample(spark.range(1501), "id", 1, 600).count() == 600
    assert generate.subsample(spark.range(500), "id", 1, 600).count() == 500


def test_seeds(spark):
    rows = generate.campaigns(spark.createDataFrame([("d",)], "dataset string"), 10, 3).collect()
    assert len(rows) == 30 and len({r["competition_seed"] for r in rows}) == 30
    first = next(r for r in rows if r["pool"] == 2 and r["competition"] == 1)
    synth = py_hash_int("synth_2") % 100_000
    assert first["pool_seed"] == 42 + 200_000 + synth
    assert first["competition_seed"] == 42 + synth + 10_000 + py_hash_int("comp_1") % 10_000


def test_synthetic_range(spark):
    df = generate.synthetic_dataset(spark.range(300), "id", 5, noise=0.0).toPandas()
    assert df["y"].min() == 0 and df["y"].max() == pytest.approx(10) and (df["y_var"] == 0).all()


def test_sanitize_fills_and_keeps_order(spark):
    hidden = spark.createDataFrame([("c", i) for i in range(6)], "campaign string, point_id long")
    asked = spark.createDataFrame(
        [("c", 4, 0), ("c", 4, 1), ("c", 99, 2), ("c", 1, 3)], "campaign string, point_id long, position int"
    )
    got = selection.sanitize_batch(asked, hidden, KEYS, 4, 1).orderBy("batch_position").collect()
    assert [r["point_id"] for r in got][:2] == [4, 1] and len({r["point_id"] for r in got}) == 4
    assert [r["is_fill"] for r in got] == [False, False, True, True]
    assert selection.sanitize_batch(asked, hidden, KEYS, 50, 1).count() == 6


def by_id(hidden, observed):
    return hidden.withColumn("score", -F.col("point_id").cast("double"))


def test_rounds_stop_at_the_target(pool):
    revealed = pool.where("point_id in (0, 1)")
    history = rounds.run_rounds(pool, revealed, by_id, KEYS, batch=4, cap=50)
    rows = history.orderBy("campaign", "step", "batch_position").collect()
    for name in ("big", "small"):
        mine = [r for r in rows if r["campaign"] == name]
        # Points 2 .. 21 in five rounds of four; the target is 19.
        assert [r["point_id"] for r in mine] == list(range(2, 22))
        assert mine[0]["current_best"] == 1.0 and mine[-1]["current_best"] == 17.0
        assert mine[0]["hidden_remaining"] == (898 if name == "big" else 38)
    got = {r["campaign"]: r for r in rounds.outcomes(history, pool, KEYS).collect()}
    assert got["big"]["steps_to_target"] == 5 and got["big"]["found_target"]
    assert got["small"]["final_best"] == 19.0


def test_rounds_respect_the_cap(pool):
    history = rounds.run_rounds(pool, pool.where("point_id = 0"), by_id, KEYS, batch=1, cap=3)
    got = rounds.outcomes(history, pool, KEYS).collect()
    assert {r["steps_to_target"] for r in got} == {3} and not any(r["found_target"] for r in got)
