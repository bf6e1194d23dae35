"""Inputs at the edge: weights of zero, equal orders, empty layouts, cells written again, large batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrial.functions.special import beta_cdf, beta_quantile
from fieldtrial.operators import compare, curation, designs, selection, stats
from fieldtrial.sources import results


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_weighted_combine_ignores_weight_zero(spark, hot_rows):
    rows = [("a", 5.0, 2), ("a", 100.0, 0), ("b", 1.0, 1), ("b", 2.0, 1), ("b", 9.0, 2), ("c", 3.5, 3), ("c", 3.25, 2)]
    df = spark.createDataFrame(rows, "optimizer string, mean_steps double, n_competitions long")
    df = df.withColumn("success_rate", F.lit(1.0)).withColumn("mean_final_best", F.lit(1.0))
    got = {r.optimizer: (r.median_steps, r.min_steps, r.max_steps) for r in stats.htl_combined(df, hot_rows).collect()}
    assert got == {"a": (5.0, 5.0, 5.0), "b": (5.5, 1.0, 9.0), "c": (3.5, 3.25, 3.5)}


@pytest.mark.parametrize("chunk", [None, 1000])
def test_combine_texts_of_equal_order(spark, chunk):
    files = spark.createDataFrame([("k", 1, "bb", "f2"), ("k", 1, "aa", "f1"), ("k", 0, "z", "f9")], "k string, n int, t string, f string")
    got = curation.combine_texts(files, "k", "n", "t", "f", chunk).collect()
    assert [(r.key, r.text, r.file_names) for r in got] == [("k", "z\naa\nbb\n", "f9; f1; f2")]


def test_empty_layout_is_passed_over(spark):
    text = '{"tournament_results": [], "competitions": [{"optimizer_results": {"A": {"final_best": 2.0}}}]}'
    files = spark.createDataFrame([("x_Batch1.json", text)], "path string, text string")
    assert [(r.optimizer, r.final_best) for r in results.parse_results(files).collect()] == [("A", 2.0)]


def test_cell_written_again_replaces(spark, tmp_path):
    cells = spark.createDataFrame([("c1", "d1", 1), ("c1", "d2", 2)], "combo string, dataset string, v int")
    results.write_cells(cells, f"{tmp_path}/cells")
    results.write_cells(cells.where("dataset = 'd2'").withColumn("v", F.lit(7)), f"{tmp_path}/cells")
    got = spark.read.json(f"{tmp_path}/cells").orderBy("dataset").collect()
    assert [(r.dataset, r.v) for r in got] == [("d1", 1), ("d2", 7)]


def test_large_batch_equals_the_plain_sort(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("c"), F.col("id").alias("point_id"), F.pmod(F.xxhash64("id"), F.lit(500)).cast("double").alias("score"))
    got = {(r.c, r.point_id): r.batch_position for r in selection.select_batch(df, ["c"], 2000).collect()}
    rows = df.collect()
    for c in (0, 1):
        order = sorted((r for r in rows if r.c == c), key=lambda r: (-r.score, r.point_id))[:2000]
        assert [got[(c, r.point_id)] for r in order] == list(range(1, 2001))
    assert len(got) == 4000


def test_many_pairs_are_flushed(spark, monkeypatch):
    diffs = spark.range(300).select(
        F.concat(F.lit("a"), (F.col("id") % 40).cast("string")).alias("optimizer_a"), F.lit("z").alias("optimizer_b"),
        F.col("id").cast("string").alias("instance"), (F.col("id") % 7 - 3.0).alias("diff"))
    whole = sorted(map(tuple, compare.sign_flip_test(diffs, 200).collect()))
    monkeypatch.setattr(compare, "PAIRS_HELD", 3)
    assert sorted(map(tuple, compare.sign_flip_test(diffs, 200).collect())) == whole


def test_one_draw_rule_for_every_size():
    p = np.array([0.01, 0.3, 0.5, 0.9])
    for n in (15, 25_001, 10_000_001):
        m = (n + 1) // 2
        x = beta_quantile(p, m, n - m + 1)
        np.testing.assert_allclose(beta_cdf(x, m, n - m + 1), p, atol=1e-5)


def test_twelve_factors(spark):
    limits = spark.createDataFrame([("c", [0.0] * 12, [2.0] * 12)], "campaign string, low array<double>, high array<double>")
    runs = designs.full_factorial(limits, ["campaign"], 12, 2).collect()
    assert len({tuple(r.x) for r in runs}) == 4096 and {len(r.x) for r in runs} == {12}
    assert designs.central_composite(limits, ["campaign"], 12).count() == 4096 + 25
    assert designs.fractional_factorial(limits, ["campaign"], 12, 2).count() == 2048
    assert designs.fractional_factorial(limits, ["campaign"], 12, 2, max_runs=99).count() == 99
    with pytest.raises(ValueError):
        designs.full_factorial(limits, ["campaign"], 64, 3)


def test_a_missed_bracket_is_solved_again(spark, monkeypatch):
    from fieldtrial.operators import exact

    def misses(data, keys, narrow, hot):
        return data.join(narrow, list(keys)).where("_v < 100")

    df = spark.range(1000).select(F.lit("g").alias("k"), F.col("id").cast("double").alias("v"))
    monkeypatch.setattr(exact, "_bracketed", misses)
    got = exact.exact_quantiles(df, ["k"], "v", {"low": 0.05, "high": 0.9}, hot_rows=10).first()
    assert got.low == pytest.approx(49.95) and got.high == pytest.approx(899.1)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("bound", [0, 1 << 24])
def test_hot_keys_with_values_of_any_size(spark, monkeypatch, how, bound):
    from fieldtrial import session

    monkeypatch.setattr(session, "BROADCAST_BYTES", bound)
    rows = [("hot", k) for k in range(200)] + [(f"k{k}", k) for k in range(40)]
    side = [("hot", "value"), *[(f"k{k}", f"v{k}") for k in range(0, 60, 2)]]
    df = spark.createDataFrame(rows, "key string, n long")
    small = spark.createDataFrame(side, "key string, value string")
    got = session.join_small(df, small, "key", how, max_rows=1, hot_rows=50).collect()
    assert sorted(map(str, got)) == sorted(map(str, df.join(small, "key", how).collect()))
