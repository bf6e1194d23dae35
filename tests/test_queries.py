"""A sample of the registered queries against DuckDB; ``tests/oracle.py`` runs all of them."""

import pytest
from oracle import connect, differences

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "w2_rank_optimizers", "a1_summary_stats", "t2_friedman", "t4_sign_flip_test", "t5_median_diff",
    "s4_parse_results", "w4_mean_trajectory", "g4_latin_hypercube", "g7_hide_split", "j6_knn",
    "w9_steps_design", "m13_noise_aware_ei", "m23_run_rounds", "p15_extract_tm",
    "a16_combine_texts", "stream_running_totals",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    assert differences(df, connect(SF), entry.oracle_sql()[name]) == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 5


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
