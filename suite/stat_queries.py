"""Summary, ranking and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrial.operators import compare, stats

from .inputs import BLOCKS, MEANS, POOL, RESULTS, VECTORS, pool, results, rounded, vectors
from .registry import query, s_u_open

RANKED = """ranked AS (
  SELECT *, rank() OVER (PARTITION BY instance ORDER BY value {direction})
            + (count(*) OVER (PARTITION BY instance, value) - 1) / 2.0::DOUBLE AS r,
         count(*) OVER (PARTITION BY instance, value) AS same
  FROM {source})"""


@query(
    "w2_rank_optimizers",
    f"""WITH {RESULTS}, {MEANS}, {RANKED.format(direction="DESC", source="means")},
    a AS (SELECT optimizer, avg(r) AS average_rank FROM ranked GROUP BY 1)
    SELECT optimizer, round(average_rank, 6) AS average_rank,
           CAST(row_number() OVER (ORDER BY round(average_rank, 9), optimizer) AS INTEGER)
             AS rank_position FROM a""",
)
def w2(spark, sf):
    return rounded(stats.rank_optimizers(results(spark, sf), "final_best", ascending=False))


@query(
    "w1_instance_ranks",
    f"""WITH {RESULTS}, {MEANS}, {RANKED.format(direction="DESC", source="means")}
    SELECT instance, optimizer, round(value, 6) AS value, r AS rank FROM ranked""",
)
def w1(spark, sf):
    return rounded(stats.instance_ranks(results(spark, sf), "final_best", ascending=False))


SUMMARY_SQL = """SELECT optimizer, round(avg(final_best), 4) AS mean,
           round(median(final_best), 4) AS median, round(stddev_samp(final_best), 4) AS std,
           round(min(final_best), 4) AS min, round(max(final_best), 4) AS max,
           count(final_best) AS count FROM results GROUP BY optimizer"""


@query("a1_summary_stats", f"WITH {RESULTS} {SUMMARY_SQL}")
def a1(spark, sf):
    return stats.summary_stats(results(spark, sf), "final_best")


@query(
    "a2_dataset_level",
    f"""WITH {RESULTS} SELECT dataset, optimizer, round(median(final_best), 6) AS final_best,
    dataset AS instance FROM results GROUP BY dataset, optimizer""",
)
def a2(spark, sf):
    return rounded(stats.dataset_level(results(spark, sf), "final_best"))


HTL_COLUMNS = """round(avg(steps_to_target), 6) AS mean_steps,
    round(stddev_pop(steps_to_target), 6) AS std_steps, min(steps_to_target) AS min_steps,
    max(steps_to_target) AS max_steps,
    round(avg(CASE WHEN found_target THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS success_rate,
    round(avg(final_best), 6) AS mean_final_best,
    round(stddev_pop(final_best), 6) AS std_final_best, count(*) AS n_competitions,
    median(steps_to_target) AS median_steps"""


@query(
    "a3_htl_stats",
    f"WITH {RESULTS} SELECT optimizer, {HTL_COLUMNS} FROM results GROUP BY optimizer",
)
def a3(spark, sf):
    return rounded(stats.htl_stats(results(spark, sf)))


POOL_STATS = """pool_stats AS (
  SELECT pool, optimizer, avg(steps_to_target) AS mean_steps, count(*) AS n_competitions,
         avg(CASE WHEN found_target THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS success_rate,
         avg(final_best) AS mean_final_best FROM results GROUP BY 1, 2)"""


@query(
    "a4_htl_across_pools",
    f"""WITH {RESULTS}, {POOL_STATS} SELECT optimizer, round(avg(mean_steps), 6) AS avg_steps,
    round(stddev_pop(mean_steps), 6) AS std_steps, round(avg(success_rate), 6) AS avg_success,
    round(avg(mean_final_best), 6) AS avg_final_best FROM pool_stats GROUP BY optimizer""",
)
def a4(spark, sf):
    per_pool = stats.htl_stats(results(spark, sf), ["pool", "optimizer"])
    return rounded(stats.htl_across_pools(per_pool))


@query(
    "a5_htl_combined",
    f"""WITH {RESULTS}, {POOL_STATS},
    repeated AS (SELECT * FROM pool_stats, LATERAL (SELECT unnest(range(n_competitions))))
    SELECT optimizer, round(avg(mean_steps), 6) AS mean_steps,
    round(stddev_pop(mean_steps), 6) AS std_steps, round(median(mean_steps), 6) AS median_steps,
    round(min(mean_steps), 6) AS min_steps, round(max(mean_steps), 6) AS max_steps,
    round(avg(success_rate), 6) AS success_rate, round(avg(mean_final_best), 6) AS mean_final_best,
    round(stddev_pop(mean_final_best), 6) AS std_final_best FROM repeated GROUP BY optimizer""",
)
def a5(spark, sf):
    per_pool = stats.htl_stats(results(spark, sf), ["pool", "optimizer"])
    return rounded(stats.htl_combined(per_pool))


OR_SQL = """SELECT optimizer, round(avg(final_best), 6) AS mean_best_value,
    round(stddev_pop(final_best), 6) AS std_best_value, min(final_best) AS min_best_value,
    max(final_best) AS max_best_value, count(final_best) AS n_competitions,
    round(median(final_best), 6) AS median_best_value FROM results GROUP BY optimizer"""


def _open_race(spark, sf):
    return results(spark, sf).withColumnRenamed("final_best", "best_value")


@query("a6_or_stats", f"WITH {RESULTS} {OR_SQL}")
def a6(spark, sf):
    return rounded(stats.or_stats(_open_race(spark, sf)))


@query(
    "a6_all_best_values",
    f"WITH {RESULTS} SELECT optimizer, instance, final_best AS best_value FROM results",
)
def a6_values(spark, sf):
    return stats.all_best_values(_open_race(spark, sf))


@query(
    "a7_mean_se",
    f"""WITH {RESULTS} SELECT optimizer, round(avg(steps_to_target), 6) AS mean,
    round(coalesce(stddev_samp(steps_to_target) / sqrt(count(*)), 0), 6) AS se, count(*) AS n
    FROM results GROUP BY optimizer""",
)
def a7(spark, sf):
    return rounded(stats.mean_se(results(spark, sf), "steps_to_target"))


@query(
    "a8_se_from_summary",
    f"""WITH {RESULTS} SELECT pool, optimizer, round(stddev_pop(steps_to_target), 6) AS std_steps,
    count(*) AS n, round(stddev_pop(steps_to_target) / sqrt(count(*)), 6) AS se
    FROM results GROUP BY pool, optimizer""",
)
def a8(spark, sf):
    stored = results(spark, sf).groupBy("pool", "optimizer").agg(
        F.stddev_pop("steps_to_target").alias("std_steps"), F.count(F.lit(1)).alias("n")
    )
    return rounded(stats.se_from_summary(stored))


@query(
    "a10_dataset_info",
    f"""WITH {POOL} SELECT campaign, count(*) AS n_samples, 2 AS n_features,
    round(min(y), 9) AS y_min, round(max(y), 9) AS y_max, round(avg(y), 9) AS y_mean,
    round(stddev_pop(y), 9) AS y_std FROM pool GROUP BY campaign""",
)
def a10(spark, sf):
    return rounded(stats.dataset_info(pool(spark, sf), ["campaign"]), 9)


BOUNDS_SQL = """SELECT campaign, round(min(x1) - {p} * (max(x1) - min(x1)), 6) AS low_1,
    round(max(x1) + {p} * (max(x1) - min(x1)), 6) AS high_1,
    round(min(x2) - {p} * (max(x2) - min(x2)), 6) AS low_2,
    round(max(x2) + {p} * (max(x2) - min(x2)), 6) AS high_2 FROM pool GROUP BY campaign"""


def _flat_bounds(b):
    return rounded(
        b.select(
            "campaign",
            F.col("low")[0].alias("low_1"),
            F.col("high")[0].alias("high_1"),
            F.col("low")[1].alias("low_2"),
            F.col("high")[1].alias("high_2"),
        )
    )


@query("a11_bounds", f"WITH {POOL} {BOUNDS_SQL.format(p='0.0::DOUBLE')}")
def a11(spark, sf):
    return _flat_bounds(stats.bounds(pool(spark, sf), ["campaign"]))


@query("a11_bounds_padded", f"WITH {POOL} {BOUNDS_SQL.format(p='0.1::DOUBLE')}")
def a11_padded(spark, sf):
    return _flat_bounds(stats.bounds(pool(spark, sf), ["campaign"], pad=0.1))


@query(
    "a12_fingerprint",
    f"""WITH {POOL}, flat AS (SELECT campaign, unnest([x1, x2]) AS v FROM pool),
    fx AS (SELECT campaign, avg(v) a, stddev_pop(v) s, min(v) l, max(v) h FROM flat GROUP BY 1),
    fy AS (SELECT campaign, count(*) n, avg(y) a, stddev_pop(y) s, min(y) l, max(y) h
           FROM pool GROUP BY 1)
    SELECT campaign, md5(concat_ws('|', n, 2, {", ".join(
        f"printf('%.4f', {c})" for c in
        ("fx.a", "fx.s", "fx.l", "fx.h", "fy.a", "fy.s", "fy.l", "fy.h"))})) AS fingerprint
    FROM fx JOIN fy USING (campaign)""",
)
def a12(spark, sf):
    return stats.fingerprint(pool(spark, sf), ["campaign"], digits=4)


@query(
    "a18_load_report",
    f"""WITH {RESULTS} SELECT count(*) AS records, count(DISTINCT optimizer) AS optimizers,
    count(DISTINCT instance) AS instances, count(DISTINCT dataset) AS datasets,
    count(DISTINCT batch) AS batches FROM results""",
)
def a18(spark, sf):
    return stats.load_report(results(spark, sf))


MEMBERS = """members AS (
  SELECT l_partkey AS point_id, l_linenumber AS member, avg(l_extendedprice) AS mean,
         stddev_pop(l_extendedprice) AS std FROM lineitem GROUP BY 1, 2)"""


@query(
    "a19_ensemble_stats",
    f"""WITH {MEMBERS} SELECT point_id, round(avg(mean), 6) AS ensemble_mean,
    round(sqrt(avg(std * std) + var_pop(mean)), 6) AS ensemble_std FROM members GROUP BY 1""",
)
def a19(spark, sf):
    members = (
        spark.read.parquet(f"{sf}/lineitem.parquet")
        .groupBy(F.col("l_partkey").alias("point_id"), F.col("l_linenumber").alias("member"))
        .agg(F.avg("l_extendedprice").alias("mean"), F.stddev_pop("l_extendedprice").alias("std"))
    )
    return rounded(stats.ensemble_stats(members, ["point_id"]), 6)


@query(
    "j2_join_rank",
    f"""WITH {RESULTS}, {MEANS}, {RANKED.format(direction="DESC", source="means")},
    a AS (SELECT optimizer, avg(r) AS average_rank FROM ranked GROUP BY 1),
    s AS ({SUMMARY_SQL})
    SELECT s.*, round(average_rank, 6) AS average_rank,
           CAST(row_number() OVER (ORDER BY round(average_rank, 9), s.optimizer) AS INTEGER)
             AS rank_position FROM s JOIN a ON s.optimizer = a.optimizer""",
)
def j2(spark, sf):
    r = results(spark, sf)
    return rounded(
        stats.join_rank(
            stats.summary_stats(r, "final_best"),
            stats.rank_optimizers(r, "final_best", ascending=False),
            how="inner",
        )
    )


@query(
    "w11_leaderboard",
    f"""WITH {RESULTS} SELECT optimizer, round(avg(steps_to_target), 6) AS mean,
    round(coalesce(stddev_samp(steps_to_target) / sqrt(count(*)), 0), 6) AS se, count(*) AS n
    FROM results GROUP BY optimizer ORDER BY 2, 1""",
)
def w11(spark, sf):
    return rounded(
        stats.leaderboard(stats.mean_se(results(spark, sf), "steps_to_target"), "mean", True)
    )


@query(
    "t1_complete_blocks",
    f"""WITH {RESULTS}, {MEANS}, {BLOCKS}
    SELECT instance, optimizer, round(value, 6) AS value FROM blocks""",
)
def t1(spark, sf):
    return rounded(compare.complete_blocks(results(spark, sf), "final_best"))


# Five treatments give four degrees of freedom, for which the chi-square tail is closed.
FRIEDMAN = """, sums AS (
  SELECT optimizer, sum(r) AS rs, count(*) AS n, sum(same * same - 1) AS ties
  FROM ranked GROUP BY 1),
one AS (SELECT CAST(max(n) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS k, sum(rs * rs) AS ss,
        CAST(sum(ties) AS DOUBLE) AS ties FROM sums),
f AS (SELECT n, k, (12 / (k * n * (k + 1)) * ss - 3 * n * (k + 1))
             / (1 - ties / (k * (k * k - 1) * n)) AS statistic FROM one)
SELECT CAST(n AS BIGINT) AS n_blocks, CAST(k AS BIGINT) AS n_treatments,
       round(statistic, 6) AS statistic,
       round(exp(-statistic / 2) * (1 + statistic / 2), 6) AS p_value{extra} FROM f"""


@query(
    "t2_friedman",
    f"""WITH {RESULTS}, {MEANS}, {BLOCKS}, {RANKED.format(direction="", source="blocks")}"""
    + FRIEDMAN.format(extra=""),
)
def t2(spark, sf):
    return rounded(compare.friedman(results(spark, sf), "final_best"))


DATASET_MEANS = """means AS (
  SELECT dataset AS instance, optimizer, median(final_best) AS value FROM results GROUP BY 1, 2)"""


@query(
    "t3_friedman_by_dataset",
    f"""WITH {RESULTS}, {DATASET_MEANS}, {BLOCKS}, {RANKED.format(direction="", source="blocks")}"""
    + FRIEDMAN.format(extra=""),
)
def t3(spark, sf):
    return rounded(compare.friedman_by_dataset(results(spark, sf), "final_best"))


@query(
    "t3_rankings_by_dataset",
    f"""WITH {RESULTS}, {DATASET_MEANS}, {RANKED.format(direction="DESC", source="means")},
    a AS (SELECT optimizer, avg(r) AS average_rank FROM ranked GROUP BY 1)
    SELECT optimizer, round(average_rank, 6) AS average_rank,
           CAST(row_number() OVER (ORDER BY round(average_rank, 9), optimizer) AS INTEGER)
             AS rank_position FROM a""",
)
def t3_ranks(spark, sf):
    return rounded(
        compare.rankings_by_dataset(results(spark, sf), "final_best", ascending=False)
    )


@query(
    "p23_friedman_verdict",
    f"""WITH {RESULTS}, {MEANS}, {BLOCKS}, {RANKED.format(direction="", source="blocks")}"""
    + FRIEDMAN.format(
        extra=""", CASE WHEN exp(-statistic / 2) * (1 + statistic / 2) < 0.05
        THEN 'Significant differences detected' ELSE 'No significant differences detected' END
        AS verdict"""
    ),
)
def p23(spark, sf):
    return rounded(compare.friedman_verdict(compare.friedman(results(spark, sf), "final_best")))


DIFFS = """diffs AS (
  SELECT a.optimizer AS optimizer_a, b.optimizer AS optimizer_b, a.instance,
         a.value - b.value AS diff
  FROM means a JOIN means b ON a.instance = b.instance AND a.optimizer < b.optimizer)"""


def _diffs(spark, sf):
    return compare.pair_diffs(results(spark, sf), "final_best")


@query(
    "j1_pair_diffs",
    f"""WITH {RESULTS}, {MEANS}, {DIFFS}
    SELECT optimizer_a, optimizer_b, instance, round(diff, 6) AS diff FROM diffs""",
)
def j1(spark, sf):
    return rounded(_diffs(spark, sf))


# Bit j of the sign of flip f = 128 * block + j is bit j of md5(instance | block).
FLIPS = """bits AS (
  SELECT DISTINCT instance, b, md5(concat_ws('|', instance, CAST(b AS VARCHAR))) AS h
  FROM diffs, (SELECT unnest(range(8)) AS b)),
digits AS (
  SELECT instance, b * 128 + d * 4 AS base,
         CAST(('0x' || substr(h, CAST(d + 1 AS BIGINT), 1)) AS INTEGER) AS v
  FROM bits, (SELECT unnest(range(32)) AS d)),
signs AS (
  SELECT instance, base + j AS flip, 2 * ((v >> CAST(3 - j AS INTEGER)) & 1) - 1 AS s
  FROM digits, (SELECT unnest(range(4)) AS j) WHERE base + j < 1000),
nulls AS (
  SELECT optimizer_a, optimizer_b, flip, sum(diff * s) AS t, sum(diff) AS o
  FROM diffs JOIN signs USING (instance) GROUP BY 1, 2, 3),
flips AS (
  SELECT optimizer_a, optimizer_b,
         avg(CASE WHEN abs(t) >= abs(o) * (1 - 1e-9) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
           AS p_value
  FROM nulls GROUP BY 1, 2)"""


@query(
    "t4_sign_flip_test",
    f"""WITH {RESULTS}, {MEANS}, {DIFFS}, {FLIPS}
    SELECT optimizer_a, optimizer_b, round(p_value, 6) AS p_value FROM flips""",
)
def t4(spark, sf):
    return rounded(compare.sign_flip_test(_diffs(spark, sf)))


MEDIANS = """medians AS (
  SELECT optimizer_a, optimizer_b, median(diff) AS hl_median, count(*) AS n_instances
  FROM diffs GROUP BY 1, 2)"""


@query(
    "t5_median_diff",
    f"""WITH {RESULTS}, {MEANS}, {DIFFS}, {MEDIANS}
    SELECT optimizer_a, optimizer_b, round(hl_median, 6) AS hl_median FROM medians""",
)
def t5(spark, sf):
    return rounded(compare.median_diff(_diffs(spark, sf)))


# The position of a resample median is found by Newton steps on its exact distribution:
# P(m-th smallest of n uniform draws <= u) is a binomial tail. From the mode they never overshoot.
BOOT = f"""sizes AS (SELECT DISTINCT n_instances AS n, (n_instances + 1) // 2 AS m FROM medians),
tail_terms AS (
  SELECT n, m, lgamma(n + 1) - lgamma(m) - lgamma(n - m + 1) AS logd,
         list_transform(range(m, n + 1),
           lambda j: lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)) AS logc FROM sizes),
draws AS (
  SELECT r, {s_u_open("'boot'", "r", "'m'")} AS v, {s_u_open("'boot'", "r", "'next'")} AS w
  FROM (SELECT unnest(range(1000)) AS r)),
newton AS (
  SELECT n, r, 0 AS i, (m - 1) / (n - 1)::DOUBLE AS u FROM sizes, draws
  UNION ALL
  SELECT n, r, i + 1, u - (tail - v) / density
  FROM (
    SELECT b.n, b.r, b.i, b.u, d.v,
           exp(logd + (m - 1) * ln(u) + (b.n - m) * ln(1.0::DOUBLE - u)) AS density,
           list_sum(list_transform(logc, lambda c, k:
             exp(c + (m + k - 1) * ln(u) + (b.n - (m + k - 1)) * ln(1.0::DOUBLE - u)))) AS tail
    FROM newton b JOIN tail_terms t ON b.n = t.n JOIN draws d ON b.r = d.r WHERE i < 14)),
solved AS (SELECT n, r, u FROM newton WHERE i = 14),
positions AS (
  SELECT s.n, s.r, least(CAST(floor(s.n * u) AS BIGINT), s.n - 1) AS a,
         least(CAST(floor(s.n * CASE WHEN s.n % 2 = 1 THEN u
           ELSE 1.0::DOUBLE - (1.0::DOUBLE - u)
                * power(1.0::DOUBLE - w, 1.0::DOUBLE / (s.n - (s.n + 1) // 2)) END) AS BIGINT),
           s.n - 1) AS b
  FROM solved s JOIN draws USING (r)),
sorted AS (
  SELECT optimizer_a, optimizer_b, diff,
         row_number() OVER (PARTITION BY optimizer_a, optimizer_b ORDER BY diff) - 1 AS at,
         count(*) OVER (PARTITION BY optimizer_a, optimizer_b) AS n FROM diffs),
boot AS (
  SELECT x.optimizer_a, x.optimizer_b, p.r, (x.diff + y.diff) / 2 AS med
  FROM positions p JOIN sorted x ON x.n = p.n AND x.at = p.a
  JOIN sorted y ON y.optimizer_a = x.optimizer_a AND y.optimizer_b = x.optimizer_b
    AND y.at = p.b),
ci AS (
  SELECT optimizer_a, optimizer_b, quantile_cont(med, 0.025) AS ci_lower,
         quantile_cont(med, 0.975) AS ci_upper FROM boot GROUP BY 1, 2)"""


@query(
    "t6_bootstrap_ci",
    f"""WITH RECURSIVE {RESULTS}, {MEANS}, {DIFFS}, {MEDIANS}, {BOOT}
    SELECT optimizer_a, optimizer_b, round(ci_lower, 6) AS ci_lower,
           round(ci_upper, 6) AS ci_upper FROM ci""",
)
def t6(spark, sf):
    return rounded(compare.bootstrap_ci(_diffs(spark, sf)))


PAIRWISE = """pairs AS (
  SELECT optimizer_a, optimizer_b, hl_median, p_value, ci_lower, ci_upper, n_instances
  FROM medians JOIN flips USING (optimizer_a, optimizer_b)
  JOIN ci USING (optimizer_a, optimizer_b))"""
PAIR_COLUMNS = """optimizer_a, optimizer_b, round(hl_median, 6) AS hl_median,
    round(p_value, 6) AS p_value, round(ci_lower, 6) AS ci_lower,
    round(ci_upper, 6) AS ci_upper, n_instances"""
ALL_PAIRS = f"WITH RECURSIVE {RESULTS}, {MEANS}, {DIFFS}, {MEDIANS}, {FLIPS}, {BOOT}, {PAIRWISE}"


@query("t7_pairwise", f"{ALL_PAIRS} SELECT {PAIR_COLUMNS} FROM pairs")
def t7(spark, sf):
    return rounded(compare.pairwise(results(spark, sf), "final_best"))


HOLM = """least(p_value * (count(*) OVER () - row_number() OVER w + 1), 1.0::DOUBLE)"""


@query(
    "t8_holm",
    f"""WITH {RESULTS}, {MEANS}, {DIFFS}, {FLIPS}
    SELECT optimizer_a, optimizer_b, round(p_value, 6) AS p_value,
           round({HOLM}, 6) AS adjusted_p_value FROM flips
    WINDOW w AS (ORDER BY p_value, optimizer_a, optimizer_b)""",
)
def t8(spark, sf):
    return rounded(compare.holm(compare.sign_flip_test(_diffs(spark, sf))))


@query(
    "t8_holm_monotone",
    f"""WITH {RESULTS}, {MEANS}, {DIFFS}, {FLIPS},
    h AS (SELECT optimizer_a, optimizer_b, p_value, {HOLM} AS adjusted FROM flips
          WINDOW w AS (ORDER BY p_value, optimizer_a, optimizer_b))
    SELECT optimizer_a, optimizer_b, round(p_value, 6) AS p_value,
           round(max(adjusted) OVER (ORDER BY p_value, optimizer_a, optimizer_b
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS adjusted_p_value FROM h""",
)
def t8_monotone(spark, sf):
    return rounded(compare.holm(compare.sign_flip_test(_diffs(spark, sf)), monotone=True))


@query(
    "p23_mark_significant",
    f"""WITH {RESULTS}, {MEANS}, {DIFFS}, {FLIPS},
    h AS (SELECT optimizer_a, optimizer_b, p_value, {HOLM} AS adjusted_p_value FROM flips
          WINDOW w AS (ORDER BY p_value, optimizer_a, optimizer_b))
    SELECT optimizer_a, optimizer_b, round(p_value, 6) AS p_value,
           round(adjusted_p_value, 6) AS adjusted_p_value,
           CASE WHEN adjusted_p_value < 0.05 THEN '*' ELSE '' END AS significant FROM h""",
)
def p23_mark(spark, sf):
    adjusted = compare.holm(compare.sign_flip_test(_diffs(spark, sf)))
    return rounded(compare.mark_significant(adjusted))


@query(
    "w12_top_pairs",
    f"""WITH {RESULTS}, {MEANS}, {DIFFS}, {FLIPS}
    SELECT optimizer_a, optimizer_b, round(p_value, 6) AS p_value,
           round({HOLM}, 6) AS adjusted_p_value FROM flips
    WINDOW w AS (ORDER BY p_value, optimizer_a, optimizer_b)
    ORDER BY p_value, optimizer_a, optimizer_b LIMIT 20""",
)
def w12(spark, sf):
    return rounded(
        compare.top_pairs(compare.holm(compare.sign_flip_test(_diffs(spark, sf))), 20)
    )


@query(
    "t9_analyze_pairwise",
    f"""{ALL_PAIRS} SELECT {PAIR_COLUMNS}, round({HOLM}, 6) AS adjusted_p_value FROM pairs
    WINDOW w AS (ORDER BY p_value, optimizer_a, optimizer_b)""",
)
def t9(spark, sf):
    from fieldtrial.plans.analysis import analyze

    return rounded(analyze(results(spark, sf), "Open_Race")["pairwise"])


VECTOR_INFO = f"""WITH {VECTORS} SELECT count(*) AS n_samples, 64 AS n_features,
    min(y) AS y_min, max(y) AS y_max, round(avg(y), 6) AS y_mean,
    round(stddev_pop(y), 6) AS y_std FROM vectors"""


@query("a10_dataset_info_vectors", VECTOR_INFO)
def a10_vectors(spark, sf):
    return rounded(stats.dataset_info(vectors(spark, sf)))
