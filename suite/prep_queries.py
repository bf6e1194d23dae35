"""Reading, preparation and trajectory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrial.operators import curves, prep, stats
from fieldtrial.plans import sweep
from fieldtrial.session import scratch_path
from fieldtrial.sources import catalog, files, results as result_files

from .inputs import POOL, RESULTS, RUNS, pool, results, rounded, runs
from .registry import query, table
from .stat_queries import SUMMARY_SQL

PART_COLUMNS = {"p_partkey": "bigint", "p_size": "double", "p_retailprice": "double", "Label": "double"}


def _part_csv(spark, sf):
    """Parts written as a measured dataset."""
    path = scratch_path(spark, "parts")
    table(spark, sf, "part").select(
        "p_partkey", "p_size", "p_retailprice", (F.col("p_retailprice") / 100).alias("Label")
    ).write.csv(path, header=True)
    return catalog.read_dataset(spark, path, PART_COLUMNS)


@query(
    "s1_read_dataset",
    """SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice,
    p_retailprice / 100 AS Label FROM part""",
)
def s1(spark, sf):
    return _part_csv(spark, sf)


@query(
    "s2_read_text_table",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, coalesce(lang, '') AS lang FROM documents""",
)
def s2(spark, sf):
    path = scratch_path(spark, "texts")
    result_files.write_csv(table(spark, sf, "documents").select("doc_id", "text", "lang"), path)
    return result_files.read_text_table(spark, path)


# Every order becomes one small result document; the layout depends on its key.
LAYOUTS = [
    '{{"tournament_results": {{"competitions": [{c}]}}}}',
    '{{"tournament_results": [{{"competitions": [{c}]}}]}}',
    '{{"all_tournament_results": [{{"competitions": [{c}]}}]}}',
    '{{"competitions": [{c}]}}',
    '{{"results": {{"tournament_results": {{"competitions": [{c}]}}}}}}',
    '{{"files": [{{"data": {{"tournament_results": [{{"competitions": [{c}]}}]}}}}]}}',
]


def _result_documents(spark, sf):
    o = table(spark, sf, "orders")
    inner = F.concat(
        F.lit('{"optimizer_results": {"'),
        F.col("o_orderpriority"),
        F.lit('": {"steps_to_target": '),
        (F.col("o_custkey") % 50 + 1).cast("string"),
        F.lit(', "found_target": true, "final_best": '),
        F.col("o_totalprice").cast("decimal(20,2)").cast("string"),
        F.lit("}}}"),
    )
    text = F.lit(None)
    for i, layout in enumerate(LAYOUTS):
        a, b = layout.format(c="\x00").split("\x00")
        whole = F.concat(F.lit(a), inner, F.lit(b))
        text = F.when(F.col("o_orderkey") % len(LAYOUTS) == i, whole).otherwise(text)
    junk = F.when(F.col("o_orderkey") % 5 == 0, F.lit("﻿pl")).otherwise(F.lit(""))
    path = F.concat(
        F.lit("/r/set_"), (F.col("o_custkey") % 7).cast("string"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("_Hard")).otherwise(F.lit("_Easy")),
        F.lit("_Batch"), (F.col("o_orderkey") % 3).cast("string"), F.lit("_x.json"),
    )
    return o.select(path.alias("path"), F.concat(junk, text).alias("text"))


S4_SQL = """SELECT 'set_' || (o_custkey % 7) AS dataset, 'Batch' || (o_orderkey % 3) AS batch,
    0 AS competition_idx, o_orderpriority AS optimizer,
    'set_' || (o_custkey % 7) || '_Batch' || (o_orderkey % 3) || '_comp0' AS instance,
    CAST(o_custkey % 50 + 1 AS DOUBLE) AS steps_to_target, true AS found_target,
    o_totalprice AS final_best FROM orders"""


@query("s4_parse_results", S4_SQL)
def s4(spark, sf):
    docs = _result_documents(spark, sf).withColumn("text", result_files.strip_junk(F.col("text")))
    return result_files.parse_results(docs).drop("path", "history")


@query(
    "s4_read_results",
    """SELECT c_mktsegment AS optimizer, count(*) AS n, round(avg(c_acctbal), 6) AS mean_best
    FROM customer GROUP BY 1""",
)
def s4_files(spark, sf):
    """Customers written as result documents, one per line, and read back from the folder."""
    path = scratch_path(spark, "results")
    best = F.struct(F.col("c_acctbal").alias("final_best"))
    competition = F.struct(F.create_map(F.col("c_mktsegment"), best).alias("optimizer_results"))
    tournament = F.struct(F.array(competition).alias("competitions"))
    table(spark, sf, "customer").select(
        F.to_json(F.struct(tournament.alias("tournament_results"))).alias("value")
    ).write.text(path)
    return rounded(
        result_files.parse_results(result_files.read_json_text(spark, path, lines=True))
        .groupBy("optimizer")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("final_best").alias("mean_best"))
    )


@query(
    "s5_dirty_json",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
)
def s5(spark, sf):
    noisy = F.concat(F.lit("﻿pl"), F.col("props"))
    return table(spark, sf, "events").select(
        "event_id", F.from_json(result_files.strip_junk(noisy), "k bigint")["k"].alias("k")
    )


@query(
    "s6_optimizer_stats",
    """SELECT 'f' || p_partkey AS path, p_brand AS optimizer, p_retailprice AS mean_steps,
    CAST(p_size AS DOUBLE) AS std_steps, p_partkey % 4 AS n FROM part WHERE p_size <> 7""",
)
def s6(spark, sf):
    p = table(spark, sf, "part")
    stored = F.struct(
        F.when(F.col("p_size") != 7, F.col("p_retailprice")).alias("mean_steps"),
        F.col("p_size").cast("double").alias("std_steps"),
        (F.col("p_partkey") % 4).cast("double").alias("n_competitions"),
    )
    name = F.when(F.col("p_partkey") % 2 == 0, F.lit("optimizer_stats")).otherwise(F.lit("mean_steps"))
    body = F.to_json(F.create_map(name, F.create_map("p_brand", stored)))
    docs = p.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), body.alias("text"))
    return result_files.parse_optimizer_stats(docs)


@query("s7_write_csv", f"WITH {RESULTS} {SUMMARY_SQL}")
def s7(spark, sf):
    path = scratch_path(spark, "summary")
    summary = stats.summary_stats(results(spark, sf), "final_best")
    result_files.write_csv(summary, path)
    return spark.read.csv(path, header=True, schema=summary.schema)


@query(
    "s8_write_cells",
    f"""WITH {RESULTS} SELECT optimizer, 'RF_' || pool AS combo, dataset,
    round(avg(steps_to_target), 6) AS mean_steps, round(stddev_pop(steps_to_target), 6) AS std_steps
    FROM results GROUP BY 1, 2, 3""",
)
def s8(spark, sf):
    path = scratch_path(spark, "cells")
    cells = rounded(
        results(spark, sf)
        .groupBy("optimizer", F.concat(F.lit("RF_"), "pool").alias("combo"), "dataset")
        .agg(F.avg("steps_to_target").alias("mean_steps"), F.stddev_pop("steps_to_target").alias("std_steps"))
    )
    result_files.write_cells(cells, path)
    schema = "optimizer string, mean_steps double, std_steps double, combo string, dataset string"
    return spark.read.schema(schema).json(path)


@query(
    "s9_pending_cells",
    """SELECT o_orderkey FROM orders WHERE NOT EXISTS
    (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""",
)
def s9(spark, sf):
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("o_orderkey")
    )
    return sweep.pending_cells(table(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query(
    "s10_sweep_grid",
    """WITH combos AS (SELECT s AS surrogate, m AS mode FROM
      (SELECT unnest(['GP', 'RF', 'NN', 'BNN']) AS s), (SELECT unnest(['Regular', 'Hard']) AS m)),
    sets AS (SELECT p_partkey AS dataset, p_type FROM part)
    SELECT surrogate || '_' || mode AS combo, dataset, surrogate, mode,
      CASE WHEN mode = 'Regular' THEN 0.0::DOUBLE WHEN p_type = 'PROMO' THEN 0.2::DOUBLE
           ELSE 0.1::DOUBLE END AS noise_level,
      mode = 'Hard' AND p_type = 'PROMO' AS heteroscedastic,
      CASE WHEN mode = 'Hard' AND p_type = 'PROMO' THEN 2 ELSE 1 END AS n_modes,
      2.0::DOUBLE AS mode_separation, 0 AS n_discontinuities, 2.0::DOUBLE AS discontinuity_strength
    FROM combos, sets""",
)
def s10(spark, sf):
    level = F.when(F.col("p_type") == "PROMO", F.lit("bimodal")).otherwise(F.lit("noise"))
    sets = table(spark, sf, "part").select(F.col("p_partkey").alias("dataset"), level.alias("hard_preset"))
    return sweep.sweep_grid(sets)


@query(
    "s11_group_files",
    """SELECT page_id, trim(split_part(split_part(regexp_extract(url, '[^/]*$'), '-', 1), '_', 1))
    AS key, regexp_extract(url, '[^/]*$') AS file_name FROM pages""",
)
def s11(spark, sf):
    return files.group_files(table(spark, sf, "pages"), "url").select("page_id", "key", "file_name")


@query(
    "p1_p2_to_xy",
    """SELECT p_partkey, [CAST(p_size AS DOUBLE), p_retailprice] AS x, p_retailprice / 100 AS y,
    0.0::DOUBLE AS y_var FROM part""",
)
def p2(spark, sf):
    spec = catalog.DatasetSpec("parts", drop=("Unnamed: 0", "Fidelity"))
    return prep.to_xy(_part_csv(spark, sf), spec, keep=["p_partkey"])


TARGETS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({y}, 6) AS y, round({v}, 6) AS y_var
    FROM lineitem"""


def _targets(spark, sf, spec):
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return rounded(prep.to_xy(table(spark, sf, "lineitem"), spec, keep).drop("x"))


@query("p3_deviation_to_variance", TARGETS.format(y="l_extendedprice", v="l_tax * l_tax"))
def p3(spark, sf):
    spec = catalog.DatasetSpec(
        "lines", "l_extendedprice", "l_tax", ("l_quantity",), variance_kind="deviation"
    )
    return _targets(spark, sf, spec)


@query("p4_log1p_target", TARGETS.format(y="ln(1 + l_extendedprice)", v="0.0::DOUBLE"))
def p4(spark, sf):
    spec = catalog.DatasetSpec(
        "lines", "l_extendedprice", None, ("l_quantity",), transform="log1p", variance_kind="zero"
    )
    return _targets(spark, sf, spec)


@query(
    "p5_log_ratio_target", TARGETS.format(y="ln(1 + l_extendedprice / l_quantity)", v="0.0::DOUBLE")
)
def p5(spark, sf):
    spec = catalog.DatasetSpec(
        "lines", "l_extendedprice", None, ("l_discount",), transform="log_ratio",
        control="l_quantity", variance_kind="zero",
    )
    return _targets(spark, sf, spec)


def _xy(df):
    return rounded(df.select("campaign", "point_id", F.col("x")[0].alias("x1"), F.col("x")[1].alias("x2")))


@query(
    "p6_scaler",
    f"""WITH {POOL}, s AS (SELECT campaign, avg(x1) m1, stddev_pop(x1) s1, avg(x2) m2,
    stddev_pop(x2) s2 FROM pool GROUP BY 1)
    SELECT campaign, point_id, round((x1 - m1) / s1, 6) AS x1, round((x2 - m2) / s2, 6) AS x2
    FROM pool JOIN s USING (campaign)""",
)
def p6(spark, sf):
    p = pool(spark, sf)
    return _xy(prep.apply_scaler(p, prep.fit_scaler(p, ["campaign"]), ["campaign"]))


@query(
    "p7_scale_pm1",
    f"""WITH {POOL}, s AS (SELECT campaign, min(x1) a1, max(x1) b1, min(x2) a2, max(x2) b2
    FROM pool GROUP BY 1)
    SELECT campaign, point_id, round(2 * (x1 - a1) / (b1 - a1) - 1, 6) AS x1,
    round(2 * (x2 - a2) / (b2 - a2) - 1, 6) AS x2 FROM pool JOIN s USING (campaign)""",
)
def p7(spark, sf):
    p = pool(spark, sf)
    return _xy(prep.scale_pm1(p, stats.bounds(p, ["campaign"]), ["campaign"]))


@query(
    "p8_clip",
    f"""WITH {POOL} SELECT campaign, point_id, least(greatest(x1, 10.0), 40.0) AS x1,
    least(greatest(x2, 920.0), 980.0) AS x2 FROM pool""",
)
def p8(spark, sf):
    from fieldtrial.functions.vectors import clip, vec

    return _xy(pool(spark, sf).withColumn("x", clip(F.col("x"), vec([10, 920]), vec([40, 980]))))


@query(
    "p9_unit_scale",
    f"""WITH {POOL} SELECT campaign, point_id, round((x1 - 1) / 49, 6) AS x1,
    round((x2 - 900) / 1.0::DOUBLE, 6) AS x2 FROM pool""",
)
def p9(spark, sf):
    from fieldtrial.functions.vectors import unit_scale, vec

    return _xy(pool(spark, sf).withColumn("x", unit_scale(F.col("x"), vec([1, 900]), vec([50, 900]))))


@query(
    "p10_clean_variance",
    """SELECT event_id, round((CASE WHEN event_id % 3 = 0 THEN 1e-6 ELSE value END) + 1e-6, 9) AS v
    FROM events""",
)
def p10(spark, sf):
    noisy = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return rounded(
        table(spark, sf, "events").select("event_id", prep.clean_variance(noisy).alias("v")), 9
    )


@query(
    "p11_parse_result_name",
    """SELECT doc_id,
    CASE WHEN doc_id % 4 = 3 THEN 'Unknown' ELSE source || '_' || lang END AS dataset,
    CASE WHEN doc_id % 4 = 2 THEN 'Unknown' ELSE 'Batch' || n_chars END AS batch FROM documents""",
)
def p11(spark, sf):
    k = F.col("doc_id") % 4
    name = F.concat(
        F.when(k == 3, F.lit("Hard_")).otherwise(F.lit("")),
        F.concat_ws("_", "source", "lang"),
        F.when(k == 0, F.lit("_Hard_Mode")).when(k == 3, F.lit("")).otherwise(F.lit("_Easy")),
        F.when(k == 2, F.lit("_b")).otherwise(F.lit("_Batch")),
        F.col("n_chars").cast("string"),
        F.lit(".json"),
    )
    dataset, batch = prep.parse_result_name(name)
    return table(spark, sf, "documents").select(
        "doc_id", dataset.alias("dataset"), batch.alias("batch")
    )


@query(
    "p12_instance_key",
    """SELECT o_orderkey, o_orderstatus || '_Batch' || (o_orderkey % 20) || '_comp' || o_custkey
    AS instance FROM orders""",
)
def p12(spark, sf):
    batch = F.concat(F.lit("Batch"), (F.col("o_orderkey") % 20).cast("string"))
    return table(spark, sf, "orders").select(
        "o_orderkey", prep.instance_key(F.col("o_orderstatus"), batch, F.col("o_custkey")).alias("instance")
    )


@query(
    "p13_final_best",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN value + 1 WHEN 1 THEN value + 2 ELSE value END
    AS final_best FROM events""",
)
def p13(spark, sf):
    k, v = F.col("event_id") % 3, F.col("value")
    values = F.when(k == 0, F.array(v, v + 1)).otherwise(F.array().cast("array<double>"))
    record = F.struct((v + 2).alias("best_value_so_far"))
    history = F.when(k == 1, F.array(record)).otherwise(F.slice(F.array(record), 1, 0))
    return table(spark, sf, "events").select(
        "event_id", prep.final_best(values, history, v).alias("final_best")
    )


ORDER_SQL = " ".join(
    f"WHEN '{o}' THEN {i * 100 + j}" for i, (_, opts) in enumerate(prep.CATEGORIES) for j, o in enumerate(opts)
)
NAMES = [o for _, opts in prep.CATEGORIES for o in opts] + ["OTHER"]


def _named_runs(spark, sf):
    name = F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("o_custkey") % len(NAMES)).cast("int"))
    return table(spark, sf, "orders").select(
        "o_orderkey", name.alias("optimizer"), F.floor(F.col("o_totalprice")).cast("int").alias("steps_to_target")
    )


NAMED_RUNS = f"""named AS (SELECT o_orderkey, {NAMES!r}[CAST(o_custkey % {len(NAMES)} + 1 AS INTEGER)]
    AS optimizer, CAST(floor(o_totalprice) AS INTEGER) AS steps_to_target FROM orders)"""


@query(
    "p24_with_category",
    f"""WITH {NAMED_RUNS} SELECT o_orderkey, optimizer,
    CASE WHEN d < 100 THEN 'Classical Design Approaches (DOE)'
         WHEN d < 200 THEN 'Direct Heuristic Search'
         WHEN d < 300 THEN 'Surrogate-Assisted Optimization' END AS category, d AS display_order
    FROM (SELECT *, CASE optimizer {ORDER_SQL} ELSE 9999 END AS d FROM named)""",
)
def p24(spark, sf):
    return prep.with_category(
        _named_runs(spark, sf).drop("steps_to_target"), prep.category_table(spark)
    )


@query(
    "p25_select_optimizers",
    f"""WITH {NAMED_RUNS} SELECT * FROM named WHERE optimizer IN ('RANDOM', 'SMART_BO')""",
)
def p25(spark, sf):
    return prep.select_optimizers(_named_runs(spark, sf), ["RANDOM", "SMART_BO", "NO_SUCH"])


@query(
    "p26_apply_step_cap",
    f"""WITH {NAMED_RUNS}, c AS (SELECT o_orderkey, optimizer,
      CASE WHEN optimizer IN ('RANDOM', 'DE_DIRECT') THEN 100000 END AS cap, steps_to_target AS s
      FROM named)
    SELECT o_orderkey, optimizer, CAST(CASE WHEN s > cap THEN cap ELSE s END AS INTEGER)
      AS steps_to_target, cap IS NOT NULL AND s >= cap AS max_steps_capped FROM c""",
)
def p26(spark, sf):
    caps = spark.createDataFrame(list(prep.STEP_CAPS.items()), "optimizer string, max_steps int")
    return prep.apply_step_cap(_named_runs(spark, sf), caps)


@query(
    "j10_valid_results",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events
    WHERE CAST(json_extract(props, '$.k') AS DOUBLE) IS NOT NULL AND event_id % 4 <> 0""",
)
def j10(spark, sf):
    e = table(spark, sf, "events")
    body = F.when(F.col("event_id") % 4 != 0, F.col("props")).otherwise(F.lit("{}"))
    return result_files.valid_results(
        e.select("event_id", F.from_json(body, "k double")["k"].alias("k")), "k"
    )


@query(
    "w3_best_so_far",
    f"""WITH {RUNS} SELECT optimizer, run, step, value, max(value) OVER
    (PARTITION BY optimizer, run ORDER BY step) AS best FROM runs""",
)
def w3(spark, sf):
    return curves.best_so_far(runs(spark, sf), ["optimizer", "run"])


@query(
    "w4_mean_trajectory",
    f"""WITH {RUNS}, b AS (SELECT optimizer, run, step, max(value) OVER
      (PARTITION BY optimizer, run ORDER BY step) AS best FROM runs),
    last AS (SELECT optimizer, run, max(step) AS last, max(best) AS best FROM b GROUP BY 1, 2),
    steps AS (SELECT optimizer, unnest(range(CAST(max(last) + 1 AS BIGINT))) AS step
              FROM last GROUP BY optimizer),
    filled AS (
      SELECT optimizer, step, best FROM b
      UNION ALL
      SELECT s.optimizer, s.step, l.best FROM steps s JOIN last l
        ON s.optimizer = l.optimizer AND s.step > l.last)
    SELECT s.optimizer, CAST(s.step AS INTEGER) AS step, round(avg(f.best), 9) AS mean_best,
      count(f.best) AS n_runs
    FROM steps s LEFT JOIN filled f ON s.optimizer = f.optimizer AND s.step = f.step
    GROUP BY 1, 2""",
)
def w4(spark, sf):
    return rounded(curves.mean_trajectory(runs(spark, sf), ["optimizer"], ["run"]), 9)


@query(
    "w5_eval_schedule",
    """WITH c AS (SELECT p_partkey, 20 + p_size AS S, 10 AS R, 1 + p_partkey % 9 AS B FROM part),
    steps AS (SELECT *, unnest(range(CAST(ceil((S - R) / B::DOUBLE) AS BIGINT) + 1)) AS step FROM c)
    SELECT p_partkey, CAST(step AS INTEGER) AS step,
    CAST(CASE WHEN step = 0 THEN R ELSE least(B, S - R - (step - 1) * B) END AS INTEGER) AS batch_size,
    CAST(R + least(step * B, S - R) AS INTEGER) AS evaluations FROM steps""",
)
def w5(spark, sf):
    c = table(spark, sf, "part").select(
        "p_partkey", (20 + F.col("p_size")).alias("S"), F.lit(10).alias("R"),
        (1 + F.col("p_partkey") % 9).alias("B"),
    )
    return curves.eval_schedule(c, ["p_partkey"])


@query(
    "w13_current_best",
    f"""WITH {RUNS} SELECT optimizer, run, step, value, 5.0::DOUBLE AS revealed,
    greatest(5.0, max(value) OVER (PARTITION BY optimizer, run ORDER BY step
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS current_best FROM runs""",
)
def w13(spark, sf):
    seeded = runs(spark, sf).withColumn("revealed", F.lit(5.0))
    return curves.current_best(seeded, ["optimizer", "run"], "revealed")


FACTS = """facts AS (SELECT o_orderstatus AS difficulty, c_mktsegment AS dataset,
    o_orderpriority AS optimizer, avg(o_totalprice) AS mean_steps
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""


def _facts(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.col("o_orderstatus").alias("difficulty"),
            F.col("c_mktsegment").alias("dataset"),
            F.col("o_orderpriority").alias("optimizer"),
        )
        .agg(F.avg("o_totalprice").alias("mean_steps"))
    )


@query(
    "a13_cube_bars",
    f"""WITH {FACTS} SELECT difficulty, optimizer,
    CASE WHEN grouping(dataset) = 1 THEN 'all' ELSE dataset END AS dataset,
    round(avg(mean_steps), 6) AS mean_steps FROM facts
    GROUP BY GROUPING SETS ((difficulty, optimizer, dataset), (difficulty, optimizer))""",
)
def a13(spark, sf):
    return rounded(curves.cube_bars(_facts(spark, sf), ["difficulty"]))


@query(
    "a14_cube_lines",
    f"""WITH {RUNS}, m AS (SELECT optimizer, step, avg(value) AS v FROM runs GROUP BY 1, 2)
    SELECT optimizer, step, round(max(v) OVER (PARTITION BY optimizer ORDER BY step), 6) AS best
    FROM m""",
)
def a14(spark, sf):
    facts = runs(spark, sf).withColumnRenamed("run", "dataset")
    return rounded(curves.cube_lines(facts, []))


@query(
    "a15_available_optimizers",
    """SELECT DISTINCT o_orderpriority AS optimizer FROM orders WHERE o_orderstatus = 'F'""",
)
def a15(spark, sf):
    facts = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("optimizer"), F.col("o_orderstatus").alias("difficulty")
    )
    return curves.available_optimizers(facts, {"difficulty": "F"})
