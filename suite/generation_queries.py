"""Generated points, splits, difficulty layers and designs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrial.operators import designs, difficulty, generate, neighbours, selection, stats
from fieldtrial.plans import sweep
from fieldtrial.session import cut_lineage

from .inputs import LIMITS3, POOL, POOL3, VECTORS, pool, pool3, rounded, vectors
from .registry import query, s_hash, s_normal, s_u, s_u_open, table

C = ["campaign"]


def _flat(df, *cols, d=3):
    return rounded(df.select(*cols, *[F.col("x")[j].alias(f"x{j + 1}") for j in range(d)]))


@query(
    "g1_hash",
    f"""SELECT o_orderkey, {s_hash("'label'", "o_orderkey")} AS h,
    {s_hash("'label'", "o_orderkey")} % 10000 AS h_mod, {s_u("'label'", "o_orderkey")} AS u
    FROM orders""",
)
def g1(spark, sf):
    from fieldtrial.functions.hashing import hash_int, hash_u

    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", hash_int("label", k).alias("h"),
        hash_int("label", k, mod=10_000).alias("h_mod"), hash_u("label", k).alias("u"),
    )


@query(
    "g2_campaigns",
    f"""SELECT p_partkey, CAST(pool AS INTEGER) AS pool, CAST(competition AS INTEGER) AS competition,
    42 + pool * 100000 + {s_hash("'synth_' || pool")} % 100000 AS pool_seed,
    42 + {s_hash("'synth_' || pool")} % 100000 + competition * 10000
      + {s_hash("'comp_' || competition")} % 10000 AS competition_seed
    FROM part, (SELECT unnest(range(10)) AS pool), (SELECT unnest(range(3)) AS competition)""",
)
def g2(spark, sf):
    return generate.campaigns(table(spark, sf, "part").select("p_partkey"), 10, 3)


@query(
    "g2_open_race_campaigns",
    """SELECT p_partkey, CAST(competition AS INTEGER) AS competition,
    42 + competition AS competition_seed FROM part, (SELECT unnest(range(10)) AS competition)""",
)
def g2_open(spark, sf):
    return generate.open_race_campaigns(table(spark, sf, "part").select("p_partkey"), 10)


def _limits(p):
    sizes = p.groupBy(*C).agg(F.count(F.lit(1)).alias("rows"))
    return stats.bounds(p, C).join(sizes, C)


@query(
    "g3_uniform_points",
    f"""WITH {POOL3}, {LIMITS3}, pts AS (SELECT *, unnest(range(n)) AS point_id FROM limits)
    SELECT campaign, point_id, {", ".join(
        f"round(a{j + 1} + (b{j + 1} - a{j + 1}) * {s_u("'7'", "campaign", "point_id", str(j))}, 6) AS x{j + 1}"
        for j in range(3))} FROM pts""",
)
def g3(spark, sf):
    return _flat(
        generate.uniform_points(_limits(pool3(spark, sf)), C, F.col("rows"), 3, 7),
        "campaign", "point_id",
    )


def lhs_sql(source: str, key: str, point: str, n: str, seed: str, d: int) -> str:
    """Unit coordinates u1 .. ud of a Latin hypercube."""
    cols = ", ".join(
        f"""((row_number() OVER (PARTITION BY {key} ORDER BY
        {s_hash(f"'{seed}'", key, point, str(j))}, {point}) - 1
        + {s_u(f"'{seed}'", "'jitter'", key, point, str(j))}) / {n}) AS u{j + 1}"""
        for j in range(d)
    )
    return f"SELECT *, {cols} FROM {source}"


@query(
    "g4_latin_hypercube",
    f"""WITH {POOL3}, {LIMITS3}, slots AS (SELECT l.*, point_id FROM pool JOIN limits l USING (campaign)),
    lhs AS ({lhs_sql("slots", "campaign", "point_id", "n", "3", 3)})
    SELECT campaign, point_id, {", ".join(
        f"round(a{j} + (b{j} - a{j}) * u{j}, 6) AS x{j}" for j in (1, 2, 3))} FROM lhs""",
)
def g4(spark, sf):
    p = pool3(spark, sf)
    unit = generate.latin_hypercube(p, C, "point_id", 3, 3)
    return _flat(generate.scale_points(unit, stats.bounds(p, C), C), "campaign", "point_id")


@query(
    "g5_manifold_pool",
    f"""WITH {POOL3}, s AS (SELECT campaign, count(*) n, min(x1) a1, max(x1) b1, stddev_pop(x1) s1,
      min(x2) a2, max(x2) b2, stddev_pop(x2) s2, min(x3) a3, max(x3) b3, stddev_pop(x3) s3
      FROM pool GROUP BY 1),
    idx AS (SELECT *, row_number() OVER (PARTITION BY campaign
      ORDER BY {s_hash("'9'", "'row'", "campaign", "point_id")}, point_id) AS pick FROM pool),
    slots AS (SELECT s.*, unnest(range(n)) AS slot FROM s),
    chosen AS (SELECT *, {s_hash("'9'", "campaign", "slot", "'pick'")} % n + 1 AS pick FROM slots)
    SELECT c.campaign, slot AS point_id, {", ".join(
        f"round(least(greatest(x{j + 1} + {s_normal("'9'", "c.campaign", "slot", str(j))} "
        f"* (s{j + 1} + 1e-9) * 0.15::DOUBLE, a{j + 1}), b{j + 1}), 6) AS x{j + 1}" for j in range(3))}
    FROM chosen c JOIN idx i ON c.campaign = i.campaign AND c.pick = i.pick""",
)
def g5(spark, sf):
    return _flat(
        generate.manifold_pool(pool3(spark, sf), C, "point_id", F.col("rows"), 3, 9),
        "campaign", "point_id",
    )


@query(
    "g6_subsample",
    f"""SELECT p_partkey, p_retailprice FROM part
    ORDER BY {s_hash("'11'", "p_partkey")}, p_partkey LIMIT 600""",
)
def g6(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return generate.subsample(p, "p_partkey", 11, 600)


def split_sql(fraction: str, seed: str) -> str:
    return f"""split AS (
  SELECT *, is_target OR row_number() OVER (PARTITION BY campaign, is_target
           ORDER BY {s_hash(f"'{seed}'", "campaign", "point_id")}, point_id)
         <= floor(n * {fraction}::DOUBLE) - 1 AS hidden
  FROM (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY y DESC, point_id) = 1
               AS is_target, count(*) OVER (PARTITION BY campaign) AS n FROM pool))"""


@query(
    "g7_hide_split",
    f"""WITH {POOL}, {split_sql("0.95", "5")}
    SELECT campaign, point_id, is_target, hidden FROM split""",
)
def g7(spark, sf):
    out = generate.hide_split(pool(spark, sf), C, 0.95, 5)
    return out.select("campaign", "point_id", "is_target", "hidden")


@query(
    "g7_hide_splits",
    f"""WITH {POOL}, {split_sql("0.95", "5|0.95")},
    {split_sql("0.99", "5|0.99").replace("split AS", "split2 AS")}
    SELECT campaign, point_id, hidden, 0.95::DOUBLE AS hidden_fraction FROM split
    UNION ALL SELECT campaign, point_id, hidden, 0.99::DOUBLE FROM split2""",
)
def g7_list(spark, sf):
    out = generate.hide_splits(pool(spark, sf), C, [0.95, 0.99], 5)
    return out.select("campaign", "point_id", "hidden", "hidden_fraction")


WAVES = f"""waves AS (
  SELECT k, sqrt(5.0::DOUBLE / sum(power({s_normal("'42'", "'chi'", "k", "i")}, 2))) / 0.3::DOUBLE AS f
  FROM (SELECT unnest(range(64)) AS k), (SELECT unnest(range(5)) AS i) GROUP BY k),
surface AS (
  SELECT point_id, u1, u2, sum(
    cos(u1 * {s_normal("'42'", "'freq'", "k", "0")} * f + u2 * {s_normal("'42'", "'freq'", "k", "1")} * f
        + 2 * pi() * {s_u_open("'42'", "'phase'", "k")})
    * {s_normal("'42'", "'weight'", "k")} * sqrt(2.0::DOUBLE / 64)) AS v
  FROM lhs, waves GROUP BY 1, 2, 3)"""


@query(
    "g8_synthetic_dataset",
    f"""WITH pts AS (SELECT 0 AS all_, p_partkey AS point_id, (SELECT count(*) FROM part) AS n FROM part),
    lhs AS ({lhs_sql("pts", "all_", "point_id", "n", "42", 2)}), {WAVES}
    SELECT point_id, round(u1, 6) AS x1, round(u2, 6) AS x2,
    round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 10
      + 0.1::DOUBLE * {s_normal("'42'", "'noise'", "point_id")}, 6) AS y,
    round(0.1::DOUBLE * 0.1::DOUBLE, 6) AS y_var FROM surface""",
)
def g8(spark, sf):
    ids = table(spark, sf, "part").select(F.col("p_partkey").alias("point_id"))
    return _flat(generate.synthetic_dataset(ids, "point_id", 2), "point_id", "y", "y_var", d=2)


@query(
    "g9_label_pool",
    f"""WITH {POOL} SELECT campaign, point_id, round(x1 * 2 + x2
    + 0.1::DOUBLE * {s_normal("'13'", "'label'", "point_id")}, 6) AS y FROM pool""",
)
def g9(spark, sf):
    def predict(df):
        return df.withColumn("prediction", F.col("x")[0] * 2 + F.col("x")[1])

    labelled = generate.label_pool(pool(spark, sf), predict, 13, noise=0.1)
    return rounded(labelled.select("campaign", "point_id", "y"))


@query(
    "w7_target_point",
    f"""WITH {POOL} SELECT campaign, point_id AS target_id, y AS target_value FROM pool
    QUALIFY row_number() OVER (PARTITION BY campaign ORDER BY y DESC, point_id) = 1""",
)
def w7(spark, sf):
    return generate.target_points(pool(spark, sf), C)


def _noise_sql(scale: str) -> str:
    return f"""WITH {POOL} SELECT campaign, point_id,
    round(y + ({scale}) * {s_normal("'n'", "point_id")}, 6) AS y FROM pool"""


def _noise(spark, sf, sigma, by=None):
    out = difficulty.add_noise(pool(spark, sf), sigma, ["n", F.col("point_id")], by)
    return rounded(out.select("campaign", "point_id", "y"))


@query("n1_noise", _noise_sql("0.1::DOUBLE"))
def n1(spark, sf):
    return _noise(spark, sf, 0.1)


@query("n2_noise_by_value", _noise_sql("abs(y) * 0.2::DOUBLE + 0.01::DOUBLE"))
def n2(spark, sf):
    return _noise(spark, sf, 0.2, "value")


@query("n3_noise_by_radius", _noise_sql("0.2::DOUBLE * (1 + 0.5::DOUBLE * (x1 * x1 + x2 * x2))"))
def n3(spark, sf):
    return _noise(spark, sf, 0.2, "radius")


LOW, HIGH = [0.0, 900.0], [50.0, 1000.0]
MODES = difficulty.random_modes(LOW, HIGH, 3, "m")
PLANES = difficulty.random_planes(LOW, HIGH, 3, "p")


@query(
    "n4_multimodal",
    f"""WITH {POOL} SELECT campaign, point_id, round({" + ".join(
        f"{w!r}::DOUBLE * ((x1 - {c[0]!r}::DOUBLE) + (x2 - {c[1]!r}::DOUBLE)) "
        f"* exp(-(power(x1 - {c[0]!r}::DOUBLE, 2) + power(x2 - {c[1]!r}::DOUBLE, 2)) / 800.0::DOUBLE)"
        for w, c in MODES)}, 6) AS y FROM pool""",
)
def n4(spark, sf):
    out = difficulty.multimodal(pool(spark, sf), MODES, separation=20.0)
    return rounded(out.select("campaign", "point_id", "y"))


@query(
    "n5_add_bumps",
    f"""WITH {VECTORS} SELECT vec_id, round(y
    + 0.5::DOUBLE * exp(-list_sum(list_transform(x, lambda v: (v - 0.5::DOUBLE) * (v - 0.5::DOUBLE))))
    + 0.5::DOUBLE * exp(-list_sum(list_transform(x, lambda v: (v - 1.0::DOUBLE) * (v - 1.0::DOUBLE)))), 9)
    AS y FROM vectors""",
)
def n5(spark, sf):
    return rounded(difficulty.add_bumps(vectors(spark, sf), 3, 0.5).select("vec_id", "y"), 9)


@query(
    "n6_plane_jumps",
    f"""WITH {POOL} SELECT campaign, point_id, y + {" + ".join(
        f"CASE WHEN (x1 - {p[0]!r}::DOUBLE) * {n[0]!r}::DOUBLE + (x2 - {p[1]!r}::DOUBLE) * {n[1]!r}::DOUBLE > 0 "
        "THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END" for n, p in PLANES)} AS y FROM pool""",
)
def n6(spark, sf):
    return difficulty.plane_jumps(pool(spark, sf), PLANES).select("campaign", "point_id", "y")


@query(
    "n7_threshold_jumps",
    f"""WITH {VECTORS} SELECT vec_id, y + 2.0::DOUBLE * (
    CAST(list_max(x) > 0.25 AS INTEGER) + CAST(list_max(x) > 0.5 AS INTEGER)
    + CAST(list_max(x) > 0.75 AS INTEGER)) AS y FROM vectors""",
)
def n7(spark, sf):
    return difficulty.threshold_jumps(vectors(spark, sf), 3).select("vec_id", "y")


HARD_NAMES = list(sweep.HARD_PRESET) + ["synthetic_2d"]


@query(
    "n8_difficulty",
    f"""SELECT p_partkey, CASE WHEN i < 4 THEN 0.1::DOUBLE WHEN i < 6 THEN 0.2::DOUBLE
      ELSE 0.1::DOUBLE END AS noise_level, i IN (4, 5) AS heteroscedastic,
    CASE WHEN i IN (4, 5) THEN 2 ELSE 1 END AS n_modes, 2.0::DOUBLE AS mode_separation
    FROM (SELECT p_partkey, p_partkey % 7 AS i FROM part)""",
)
def n8(spark, sf):
    """Presets per dataset; a dataset without one takes the defaults."""
    name = F.get(F.array(*[F.lit(n) for n in HARD_NAMES]), (F.col("p_partkey") % 7).cast("int"))
    cells = table(spark, sf, "part").select("p_partkey", name.alias("dataset"))
    preset = cells.join(F.broadcast(sweep.hard_presets(spark)), "dataset", "left")
    settings = preset.join(
        F.broadcast(sweep.presets(spark)), F.col("hard_preset") == F.col("preset"), "left"
    )
    return sweep.with_defaults(settings).select(
        "p_partkey", "noise_level", "heteroscedastic", "n_modes", "mode_separation"
    )


def _design(name: str, runs_sql: str, build):
    """A design per brand, decoded into the brand's range by ``a + (code + 1) / 2 * (b - a)``."""
    sql = f"""WITH {POOL3}, {LIMITS3}, codes AS ({runs_sql})
    SELECT campaign, run, {", ".join(
        f"round(a{j} + (c{j} + 1) / 2.0::DOUBLE * (b{j} - a{j}), 6) AS x{j}" for j in (1, 2, 3))}
    FROM codes JOIN limits USING (campaign)"""

    @query(name, sql)
    def run(spark, sf):
        return _flat(build(stats.bounds(pool3(spark, sf), C)), "campaign", "run")

    return run


_design(
    "d1_full_factorial",
    """SELECT campaign, run, run % 3 - 1.0::DOUBLE AS c1, run // 3 % 3 - 1.0::DOUBLE AS c2,
    run // 9 % 3 - 1.0::DOUBLE AS c3 FROM limits, (SELECT unnest(range(27)) AS run)""",
    lambda b: designs.full_factorial(b, C, 3),
)
_design(
    "d2_fractional_factorial",
    f"""SELECT campaign, run, {", ".join(
        f"({s_hash("'0'", "campaign", "run", str(j))} % 3 + 0.5) * 2 / 3.0::DOUBLE - 1 AS c{j + 1}"
        for j in range(3))} FROM limits, (SELECT unnest(range(13)) AS run)""",
    lambda b: designs.fractional_factorial(b, C, 3),
)
_design(
    "d4_central_composite",
    """SELECT campaign, run,
    CASE WHEN run < 8 THEN (run // 4 % 2) * 2.0::DOUBLE - 1 WHEN run = 8 THEN 1.414::DOUBLE
         WHEN run = 9 THEN -1.414::DOUBLE ELSE 0.0::DOUBLE END AS c1,
    CASE WHEN run < 8 THEN (run // 2 % 2) * 2.0::DOUBLE - 1 WHEN run = 10 THEN 1.414::DOUBLE
         WHEN run = 11 THEN -1.414::DOUBLE ELSE 0.0::DOUBLE END AS c2,
    CASE WHEN run < 8 THEN (run % 2) * 2.0::DOUBLE - 1 WHEN run = 12 THEN 1.414::DOUBLE
         WHEN run = 13 THEN -1.414::DOUBLE ELSE 0.0::DOUBLE END AS c3
    FROM limits, (SELECT unnest(range(15)) AS run)""",
    lambda b: designs.central_composite(b, C, 3),
)
_design(
    "d5_box_behnken",
    """SELECT campaign, run,
    CASE WHEN run < 8 THEN CASE WHEN run % 4 >= 2 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END
         ELSE 0.0::DOUBLE END AS c1,
    CASE WHEN run < 4 THEN CASE WHEN run % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END
         WHEN run < 8 THEN 0.0::DOUBLE
         WHEN run < 12 THEN CASE WHEN run % 4 >= 2 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END
         ELSE 0.0::DOUBLE END AS c2,
    CASE WHEN run BETWEEN 4 AND 11 THEN CASE WHEN run % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END
         ELSE 0.0::DOUBLE END AS c3
    FROM limits, (SELECT unnest(range(13)) AS run)""",
    lambda b: designs.box_behnken(b, C, 3),
)


@query(
    "d3_plackett_burman",
    f"""WITH {POOL3}, {LIMITS3}
    SELECT campaign, run, {", ".join(
        f"CASE WHEN run = 3 THEN -1.0::DOUBLE ELSE [1.0::DOUBLE, 1.0::DOUBLE, -1.0::DOUBLE]"
        f"[CAST(({j} - run + 3) % 3 + 1 AS INTEGER)] END AS x{j + 1}" for j in range(3))}
    FROM limits, (SELECT unnest(range(4)) AS run)""",
)
def d3(spark, sf):
    return _flat(
        designs.plackett_burman(stats.bounds(pool3(spark, sf), C), C, 3), "campaign", "run"
    )


LHS_RUNS = f"""slots AS (SELECT *, least(50, n // 2) AS m, unnest(range(least(50, n // 2))) AS run
      FROM limits),
    lhs AS ({lhs_sql("slots", "campaign", "run", "m", "0", 3)}),
    runs AS (SELECT campaign, run, {", ".join(f"a{j} + (b{j} - a{j}) * u{j} AS r{j}" for j in (1, 2, 3))}
      FROM lhs)"""


@query(
    "d6_lhs_design",
    f"""WITH {POOL3}, {LIMITS3}, {LHS_RUNS}
    SELECT campaign, run, round(r1, 6) AS x1, round(r2, 6) AS x2, round(r3, 6) AS x3 FROM runs""",
)
def d6(spark, sf):
    return _flat(
        designs.lhs_runs(_limits(pool3(spark, sf)), C, F.col("rows"), 3, max_runs=50), "campaign", "run"
    )


@query(
    "d7_decode_design",
    f"""WITH {POOL3}, {LIMITS3} SELECT campaign, point_id,
    {", ".join(f"round(a{j} + (x3 / 100 + 1) / 2.0::DOUBLE * (b{j} - a{j}), 6) AS x{j}" for j in (1, 2, 3))}
    FROM pool JOIN limits USING (campaign)""",
)
def d7(spark, sf):
    p = pool3(spark, sf)
    code = F.array(*[F.col("x")[2] / 100] * 3)
    decoded = p.join(stats.bounds(p, C), C).withColumn(
        "x", designs.decode_design(code, F.col("low"), F.col("high"))
    )
    return _flat(decoded, "campaign", "point_id")


MATCHED = f"""{POOL3}, {LIMITS3}, {LHS_RUNS},
    near AS (SELECT r.campaign, r.run, p.point_id FROM runs r JOIN pool p ON r.campaign = p.campaign
      QUALIFY row_number() OVER (PARTITION BY r.campaign, r.run ORDER BY
        sqrt(power(r1 - x1, 2) + power(r2 - x2, 2) + power(r3 - x3, 2)), p.point_id) = 1),
    firsts AS (SELECT campaign, point_id, min(run) AS run FROM near GROUP BY 1, 2)"""


def _matched(spark, sf):
    p = pool3(spark, sf)
    runs = designs.lhs_runs(_limits(p), C, F.col("rows"), 3, max_runs=50)
    near = neighbours.knn(runs, p, 1, C, "run", "point_id")
    return p, neighbours.first_occurrence(near, C)


@query("w10_first_occurrence", f"WITH {MATCHED} SELECT campaign, point_id, run FROM firsts")
def w10(spark, sf):
    return _matched(spark, sf)[1]


ORDER = f"""ord AS (SELECT p.campaign, p.point_id, p.y,
      CASE WHEN f.point_id IS NULL THEN 1 ELSE 0 END AS tier,
      {s_hash("'21'", "'order'", "p.campaign", "p.point_id")} AS u
      FROM pool p LEFT JOIN firsts f USING (campaign, point_id))"""


@query(
    "d8_design_order",
    f"""WITH {MATCHED}, {ORDER} SELECT campaign, point_id, tier, u,
    row_number() OVER (PARTITION BY campaign ORDER BY tier, u, point_id) AS position FROM ord""",
)
def d8(spark, sf):
    p, firsts = _matched(spark, sf)
    return designs.visiting_position(designs.design_order(p, firsts, C, 21), C)


@query(
    "w9_steps_design",
    f"""WITH {MATCHED}, {ORDER}, pos AS (SELECT *, row_number() OVER
      (PARTITION BY campaign ORDER BY tier, u, point_id) AS position FROM ord)
    SELECT campaign, position, CAST(ceil(position / 10.0) AS BIGINT) AS steps_to_target FROM pos
    QUALIFY row_number() OVER (PARTITION BY campaign ORDER BY y DESC, point_id) = 1""",
)
def w9(spark, sf):
    p, firsts = _matched(spark, sf)
    order = designs.design_order(p, firsts, C, 21)
    return designs.steps_from_order(order, generate.target_points(p, C), C, 10)


@query(
    "m24_random_order_steps",
    f"""WITH {POOL}, pos AS (SELECT *, row_number() OVER (PARTITION BY campaign
      ORDER BY {s_hash("'17'", "'order'", "campaign", "point_id")}, point_id) AS position FROM pool)
    SELECT campaign, position, position AS steps_to_target FROM pos
    QUALIFY row_number() OVER (PARTITION BY campaign ORDER BY y DESC, point_id) = 1""",
)
def m24(spark, sf):
    p = pool(spark, sf)
    order = designs.random_order(p, C, 17)
    return designs.steps_from_order(order, generate.target_points(p, C), C, 1)


def greedy_sql(source: str) -> str:
    """Three-level design of three factors over ``source``, its runs matched in order (``greedy``)."""
    levels = ("run % 3", "run // 3 % 3", "run // 9 % 3")
    place = ", ".join(
        f"a{j} + ({c}) / 2.0::DOUBLE * (b{j} - a{j}) AS r{j}" for j, c in enumerate(levels, 1)
    )
    return f"""span AS (SELECT campaign, min(x1) a1, max(x1) b1, min(x2) a2, max(x2) b2, min(x3) a3,
      max(x3) b3 FROM {source} GROUP BY 1),
    grid AS (SELECT campaign, run, {place} FROM span, (SELECT unnest(range(27)) AS run)),
    nearest AS (SELECT g.campaign, g.run, p.point_id, row_number() OVER (PARTITION BY g.campaign, g.run
        ORDER BY sqrt(power(r1 - x1, 2) + power(r2 - x2, 2) + power(r3 - x3, 2)), p.point_id) AS nn
      FROM grid g JOIN {source} p ON g.campaign = p.campaign QUALIFY nn <= 10),
    choices AS (SELECT campaign, run, list(point_id ORDER BY nn) AS c FROM nearest GROUP BY 1, 2),
    greedy AS (SELECT DISTINCT campaign, -1::BIGINT AS run, NULL::BIGINT AS point_id, []::BIGINT[] AS used
        FROM choices
      UNION ALL
      SELECT campaign, run, pick, list_append(used, pick) FROM (SELECT l.campaign, l.run, g.used,
          coalesce(list_filter(l.c, lambda p: NOT list_contains(g.used, p))[1], l.c[1]) AS pick
        FROM greedy g JOIN choices l ON l.campaign = g.campaign AND l.run = g.run + 1))"""


@query(
    "j7_match_design",
    f"WITH RECURSIVE {POOL3}, {greedy_sql('pool')} SELECT campaign, run, point_id FROM greedy WHERE run >= 0",
)
def j7(spark, sf):
    """Greedy unique matching of a full factorial design."""
    p = pool3(spark, sf)
    return neighbours.match_design(designs.full_factorial(stats.bounds(p, C), C, 3), p, C)


@query(
    "j7_match_rounds",
    f"WITH RECURSIVE {POOL3}, {greedy_sql('pool')} SELECT campaign, run, point_id FROM greedy WHERE run >= 0",
)
def j7_rounds(spark, sf):
    """The same matching in rounds of proposals, as for campaigns that no task may hold."""
    p = pool3(spark, sf)
    runs = designs.full_factorial(stats.bounds(p, C), C, 3)
    return neighbours.match_design(runs, p, C, group_runs=0)


@query(
    "j6_knn",
    f"""WITH {VECTORS}
    SELECT a.vec_id AS query_id, b.vec_id AS point_id,
      round(sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: power(p[1] - p[2], 2)))), 6)
        AS distance,
      CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY
        sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: power(p[1] - p[2], 2)))), b.vec_id)
        AS INTEGER) AS nn
    FROM vectors a, vectors b QUALIFY nn <= 10""",
)
def j6(spark, sf):
    v = vectors(spark, sf)
    q = v.withColumnRenamed("vec_id", "query_id")
    return rounded(neighbours.knn(q, v.withColumnRenamed("vec_id", "point_id"), 10))


@query(
    "j6_knn_tree",
    f"""WITH {VECTORS}
    SELECT a.vec_id AS query_id, b.vec_id AS point_id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY
        sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: power(p[1] - p[2], 2)))), b.vec_id)
        AS INTEGER) AS nn
    FROM vectors a, vectors b QUALIFY nn <= 10""",
)
def j6_tree(spark, sf):
    """The same neighbours through the pivot tree, as for bases larger than a tile."""
    v = vectors(spark, sf)
    q = v.withColumnRenamed("vec_id", "query_id")
    found = neighbours.knn(q, v.withColumnRenamed("vec_id", "point_id"), 10, base_tile=256)
    return found.select("query_id", "point_id", "nn")


@query("j6_knn_lsh")
def j6_lsh(spark, sf):
    """Neighbours by hashed buckets, and per row how many of the exact ten are among them."""
    v = vectors(spark, sf)
    q, b = v.withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "point_id")
    found = cut_lineage(neighbours.approximate_knn(q, b, 10, bucket=0.5, tables=12), "found")
    exact = neighbours.knn(q, b, 10).select("query_id", "point_id", F.lit(1).alias("hit"))
    return (
        found.join(exact, ["query_id", "point_id"], "left")
        .groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("n_found"), F.count("hit").alias("n_exact"))
    )


@query(
    "j6_knn_by_campaign",
    f"""WITH {POOL3} SELECT a.campaign, a.point_id AS query_id, b.point_id,
      round(sqrt(power(a.x1 - b.x1, 2) + power(a.x2 - b.x2, 2) + power(a.x3 - b.x3, 2)), 6) AS distance,
      CAST(row_number() OVER (PARTITION BY a.campaign, a.point_id ORDER BY
        sqrt(power(a.x1 - b.x1, 2) + power(a.x2 - b.x2, 2) + power(a.x3 - b.x3, 2)), b.point_id)
        AS INTEGER) AS nn
    FROM pool a JOIN pool b ON a.campaign = b.campaign QUALIFY nn <= 3""",
)
def j6_keyed(spark, sf):
    p = pool3(spark, sf)
    return rounded(neighbours.knn(p.withColumnRenamed("point_id", "query_id"), p, 3, C))


@query(
    "j8_drop_evaluated",
    f"""WITH {POOL}, l AS (SELECT campaign, min(x1) a1, max(x1) b1, min(x2) a2, max(x2) b2 FROM pool
      GROUP BY 1),
    unit AS (SELECT p.*, round((x1 - a1) / (b1 - a1), 12) AS q1, round((x2 - a2) / (b2 - a2), 12) AS q2
      FROM pool p JOIN l USING (campaign))
    SELECT campaign, point_id FROM unit c WHERE NOT EXISTS (SELECT 1 FROM unit h
      WHERE h.campaign = c.campaign AND h.point_id % 3 = 0 AND h.q1 = c.q1 AND h.q2 = c.q2)""",
)
def j8(spark, sf):
    p = pool(spark, sf)
    history = p.where("point_id % 3 = 0")
    return neighbours.drop_evaluated(p, history, stats.bounds(p, C), C).select(
        "campaign", "point_id"
    )


@query(
    "j9_hidden_points",
    f"""WITH {POOL}, {split_sql("0.95", "5")} SELECT campaign, point_id FROM split WHERE hidden""",
)
def j9(spark, sf):
    split = generate.hide_split(pool(spark, sf), C, 0.95, 5)
    revealed = split.where("NOT hidden")
    return selection.hidden_points(pool(spark, sf), revealed, C).select("campaign", "point_id")


@query(
    "w8_sanitize_batch",
    f"""WITH {POOL}, {split_sql("0.95", "5")},
    props AS (SELECT campaign, point_id, min(point_id % 100) AS o FROM pool
              WHERE point_id % 25 = 0 GROUP BY 1, 2),
    hid AS (SELECT campaign, point_id FROM split WHERE hidden),
    both_ AS (
      SELECT campaign, point_id, 0 AS tier, o FROM props SEMI JOIN hid USING (campaign, point_id)
      UNION ALL
      SELECT campaign, point_id, 1, {s_hash("'31'", "campaign", "point_id")} FROM hid
      ANTI JOIN props USING (campaign, point_id))
    SELECT campaign, point_id, CAST(row_number() OVER w AS INTEGER) AS batch_position,
      tier = 1 AS is_fill FROM both_ WINDOW w AS (PARTITION BY campaign ORDER BY tier, o, point_id)
    QUALIFY row_number() OVER w <= 10""",
)
def w8(spark, sf):
    p = pool(spark, sf)
    split = generate.hide_split(p, C, 0.95, 5)
    # Every proposal is made twice, at two positions.
    once = p.where("point_id % 25 = 0").select(
        "campaign", "point_id", (F.col("point_id") % 100).alias("position")
    )
    twice = once.unionByName(once.withColumn("position", F.col("position") + 1000))
    return selection.sanitize_batch(twice, split.where("hidden"), C, 10, 31)
