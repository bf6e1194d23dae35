"""Whole protocols and the dataset registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrial.operators import generate, prep, stats
from fieldtrial.operators.campaign_models import campaign_posterior
from fieldtrial.operators.neighbours import knn
from fieldtrial.operators.selection import select_batch
from fieldtrial.plans import protocols
from fieldtrial.sources import catalog

from .generation_queries import greedy_sql, split_sql
from .inputs import POOL, POOL3, pool, pool3, rounded
from .registry import query, s_hash, table

C = ["campaign"]


@query(
    "s3_catalog",
    """SELECT p_partkey, [CAST(p_size AS DOUBLE)] AS x, round(ln(1 + p_retailprice), 6) AS y,
    0.0::DOUBLE AS y_var FROM part""",
)
def s3(spark, sf):
    """A registered specification read through its view."""
    spec = catalog.DatasetSpec(
        "parts_by_name", "p_retailprice", None, ("p_size",), transform="log1p", variance_kind="zero"
    )
    catalog.register(prep.to_xy(table(spark, sf, "part"), spec, ["p_partkey"]), spec)
    return rounded(spark.table(spec.name))


@query(
    "m23_hide_the_label_random",
    f"""WITH {POOL}, {split_sql("0.95", "42")},
    pos AS (SELECT *, row_number() OVER (PARTITION BY campaign
      ORDER BY {s_hash("'42'", "'order'", "campaign", "point_id")}, point_id) AS position
      FROM split WHERE hidden)
    SELECT campaign, position, CAST(ceil(position / 10.0) AS BIGINT) AS steps_to_target
    FROM pos WHERE is_target""",
)
def htl_random(spark, sf):
    return protocols.hide_the_label_order(pool(spark, sf), "RANDOM", C, 2, 0.95, batch=10)


@query(
    "m23_hide_the_label_design",
    f"""WITH RECURSIVE {POOL3}, {split_sql("0.95", "42")}, hid AS (SELECT * FROM split WHERE hidden),
    {greedy_sql("hid")},
    pos AS (SELECT h.campaign, h.is_target, row_number() OVER (PARTITION BY h.campaign
      ORDER BY CASE WHEN f.point_id IS NULL THEN 1 ELSE 0 END,
      {s_hash("'42'", "'order'", "h.campaign", "h.point_id")}, h.point_id) AS position
      FROM hid h LEFT JOIN (SELECT DISTINCT campaign, point_id FROM greedy WHERE run >= 0) f
      ON h.campaign = f.campaign AND h.point_id = f.point_id)
    SELECT campaign, position, CAST(ceil(position / 10.0) AS BIGINT) AS steps_to_target
    FROM pos WHERE is_target""",
)
def htl_design(spark, sf):
    """Full factorial strategy."""
    return protocols.hide_the_label_order(pool3(spark, sf), "FULL_FACTORIAL", C, 3, 0.95, batch=10)


def _scaled_split(spark, sf):
    p = pool(spark, sf)
    split = generate.hide_split(p, C, 0.9, 5)
    scaled = prep.scale_pm1(split, stats.bounds(p, C), C)
    return scaled.where("NOT hidden"), scaled.where("hidden")


@query("m8_campaign_posterior")
def posterior(spark, sf):
    """One kernel model per brand, fitted on the revealed and evaluated on the hidden parts."""
    observed, hidden = _scaled_split(spark, sf)
    out = campaign_posterior(observed, hidden, C)
    return out.select("campaign", "point_id", "mean", "std")


@query("m23_gp_ei_round")
def gp_round(spark, sf):
    """One selection round by expected improvement for every brand."""
    observed, hidden = _scaled_split(spark, sf)
    picks = select_batch(protocols.gp_ei(C)(hidden, observed), C, 10)
    return picks.select("campaign", "point_id", "score", "batch_position")


@query("m23_open_race")
def race(spark, sf):
    """Open Race over the range of every brand; a point's value is that of the nearest part."""
    known = pool(spark, sf)
    limits = stats.bounds(known, C)

    def evaluate(df):
        near = knn(df.withColumnRenamed("point_id", "query_id"), known, 1, C)
        value = near.join(known.select("campaign", "point_id", "y"), ["campaign", "point_id"])
        return df.join(
            value.select("campaign", F.col("query_id").alias("point_id"), "y"), ["campaign", "point_id"]
        )

    def by_first(hidden, observed):
        return hidden.withColumn("score", F.col("x")[0])

    return protocols.open_race(limits, evaluate, by_first, C, 2, budget=60, initial=10, batch=20)
