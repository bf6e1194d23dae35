"""Views of the driver's tables in the shapes the operators expect, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as competition results: priority is the optimizer, the customer the instance."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    dataset = F.concat(F.lit("nation"), F.col("c_nationkey").cast("string"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        dataset.alias("dataset"),
        F.lit("Batch1").alias("batch"),
        F.col("o_custkey").alias("competition_idx"),
        F.col("o_orderpriority").alias("optimizer"),
        F.concat(dataset, F.lit("_Batch1_comp"), F.col("o_custkey").cast("string")).alias(
            "instance"
        ),
        F.col("o_totalprice").alias("final_best"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("steps_to_target"),
        (F.col("o_orderstatus") != "P").alias("found_target"),
        F.col("o_orderstatus").alias("pool"),
    )


RESULTS = """results AS (
  SELECT 'nation' || c_nationkey AS dataset, 'Batch1' AS batch, o_custkey AS competition_idx,
         o_orderpriority AS optimizer,
         'nation' || c_nationkey || '_Batch1_comp' || o_custkey AS instance,
         o_totalprice AS final_best,
         CAST(floor(o_totalprice / 1000) AS INTEGER) AS steps_to_target,
         o_orderstatus <> 'P' AS found_target, o_orderstatus AS pool
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

MEANS = """means AS (
  SELECT instance, optimizer, avg(final_best) AS value FROM results GROUP BY 1, 2)"""

BLOCKS = """blocks AS (
  SELECT instance, optimizer, value FROM means
  QUALIFY count(*) OVER (PARTITION BY instance)
          = (SELECT count(DISTINCT optimizer) FROM means))"""


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidate points: one campaign per brand, two features and a label."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("campaign"),
        F.col("p_partkey").alias("point_id"),
        F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("x"),
        (F.col("p_retailprice") + F.col("p_size") * 3).alias("y"),
    )


POOL = """pool AS (
  SELECT p_brand AS campaign, p_partkey AS point_id, CAST(p_size AS DOUBLE) AS x1,
         p_retailprice AS x2, p_retailprice + p_size * 3 AS y FROM part)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trajectories: user and type are the run, the hour of the month is the step."""
    hour = F.floor(F.unix_timestamp("ts") / 3600) - F.lit(473352)
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("event_type").alias("optimizer"),
            F.col("user_id").alias("run"),
            hour.cast("int").alias("step"),
        )
        .agg(F.max("value").alias("value"))
    )


RUNS = """runs AS (
  SELECT event_type AS optimizer, user_id AS run,
         CAST(floor(epoch(ts) / 3600) - 473352 AS INTEGER) AS step, max(value) AS value
  FROM events GROUP BY 1, 2, 3)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as feature vectors with the class as label."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y")
    )


VECTORS = """vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CAST(label AS DOUBLE) AS y FROM embeddings)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[
            F.round(F.col(c) + F.lit(0.0), digits).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def pool3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool with a third feature, for designs and matching."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("campaign"),
        F.col("p_partkey").alias("point_id"),
        F.array(
            F.col("p_size").cast("double"),
            F.col("p_retailprice") / 10,
            F.length("p_name").cast("double"),
        ).alias("x"),
        (F.col("p_retailprice") + F.col("p_size") * 3).alias("y"),
    )


POOL3 = """pool AS (
  SELECT p_brand AS campaign, p_partkey AS point_id, CAST(p_size AS DOUBLE) AS x1,
         p_retailprice / 10 AS x2, CAST(length(p_name) AS DOUBLE) AS x3,
         p_retailprice + p_size * 3 AS y FROM part)"""

LIMITS3 = """limits AS (
  SELECT campaign, min(x1) a1, max(x1) b1, min(x2) a2, max(x2) b2, min(x3) a3, max(x3) b3,
         count(*) AS n FROM pool GROUP BY 1)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a predicted mean and deviation taken from their order lines."""
    lines = table(spark, sf_dir, "lineitem")
    stats = lines.groupBy(F.col("l_partkey").alias("point_id")).agg(
        (F.avg("l_extendedprice") / 1000).alias("mean"),
        (F.stddev_pop("l_extendedprice") / 1000).alias("std"),
        F.var_pop("l_quantity").alias("noise_var"),
    )
    part = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("campaign"), F.col("p_partkey").alias("point_id")
    )
    return part.join(stats, "point_id")


PREDICTIONS = """stats AS (
  SELECT l_partkey AS point_id, avg(l_extendedprice) / 1000 AS mean,
         stddev_pop(l_extendedprice) / 1000 AS std, var_pop(l_quantity) AS noise_var
  FROM lineitem GROUP BY 1),
predictions AS (
  SELECT p_brand AS campaign, s.* FROM part JOIN stats s ON p_partkey = point_id),
best AS (SELECT campaign, max(mean) AS best FROM predictions GROUP BY 1)"""
