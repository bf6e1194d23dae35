"""Summary statistics and rankings over the long results frame.

The results frame has one row per (dataset, batch, competition_idx, optimizer) with an
``instance`` key and a metric column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import join_small
from .exact import HOT_ROWS, agg_with_quantiles, finite, hot_groups


# Optimizers ranked and paired inside one row.
MAX_WIDE = 32


def _clean(df: DataFrame, *metrics: str) -> DataFrame:
    for m in metrics:
        if dict(df.dtypes)[m] in ("double", "float"):
            df = df.withColumn(m, finite(m))
    return df


def summary_stats(
    df: DataFrame, metric: str, digits: int = 4, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Mean, median, sample standard deviation, range and count per optimizer, rounded."""
    out = agg_with_quantiles(
        _clean(df, metric),
        ["optimizer"],
        metric,
        {"median": 0.5},
        [
            F.avg(metric).alias("mean"),
            F.stddev_samp(metric).alias("std"),
            F.min(metric).alias("min"),
            F.max(metric).alias("max"),
            F.count(metric).alias("count"),
        ],
        hot_rows,
    )
    rounded = [F.round(c, digits).alias(c) for c in ("mean", "median", "std", "min", "max")]
    return out.select("optimizer", *rounded, "count")


def dataset_level(df: DataFrame, metric: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Median per dataset and optimizer; the dataset becomes the instance."""
    return agg_with_quantiles(
        _clean(df, metric), ["dataset", "optimizer"], metric, {metric: 0.5}, (), hot_rows
    ).withColumn("instance", F.col("dataset"))


def htl_stats(
    df: DataFrame, keys: Sequence[str] = ("optimizer",), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Steps-to-target statistics with population deviations and the success rate."""
    return agg_with_quantiles(
        _clean(df, "final_best"),
        list(keys),
        "steps_to_target",
        {"median_steps": 0.5},
        [
            F.avg("steps_to_target").alias("mean_steps"),
            F.stddev_pop("steps_to_target").alias("std_steps"),
            F.min("steps_to_target").alias("min_steps"),
            F.max("steps_to_target").alias("max_steps"),
            F.avg(F.col("found_target").cast("double")).alias("success_rate"),
            F.avg("final_best").alias("mean_final_best"),
            F.stddev_pop("final_best").alias("std_final_best"),
            F.count(F.lit(1)).alias("n_competitions"),
        ],
        hot_rows,
    )


def htl_across_pools(pool_stats: DataFrame) -> DataFrame:
    """Mean of the per-pool means."""
    return pool_stats.groupBy("optimizer").agg(
        F.avg("mean_steps").alias("avg_steps"),
        F.stddev_pop("mean_steps").alias("std_steps"),
        F.avg("success_rate").alias("avg_success"),
        F.avg("mean_final_best").alias("avg_final_best"),
    )


def _weighted(col: str, w: str = "n_competitions") -> Column:
    return F.sum(F.col(col) * F.col(w)) / F.sum(w)


def htl_combined(pool_stats: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pool means weighted by their competitions, as if each mean were repeated that often.

    ``pool_stats`` holds one row per pool and optimizer.
    """
    mean = pool_stats.groupBy("optimizer").agg(
        _weighted("mean_steps").alias("_m"), _weighted("mean_final_best").alias("_f")
    )
    counted = F.col("n_competitions") > 0
    # Centred second moments avoid cancellation.
    spread = join_small(pool_stats, mean, "optimizer")
    out = spread.groupBy("optimizer").agg(
        _weighted("mean_steps").alias("mean_steps"),
        _weighted_deviation("mean_steps", "_m").alias("std_steps"),
        F.min(F.when(counted, F.col("mean_steps"))).alias("min_steps"),
        F.max(F.when(counted, F.col("mean_steps"))).alias("max_steps"),
        _weighted("success_rate").alias("success_rate"),
        _weighted("mean_final_best").alias("mean_final_best"),
        _weighted_deviation("mean_final_best", "_f").alias("std_final_best"),
    )
    return out.join(_weighted_median(pool_stats.where(counted), hot_rows), "optimizer", "left")


def _weighted_median(pool_stats: DataFrame, hot_rows: int) -> DataFrame:
    """Median of the means, each repeated as often as its pool has competitions."""
    value, w = F.col("mean_steps"), F.col("n_competitions")
    times = pool_stats.where(value.isNotNull()).groupBy("optimizer", "mean_steps").agg(
        F.sum("n_competitions").cast("bigint").alias("n_competitions")
    )
    if hot_groups(times, ["optimizer"], hot_rows).isEmpty():
        return times.groupBy("optimizer").agg(F.percentile(value, F.lit(0.5), w).alias("median_steps"))
    # Values in blocks of the hot group's quantiles, each summed alone and shifted.
    steps = times.withColumn("_block", F.floor(value).cast("bigint"))
    sums = steps.groupBy("optimizer", "_block").agg(F.sum(w).alias("_n"))
    order = W.partitionBy("optimizer").orderBy("_block")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(W.partitionBy("optimizer"))
    placed = steps.join(
        sums.select("optimizer", "_block", before.alias("_before"), total.alias("_total")),
        ["optimizer", "_block"],
    )
    inside = F.sum(w).over(
        W.partitionBy("optimizer", "_block").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    )
    reached = placed.withColumn("_upto", F.col("_before") + inside)
    low = F.min(F.when(F.col("_upto") * 2 >= F.col("_total"), value))
    high = F.min(F.when(F.col("_upto") * 2 > F.col("_total"), value))
    return reached.groupBy("optimizer").agg(((low + high) / 2).alias("median_steps"))


def _weighted_deviation(col: str, centre: str, w: str = "n_competitions") -> Column:
    away = F.pow(F.col(col) - F.col(centre), F.lit(2))
    return F.sqrt(F.sum(F.col(w) * away) / F.sum(w))


def or_stats(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Best-value statistics per optimizer with the population deviation."""
    return agg_with_quantiles(
        _clean(df, "best_value"),
        ["optimizer"],
        "best_value",
        {"median_best_value": 0.5},
        [
            F.avg("best_value").alias("mean_best_value"),
            F.stddev_pop("best_value").alias("std_best_value"),
            F.min("best_value").alias("min_best_value"),
            F.max("best_value").alias("max_best_value"),
            F.count("best_value").alias("n_competitions"),
        ],
        hot_rows,
    )


def all_best_values(df: DataFrame) -> DataFrame:
    """Every best value, one row each, so that no optimizer's values sit in one row."""
    return df.select("optimizer", "instance", "best_value")


def mean_se(df: DataFrame, metric: str) -> DataFrame:
    """Mean and standard error; one value has error 0."""
    return (
        _clean(df, metric)
        .where(F.col(metric).isNotNull())
        .groupBy("optimizer")
        .agg(
            F.avg(metric).alias("mean"),
            F.coalesce(
                F.stddev_samp(metric) / F.sqrt(F.count(metric)), F.lit(0.0)
            ).alias("se"),
            F.count(metric).alias("n"),
        )
    )


def se_from_summary(df: DataFrame, std: str = "std_steps", n: str = "n") -> DataFrame:
    """Standard error from a stored deviation and count."""
    return df.withColumn(
        "se",
        F.when(
            (F.col(n) > 0) & F.col(std).isNotNull(), F.col(std) / F.sqrt(F.col(n))
        ).otherwise(F.lit(0.0)),
    )


def regression_fit(
    df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()
) -> DataFrame:
    """R-squared and mean squared error in one pass; a constant label has no R-squared."""
    y, p = F.col(label), F.col(prediction)
    spread = F.var_pop(y) * F.count(y)
    return df.groupBy(*keys).agg(
        F.avg((y - p) * (y - p)).alias("mse"),
        F.when(spread > 0, F.lit(1.0) - F.sum((y - p) * (y - p)) / spread).alias("r2"),
        F.count(y).alias("n"),
    )


def dataset_info(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, feature count and target statistics of a (features, y) table."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.max(F.size("x")).alias("n_features"),
        F.min("y").alias("y_min"),
        F.max("y").alias("y_max"),
        F.avg("y").alias("y_mean"),
        F.stddev_pop("y").alias("y_std"),
    )


def bounds(df: DataFrame, keys: Sequence[str] = (), pad: float = 0.0) -> DataFrame:
    """Per-coordinate minimum and maximum, optionally widened by a share of the range."""
    sides = (
        df.select(*keys, F.posexplode("x").alias("dim", "v"))
        .groupBy(*keys, "dim")
        .agg(F.min("v").alias("a"), F.max("v").alias("b"))
        .withColumn("low", F.col("a") - F.lit(pad) * (F.col("b") - F.col("a")))
        .withColumn("high", F.col("b") + F.lit(pad) * (F.col("b") - F.col("a")))
    )
    # At most one row per coordinate is collected into each array.
    ordered = F.array_sort(F.collect_list(F.struct("dim", "low", "high")))
    return (
        sides.groupBy(*keys)
        .agg(ordered.alias("_s"))
        .select(*keys, F.col("_s.low").alias("low"), F.col("_s.high").alias("high"))
    )


def fingerprint(df: DataFrame, keys: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """md5 over shape, mean, deviation, minimum and maximum of the features and the target."""
    flat = df.select(*keys, F.explode("x").alias("v"))
    fx = flat.groupBy(*keys).agg(*_moments("v", "x"))
    fy = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"), *_moments("y", "y")
    )
    both = fx.join(fy, list(keys)) if keys else _one_row(fx, fy)
    cols = ["x_mean", "x_std", "x_min", "x_max", "y_mean", "y_std", "y_min", "y_max"]
    text = [F.format_string(f"%.{digits}f", F.col(c) + F.lit(0.0)) for c in cols]
    return both.select(
        *keys,
        F.md5(F.concat_ws("|", F.col("n").cast("string"), F.col("d").cast("string"), *text)).alias(
            "fingerprint"
        ),
    )


def _moments(col: str, prefix: str) -> list[Column]:
    return [
        F.avg(col).alias(f"{prefix}_mean"),
        F.stddev_pop(col).alias(f"{prefix}_std"),
        F.min(col).alias(f"{prefix}_min"),
        F.max(col).alias(f"{prefix}_max"),
    ]


def _one_row(a: DataFrame, b: DataFrame) -> DataFrame:
    key = F.lit(0)
    return a.withColumn("_k", key).join(b.withColumn("_k", key), "_k").drop("_k")


def load_report(df: DataFrame) -> DataFrame:
    """Counts printed after loading a folder of results."""
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.countDistinct("optimizer").alias("optimizers"),
        F.countDistinct("instance").alias("instances"),
        F.countDistinct("dataset").alias("datasets"),
        F.countDistinct("batch").alias("batches"),
    )


def ensemble_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and deviation of an ensemble from its members' means and deviations."""
    return df.groupBy(*keys).agg(
        F.avg("mean").alias("ensemble_mean"),
        F.sqrt(F.avg(F.col("std") * F.col("std")) + F.var_pop("mean")).alias("ensemble_std"),
    )


def instance_means(df: DataFrame, metric: str) -> DataFrame:
    """One value per instance and optimizer; duplicates are averaged, NaN counts as null."""
    return (
        _clean(df, metric).groupBy("instance", "optimizer").agg(F.avg(metric).alias("value"))
    )


def optimizer_names(df: DataFrame) -> list[str] | None:
    """Sorted optimizer names, or None when there are more than ``MAX_WIDE``."""
    rows = df.select("optimizer").where(F.col("optimizer").isNotNull()).distinct()
    names = [r["optimizer"] for r in rows.limit(MAX_WIDE + 1).collect()]
    return sorted(names) if len(names) <= MAX_WIDE else None


def wide_instances(df: DataFrame, metric: str, names: Sequence[str]) -> DataFrame:
    """One row per instance: mean values and presence flags in the order of ``names``.

    One aggregation with partial sums in the map tasks; ranks and pairs are then taken within the
    row, without a sort, a window or a self-join.
    """
    data = _clean(df, metric)
    here = [F.col("optimizer") == n for n in names]
    return data.groupBy("instance").agg(
        F.array(*[F.avg(F.when(h, F.col(metric))) for h in here]).alias("values"),
        F.array(*[F.count(F.when(h, 1)) > 0 for h in here]).alias("present"),
    )


def _with_value(df: DataFrame, metric: str) -> DataFrame:
    return _clean(df, metric).where(F.col(metric).isNotNull())


def ranked_values(
    df: DataFrame, metric: str, ascending: bool = True, complete: bool = False
) -> DataFrame:
    """Value, average rank and number of equal values per instance and optimizer.

    ``complete`` keeps only instances that hold every optimizer. A handful of optimizers is ranked
    inside one row per instance; a larger set by windows.
    """
    data = _with_value(df, metric)
    names = optimizer_names(data)
    if names is None:
        means = instance_means(data, metric).where(F.col("value").isNotNull())
        if complete:
            everyone = means.agg(F.countDistinct("optimizer")).scalar()
            present = F.count(F.lit(1)).over(W.partitionBy("instance"))
            means = means.withColumn("_n", present).where(F.col("_n") == everyone).drop("_n")
        return _window_ranks(means, ascending)
    if not names:
        return instance_means(data, metric).select(
            "*", F.lit(0.0).alias("rank"), F.lit(0).cast("bigint").alias("same")
        )
    wide = wide_instances(data, metric, names)
    if complete:
        wide = wide.where(~F.exists("values", lambda v: v.isNull()))
    labelled = F.arrays_zip(
        F.array(*[F.lit(n) for n in names]).alias("optimizer"), F.col("values").alias("value")
    )
    each = wide.select("instance", "values", F.inline(labelled)).where(F.col("value").isNotNull())
    v = F.col("value")
    ahead = F.filter("values", (lambda w: w < v) if ascending else (lambda w: w > v))
    same = F.size(F.filter("values", lambda w: w == v)).cast("bigint")
    return (
        each.withColumn("same", same)
        .withColumn("rank", 1 + F.size(ahead) + (F.col("same") - 1) / F.lit(2.0))
        .select("instance", "optimizer", "value", "rank", "same")
    )


def _window_ranks(means: DataFrame, ascending: bool) -> DataFrame:
    order = F.col("value").asc() if ascending else F.col("value").desc()
    first = F.rank().over(W.partitionBy("instance").orderBy(order))
    same = F.count(F.lit(1)).over(W.partitionBy("instance", "value"))
    return means.withColumn("same", same).withColumn(
        "rank", first + (F.col("same") - 1) / F.lit(2.0)
    )


def instance_ranks(df: DataFrame, metric: str, ascending: bool = True) -> DataFrame:
    """Rank optimizers within an instance; equal values share their rank, nulls stay unranked."""
    return ranked_values(df, metric, ascending).select("instance", "optimizer", "value", "rank")


def rank_optimizers(df: DataFrame, metric: str, ascending: bool = True) -> DataFrame:
    """Average rank over instances and the resulting position, names breaking ties."""
    mean = (
        instance_ranks(df, metric, ascending)
        .groupBy("optimizer")
        .agg(F.avg("rank").alias("average_rank"))
    )
    # One row per optimizer reaches this window.
    place = F.row_number().over(W.orderBy(F.round("average_rank", 9), "optimizer"))
    return mean.withColumn("rank_position", place)


def leaderboard(df: DataFrame, by: str, ascending: bool) -> DataFrame:
    return df.orderBy(F.col(by).asc() if ascending else F.col(by).desc(), "optimizer")


def join_rank(summary: DataFrame, rankings: DataFrame, how: str = "left") -> DataFrame:
    """Summary rows with their rank, in rank order."""
    return summary.join(rankings, "optimizer", how).orderBy("rank_position")
