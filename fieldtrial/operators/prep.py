"""Column preparation: features, targets, scaling, keys and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import unit_scale
from ..session import join_small
from ..sources.catalog import DatasetSpec


def drop_admin(df: DataFrame, cols: Sequence[str] = ("Unnamed: 0", "Round", "Fidelity")):
    """Drop bookkeeping columns; missing ones are ignored."""
    return df.drop(*cols)


def _named(c: str) -> Column:
    return F.col(f"`{c}`")


def to_xy(df: DataFrame, spec: DatasetSpec, keep: Sequence[str] = ()) -> DataFrame:
    """Feature array ``x``, target ``y`` and target variance ``y_var``.

    Without a feature list every column except target and variance is a feature. A missing
    variance is 0, a stored deviation is squared.
    """
    df = drop_admin(df, spec.drop)
    outside = {spec.target, spec.variance, *keep}
    features = spec.features or [c for c in df.columns if c not in outside]
    y = _named(spec.target).cast("double")
    if spec.transform == "log1p":
        y = log1p_target(y)
    elif spec.transform == "log_ratio":
        y = log_ratio_target(y, _named(spec.control).cast("double"))
    if spec.variance_kind == "zero" or spec.variance not in df.columns:
        var = F.lit(0.0)
    elif spec.variance_kind == "deviation":
        var = F.pow(_named(spec.variance).cast("double"), F.lit(2.0))
    else:
        var = _named(spec.variance).cast("double")
    x = F.array(*[_named(c).cast("double") for c in features])
    return df.select(*[_named(c) for c in keep], x.alias("x"), y.alias("y"), var.alias("y_var"))


def log1p_target(y: Column) -> Column:
    return F.log1p(y)


def log_ratio_target(y: Column, control: Column) -> Column:
    """ln(1 + y / control) with the control value of the same row; null for a zero control."""
    return F.log1p(F.try_divide(y, control))


def clean_variance(col: Column, jitter: float = 1e-6) -> Column:
    """NaN variance becomes the jitter, which is then added to every variance."""
    return F.nanvl(col, F.lit(jitter)) + F.lit(jitter)


def fit_scaler(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation per coordinate; a constant coordinate divides by 1."""
    parts = (
        df.select(*keys, F.posexplode("x").alias("dim", "v"))
        .groupBy(*keys, "dim")
        .agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        .withColumn("s", F.when(F.col("s") > 0, F.col("s")).otherwise(F.lit(1.0)))
    )
    # One row per coordinate.
    ordered = F.array_sort(F.collect_list(F.struct("dim", "m", "s")))
    return (
        parts.groupBy(*keys)
        .agg(ordered.alias("_s"))
        .select(*keys, F.col("_s.m").alias("mean"), F.col("_s.s").alias("scale"))
    )


def apply_scaler(df: DataFrame, scaler: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    centred = F.zip_with("x", "mean", lambda v, m: v - m)
    joined = _with_small(df, scaler, keys)
    return joined.withColumn("x", F.zip_with(centred, "scale", lambda v, s: v / s)).drop(
        "mean", "scale"
    )


def _with_small(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach per-key parameters; without keys ``small`` is one row."""
    if keys:
        return join_small(df, small, keys)
    one = F.broadcast(small.limit(1).withColumn("_one", F.lit(1)))
    return df.withColumn("_one", F.lit(1)).join(one, "_one").drop("_one")


def scale_pm1(df: DataFrame, limits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Coordinates mapped to [-1, 1] by their minimum and maximum, constants to 0."""
    unit = unit_scale(F.col("x"), F.col("low"), F.col("high"))
    flat = F.zip_with("low", "high", lambda a, b: b > a)
    return (
        _with_small(df, limits, keys)
        .withColumn(
            "x", F.zip_with(unit, flat, lambda u, ok: F.when(ok, 2 * u - 1).otherwise(F.lit(0.0)))
        )
        .drop("low", "high")
    )


def parse_result_name(name: Column) -> tuple[Column, Column]:
    """Dataset and batch encoded in a result file name.

    The dataset is everything before the token ``Hard`` or ``Easy``; the batch is the first token
    that starts with ``Batch``. Both default to ``Unknown``.
    """
    parts = F.split(F.replace(name, F.lit(".json"), F.lit("")), "_")
    hits = F.filter(
        F.array(F.array_position(parts, "Hard"), F.array_position(parts, "Easy")), lambda p: p > 0
    )
    first = F.array_min(hits)
    dataset = F.when(
        first > 1, F.array_join(F.slice(parts, F.lit(1), first.cast("int") - 1), "_")
    ).otherwise(F.lit("Unknown"))
    batch = F.coalesce(
        F.get(F.filter(parts, lambda p: p.startswith("Batch")), F.lit(0)), F.lit("Unknown")
    )
    return dataset, batch


def instance_key(dataset: Column, batch: Column, index: Column) -> Column:
    return F.concat(dataset, F.lit("_"), batch, F.lit("_comp"), index.cast("string"))


def final_best(values: Column, history: Column, scalar: Column) -> Column:
    """Last of the value list, else the last history record, else the single value."""
    return (
        F.when(F.size(values) > 0, F.element_at(values, -1))
        .when(F.size(history) > 0, F.element_at(history, -1)["best_value_so_far"])
        .otherwise(scalar)
    )


# Optimizer groups in display order.
CATEGORIES = [
    (
        "Classical Design Approaches (DOE)",
        [
            "FULL_FACTORIAL", "CENTRAL_COMPOSITE", "FRACTIONAL_FACTORIAL", "BOX_BEHNKEN",
            "LATIN_HYPERCUBE", "PLACKETT_BURMAN", "D_OPTIMAL",
        ],
    ),
    ("Direct Heuristic Search", ["RANDOM", "DE_DIRECT"]),
    (
        "Surrogate-Assisted Optimization",
        ["BO_GP_EI", "SBO_GP_PV", "SBO_GP_EI", "SBO_GP_EI_TRUNCDE", "SMART_BO", "SBO_ANN_PV"],
    ),
]
UNKNOWN_ORDER = 9999


def category_table(spark, categories=CATEGORIES) -> DataFrame:
    rows = [
        (opt, name, i * 100 + j)
        for i, (name, opts) in enumerate(categories)
        for j, opt in enumerate(opts)
    ]
    return spark.createDataFrame(rows, "optimizer string, category string, display_order int")


def with_category(df: DataFrame, table: DataFrame) -> DataFrame:
    """Category and display order; an unknown optimizer comes last."""
    return join_small(df, table, "optimizer", "left").withColumn(
        "display_order", F.coalesce("display_order", F.lit(UNKNOWN_ORDER))
    )


def select_optimizers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of the named optimizers; unknown names are skipped, none left is an error."""
    wanted = df.sparkSession.createDataFrame([(n,) for n in names], "optimizer string")
    kept = df.join(F.broadcast(wanted), "optimizer", "left_semi")
    if kept.isEmpty():
        raise ValueError(f"no rows for any of {list(names)}")
    return kept


# Optimizers with a default step limit.
STEP_CAPS = {"RANDOM": 100_000, "DE_DIRECT": 100_000}


def apply_step_cap(df: DataFrame, caps: DataFrame) -> DataFrame:
    """Limit the steps per optimizer and mark runs that reach the limit."""
    joined = join_small(df, caps, "optimizer", "left")
    steps = F.least(F.col("steps_to_target"), F.col("max_steps"))
    return joined.withColumn("steps_to_target", steps).withColumn(
        "max_steps_capped",
        F.col("max_steps").isNotNull() & (F.col("steps_to_target") >= F.col("max_steps")),
    ).drop("max_steps")
