"""Exact quantiles, ranks and running values that never put a large group into one task.

Groups up to ``HOT_ROWS`` rows use Spark's own aggregate or window. A larger group is first cut
down: quantiles narrow it to a bracket around the wanted positions, ranks and running values
split it into blocks that are solved alone and shifted by a small table of block totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import HOT_ROWS, cut_lineage, join_small


SKETCH_ACCURACY = 100_000
PROBE_GRID = 100_000


def finite(col: Column | str) -> Column:
    """NaN as null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(c), c)


def hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)


NO_GROUP_IS_HOT = 2**62


def agg_with_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    aggs: Sequence[Column] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Grouped aggregates together with exact, linearly interpolated quantiles of ``value``."""
    if not keys:
        one = df.withColumn("_all", F.lit(0))
        return agg_with_quantiles(one, ["_all"], value, quantiles, aggs, hot_rows).drop("_all")
    hot = hot_groups(df.where(F.col(value).isNotNull()), keys, hot_rows)
    if hot.isEmpty():
        exact = [F.percentile(value, F.lit(p)).alias(n) for n, p in quantiles.items()]
        return df.groupBy(*keys).agg(*aggs, *exact)
    wide = exact_quantiles(df, keys, value, quantiles, hot_rows)
    if not aggs:
        return wide
    return df.groupBy(*keys).agg(*aggs).join(wide, list(keys), "left")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One column per named quantile, from two order statistics each."""
    data = df.where(F.col(value).isNotNull())
    counts = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    slots = F.array(
        *[F.struct(F.lit(n).alias("slot"), F.lit(float(p)).alias("p")) for n, p in quantiles.items()]
    )
    targets = (
        counts.withColumn("_s", F.explode(slots))
        .withColumn("_at", F.col("_s.p") * (F.col("_n") - 1))
        .select(
            *keys,
            "_n",
            F.col("_s.slot").alias("slot"),
            F.col("_at"),
            F.array_distinct(
                F.array(F.floor("_at").cast("long"), F.ceil("_at").cast("long"))
            ).alias("positions"),
        )
    )
    found = order_statistics(data, keys, value, targets.drop("_at"), hot_rows)
    joined = found.join(targets.select(*keys, "slot", "_at"), [*keys, "slot"])
    share = F.col("_at") - F.floor("_at")
    weight = F.when(F.col("position") == F.floor("_at"), 1 - share).otherwise(share)
    return joined.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col("slot") == n, F.col("value") * weight)).alias(n)
            for n in quantiles
        ]
    )


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    targets: DataFrame,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Values at sorted positions.

    ``targets`` has the keys, ``_n`` (rows of the group), ``slot`` and ``positions``, an array of
    0-based positions. The result has one row per key, slot and position. Equal values are
    counted, not repeated. In a group above ``hot_rows`` only the values inside a sketched
    bracket are kept, together with an exact count of those below it. A slot whose bracket missed
    a position is solved again over all values of its group.
    """
    whole = df.where(F.col(value).isNotNull())
    data = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    targets = targets.withColumn("_first", F.array_min("positions")).withColumn(
        "_last", F.array_max("positions")
    )
    slot_keys = [*keys, "slot"]
    narrow = targets.select(*slot_keys, "_n", "_first", "_last")
    hot = narrow.where(F.col("_n") > hot_rows)
    if not hot.isEmpty():
        narrow = cut_lineage(narrow, "targets")
        hot = narrow.where(F.col("_n") > hot_rows)
        data = _bracketed(data, keys, narrow, hot)
    else:
        data = join_small(data, narrow, keys)
    counted = data.groupBy(*slot_keys, "_first", "_last", "_v").agg(
        F.count(F.lit(1)).alias("_c")
    )
    upto = F.sum("_c").over(
        W.partitionBy(*slot_keys)
        .orderBy(F.col("_v").asc_nulls_first())
        .rowsBetween(W.unboundedPreceding, 0)
    )
    near = (
        counted.withColumn("_hi", upto)
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
        .where(F.col("_v").isNotNull())
        .where((F.col("_hi") > F.col("_first")) & (F.col("_lo") <= F.col("_last")))
        .select(*slot_keys, "_v", "_lo", "_hi")
    )
    wanted = targets.select(*slot_keys, "positions")
    hit = F.filter("positions", lambda p: (p >= F.col("_lo")) & (p < F.col("_hi")))
    found = join_small(near, wanted, slot_keys).select(
        *slot_keys, F.explode(hit).alias("position"), F.col("_v").alias("value")
    )
    if hot.isEmpty():
        return found
    found = cut_lineage(found, "found")
    asked = targets.select(*slot_keys, F.explode("positions").alias("position"))
    missed = cut_lineage(
        asked.join(found, [*slot_keys, "position"], "left_anti").select(*slot_keys).distinct(), "missed"
    )
    if missed.isEmpty():
        return found
    again = targets.drop("_first", "_last").join(missed, slot_keys, "left_semi")
    solved = order_statistics(whole, keys, value, again, NO_GROUP_IS_HOT)
    return found.join(missed, slot_keys, "left_anti").unionByName(solved)


def _bracketed(
    data: DataFrame, keys: Sequence[str], narrow: DataFrame, hot: DataFrame
) -> DataFrame:
    # Probes lie on a fixed grid, because percentile_approx takes constant probabilities.
    margin = 2.0 / SKETCH_ACCURACY
    low = F.floor((F.col("_first") / F.col("_n") - margin) * PROBE_GRID)
    high = F.ceil(((F.col("_last") + 1) / F.col("_n") + margin) * PROBE_GRID)
    probes = hot.select(
        *keys,
        "slot",
        F.greatest(low, F.lit(0)).cast("int").alias("_l"),
        F.least(high, F.lit(PROBE_GRID)).cast("int").alias("_h"),
    )
    wanted = sorted({v for row in probes.select("_l", "_h").distinct().collect() for v in row})
    # There are at most rows / hot_rows hot groups.
    sketch = (
        join_small(data, hot.select(*keys).distinct(), keys, "left_semi")
        .groupBy(*keys)
        .agg(
            F.percentile_approx(
                "_v", F.array(*[F.lit(v / PROBE_GRID) for v in wanted]), SKETCH_ACCURACY
            ).alias("_q")
        )
    )
    index = F.create_map(*[F.lit(x) for pair in zip(wanted, range(len(wanted))) for x in pair])
    brackets = probes.join(sketch, list(keys)).select(
        *keys,
        "slot",
        F.get("_q", index[F.col("_l")]).alias("_a"),
        F.get("_q", index[F.col("_h")]).alias("_b"),
    )
    brackets = cut_lineage(brackets, "brackets")
    limits = narrow.join(brackets, [*keys, "slot"], "left")
    joined = join_small(data, limits, keys)
    below = F.col("_a").isNotNull() & (F.col("_v") < F.col("_a"))
    return (
        joined.where(F.col("_b").isNull() | (F.col("_v") <= F.col("_b")))
        .withColumn("_v", F.when(~below, F.col("_v")))
    )


def blocked_row_number(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence, name: str
) -> DataFrame:
    """``row_number`` over (keys order by order), solved block by block.

    ``block`` must be an integer that never decreases along ``order``. Each block is numbered
    alone and shifted by the size of the blocks before it.
    """
    cut = [*keys, "_block"]
    data = df.withColumn("_block", block)
    before = (
        data.groupBy(*cut)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", _sum_before(keys, "_rows"))
        .drop("_rows")
    )
    inside = F.row_number().over(W.partitionBy(*cut).orderBy(*order))
    return (
        data.join(before, cut)
        .withColumn(name, F.col("_before") + inside)
        .drop("_block", "_before")
    )


def hash_row_number(
    df: DataFrame, keys: Sequence[str], hashed: str, tie: Sequence[str], name: str
) -> DataFrame:
    """Row number by a 32-bit hash column; the upper 16 bits are the block."""
    return blocked_row_number(
        df, keys, F.shiftright(F.col(hashed), 16), [hashed, *tie], name
    )


def _sum_before(keys: Sequence[str], col: str) -> Column:
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    return F.coalesce(
        F.sum(col).over(w.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: dict[str, tuple[str, str]],
    block_size: int = 100_000,
    include_current: bool = True,
) -> DataFrame:
    """Running ``max`` or ``sum`` by an integer ``order`` column.

    ``columns`` maps an output name to ``(function, input)``. A long run is cut into blocks of
    ``block_size`` consecutive order values.
    """
    cut = [*keys, "_block"]
    data = df.withColumn("_block", F.floor(F.col(order) / block_size))
    functions = {"max": F.max, "sum": F.sum}
    totals = data.groupBy(*cut).agg(
        *[functions[f](c).alias(f"_t_{n}") for n, (f, c) in columns.items()]
    )
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *cut,
        *[functions[f](f"_t_{n}").over(earlier).alias(f"_e_{n}") for n, (f, _) in columns.items()],
    )
    inside = W.partitionBy(*cut).orderBy(order).rowsBetween(
        W.unboundedPreceding, 0 if include_current else -1
    )
    out = data.join(carried, cut)
    for n, (f, c) in columns.items():
        here = functions[f](c).over(inside)
        if f == "max":
            value = F.greatest(here, F.col(f"_e_{n}"))
        else:
            value = F.when(
                here.isNotNull() | F.col(f"_e_{n}").isNotNull(),
                F.coalesce(here, F.lit(0)) + F.coalesce(F.col(f"_e_{n}"), F.lit(0)),
            )
        out = out.withColumn(n, value)
    return out.drop("_block", *[f"_e_{n}" for n in columns])
