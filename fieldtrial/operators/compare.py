"""Nonparametric comparison of optimizers over common instances."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import py_u_open
from ..functions.special import beta_quantile, chi2_sf
from ..session import cut_lineage
from .exact import HOT_ROWS, agg_with_quantiles, order_statistics
from .stats import (
    dataset_level,
    instance_means,
    optimizer_names,
    rank_optimizers,
    ranked_values,
    summary_stats,
    wide_instances,
)

PAIR = ["optimizer_a", "optimizer_b"]
HASH_BITS = 128  # bits of one md5 value
# A task holds the null sums of this many pairs at a time.
PAIRS_HELD = 256


def complete_blocks(df: DataFrame, metric: str) -> DataFrame:
    """Instances that hold a value for every optimizer, in long form."""
    return ranked_values(df, metric, complete=True).select("instance", "optimizer", "value")


def friedman(df: DataFrame, metric: str) -> DataFrame:
    """Friedman chi-square with tie correction; null below 2 blocks or 3 treatments."""
    ranked = ranked_values(df, metric, complete=True)
    sums = ranked.groupBy("optimizer").agg(
        F.sum("rank").alias("r"),
        F.count(F.lit(1)).alias("n"),
        # A tie group of t rows adds t * (t * t - 1) in total.
        F.sum(F.col("same") * F.col("same") - 1).alias("ties"),
    )
    one = sums.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n_blocks"),
        F.count(F.lit(1)).alias("n_treatments"),
        F.sum(F.col("r") * F.col("r")).alias("ss"),
        F.sum("ties").alias("ties"),
    )
    n, k = F.col("n_blocks").cast("double"), F.col("n_treatments").cast("double")
    usable = (F.col("n_blocks") >= 2) & (F.col("n_treatments") >= 3)
    untied = F.when(usable, 1 - F.col("ties") / (k * (k * k - 1) * n))
    raw = F.when(usable, 12 / (k * n * (k + 1)) * F.col("ss") - 3 * n * (k + 1))
    statistic = F.when(untied > 0, raw / untied)
    return one.select("n_blocks", "n_treatments", statistic.alias("statistic")).withColumn(
        "p_value", chi2_sf("statistic", (F.col("n_treatments") - 1).cast("int"))
    )


def friedman_verdict(result: DataFrame) -> DataFrame:
    return result.withColumn(
        "verdict",
        F.when(F.col("p_value") < 0.05, "Significant differences detected").otherwise(
            "No significant differences detected"
        ),
    )


def pair_diffs(df: DataFrame, metric: str) -> DataFrame:
    """Difference a - b on every common instance, for each pair with a before b by name.

    An instance yields k * (k - 1) / 2 rows for k optimizers whatever the size of the input group.
    """
    names = optimizer_names(df)
    if names is None:
        return _joined_diffs(instance_means(df, metric))
    if not names:
        names = [""]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    listed = [
        F.struct(
            F.lit(names[i]).alias("optimizer_a"), F.lit(names[j]).alias("optimizer_b"),
            F.lit(i).alias("i"), F.lit(j).alias("j"),
        )
        for i, j in pairs or [(0, 0)]
    ]
    wide = wide_instances(df, metric, names)
    both = wide.select("*", F.explode(F.array(*listed)).alias("p")).where(
        F.get("present", F.col("p.i")) & F.get("present", F.col("p.j"))
        & (F.col("p.i") < F.col("p.j"))
    )
    diff = F.get("values", F.col("p.i")) - F.get("values", F.col("p.j"))
    return both.select("p.optimizer_a", "p.optimizer_b", "instance", diff.alias("diff"))


def _joined_diffs(means: DataFrame) -> DataFrame:
    """The same by a join on the instance, for many optimizers."""
    left = means.select(
        "instance", F.col("optimizer").alias("optimizer_a"), F.col("value").alias("va")
    )
    right = means.select(
        F.col("instance").alias("_i"), F.col("optimizer").alias("optimizer_b"),
        F.col("value").alias("vb"),
    )
    same = (F.col("instance") == F.col("_i")) & (F.col("optimizer_a") < F.col("optimizer_b"))
    return left.join(right, same).select(
        *PAIR, "instance", (F.col("va") - F.col("vb")).alias("diff")
    )


def sign_flip_test(diffs: DataFrame, n: int = 1000) -> DataFrame:
    """Two-sided sign-flip permutation p-value of the mean difference per pair.

    The signs of an instance are the bits of md5 values, so they are the same for every pair.
    Each task adds up its own ``n`` null sums per pair; only those sums are shuffled.
    """
    blocks = math.ceil(n / HASH_BITS)
    signs = F.concat(
        *[F.md5(F.concat_ws("|", F.col("instance"), F.lit(str(b)))) for b in range(blocks)]
    )
    rows = diffs.where(F.col("diff").isNotNull()).select(
        *PAIR, "diff", F.unhex(signs).alias("bits")
    )
    schema = "optimizer_a string, optimizer_b string, observed double, sums array<double>"

    def null_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[tuple, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            rows = [(a, b, acc[0], acc[1:]) for (a, b), acc in kept.items()]
            kept.clear()
            return pd.DataFrame(rows, columns=["optimizer_a", "optimizer_b", "observed", "sums"])

        for batch in batches:
            for pair, part in batch.groupby(PAIR, sort=False):
                if pair not in kept and len(kept) >= PAIRS_HELD:
                    yield flush()
                d = part["diff"].to_numpy(float)
                acc = kept.setdefault(pair, np.zeros(n + 1))
                for at in range(0, len(d), 4096):
                    raw = np.frombuffer(b"".join(part["bits"].iloc[at : at + 4096]), dtype=np.uint8)
                    width = blocks * HASH_BITS // 8
                    bits = np.unpackbits(raw.reshape(-1, width), axis=1)[:, :n]
                    piece = d[at : at + 4096]
                    acc[0] += piece.sum()
                    acc[1:] += 2.0 * (piece @ bits) - piece.sum()
        if kept:
            yield flush()

    partial = rows.mapInPandas(null_sums, schema)
    total = (
        partial.select(*PAIR, "observed", F.posexplode("sums").alias("flip", "s"))
        .groupBy(*PAIR, "flip")
        .agg(F.sum("s").alias("s"), F.sum("observed").alias("observed"))
    )
    # A tolerance keeps exactly equal sums equal whatever the order of addition.
    reached = F.abs("s") >= F.abs("observed") * (1 - 1e-9)
    return total.groupBy(*PAIR).agg(F.avg(reached.cast("double")).alias("p_value"))


def median_diff(diffs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Median paired difference."""
    return agg_with_quantiles(
        diffs.where(F.col("diff").isNotNull()), PAIR, "diff", {"hl_median": 0.5}, (), hot_rows
    )


def _median_draws(counts: DataFrame, n: int) -> DataFrame:
    """Sorted positions whose values are the medians of ``n`` resamples of a group of ``_n`` rows.

    The m-th smallest of _n uniform draws has a Beta(m, _n - m + 1) distribution, and the next one
    is a minimum of the rest, so a resample median needs two numbers instead of _n draws. The Beta
    numbers come from hashed uniforms by inversion, in about sqrt(_n) steps for all of them.
    """
    schema = counts.select(*PAIR, "_n").schema.simpleString()[7:-1]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = np.array([py_u_open("boot", r, "m") for r in range(n)])
        second = np.array([py_u_open("boot", r, "next") for r in range(n)])
        known: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                size = int(row[-1])
                if size not in known:
                    m = (size + 1) // 2
                    u = beta_quantile(first, m, size - m + 1)
                    v = u if size % 2 else 1.0 - (1.0 - u) * (1.0 - second) ** (1.0 / (size - m))
                    known[size] = [
                        np.minimum(np.floor(size * x).astype(int), size - 1) for x in (u, v)
                    ]
                out.append((*row, *known[size]))
            yield pd.DataFrame(out, columns=[*PAIR, "_n", "low", "high"])

    return counts.select(*PAIR, "_n").mapInPandas(
        draw, schema.replace(":", " ").replace(",", ", ") + ", low array<bigint>, high array<bigint>"
    )


def bootstrap_medians(diffs: DataFrame, n: int = 1000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One bootstrap median per pair and resample."""
    data = diffs.where(F.col("diff").isNotNull())
    counts = data.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_n"))
    draws = cut_lineage(_median_draws(counts, n), "draws")
    targets = draws.select(
        *PAIR,
        "_n",
        F.lit("median").alias("slot"),
        F.array_sort(F.array_distinct(F.concat("low", "high"))).alias("positions"),
    )
    found = order_statistics(data, PAIR, "diff", targets, hot_rows).drop("slot")
    ends = draws.select(*PAIR, F.posexplode(F.arrays_zip("low", "high")).alias("resample", "at"))
    each = ends.select(
        *PAIR, "resample", F.explode(F.array("at.low", "at.high")).alias("position")
    )
    return (
        each.join(found, [*PAIR, "position"])
        .groupBy(*PAIR, "resample")
        .agg(F.avg("value").alias("median"))
    )


def bootstrap_ci(
    diffs: DataFrame, n: int = 1000, level: float = 0.95, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Percentile interval of the bootstrap median; a pair has ``n`` rows at this point."""
    tail = (1.0 - level) / 2.0
    return (
        bootstrap_medians(diffs, n, hot_rows)
        .groupBy(*PAIR)
        .agg(
            F.percentile("median", F.lit(tail)).alias("ci_lower"),
            F.percentile("median", F.lit(1.0 - tail)).alias("ci_upper"),
        )
    )


def pairwise(
    df: DataFrame,
    metric: str,
    n_flips: int = 1000,
    n_resamples: int = 1000,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Median difference, p-value, interval and common instances of every pair."""
    diffs = cut_lineage(pair_diffs(df, metric), "diffs")
    out = diffs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_instances"))
    for part in (
        median_diff(diffs, hot_rows),
        sign_flip_test(diffs, n_flips),
        bootstrap_ci(diffs, n_resamples, hot_rows=hot_rows),
    ):
        out = out.join(part, PAIR, "left")
    return out.select(*PAIR, "hl_median", "p_value", "ci_lower", "ci_upper", "n_instances")


def holm(pairs: DataFrame, monotone: bool = False) -> DataFrame:
    """Step-down adjustment over all pairs; there is one row per pair.

    ``monotone`` adds the running maximum that the plain rule leaves out.
    """
    w = W.orderBy(F.col("p_value").asc_nulls_last(), *PAIR)
    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    raw = F.col("p_value") * (F.col("_n") - F.col("_i") + 1)
    out = (
        pairs.withColumn("_n", n)
        .withColumn("_i", F.row_number().over(w))
        .withColumn(
            "adjusted_p_value", F.when(F.col("p_value").isNotNull(), F.least(raw, F.lit(1.0)))
        )
    )
    if monotone:
        out = out.withColumn(
            "adjusted_p_value",
            F.when(
                F.col("p_value").isNotNull(),
                F.max("adjusted_p_value").over(w.rowsBetween(W.unboundedPreceding, 0)),
            ),
        )
    return out.drop("_n", "_i")


def mark_significant(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    return pairs.withColumn(
        "significant", F.when(F.col("adjusted_p_value") < alpha, "*").otherwise("")
    )


def top_pairs(pairs: DataFrame, n: int = 20) -> DataFrame:
    return pairs.orderBy(F.col("p_value").asc_nulls_last(), *PAIR).limit(n)


def friedman_by_dataset(df: DataFrame, metric: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    return friedman(dataset_level(df, metric, hot_rows), metric)


def rankings_by_dataset(
    df: DataFrame, metric: str, ascending: bool = True, hot_rows: int = HOT_ROWS
) -> DataFrame:
    return rank_optimizers(dataset_level(df, metric, hot_rows), metric, ascending)


def analysis_parts(df: DataFrame, metric: str, ascending: bool) -> dict[str, DataFrame]:
    return {
        "friedman": friedman(df, metric),
        "rankings": rank_optimizers(df, metric, ascending),
        "summary_stats": summary_stats(df, metric),
        "pairwise": holm(pairwise(df, metric)),
        "dataset_data": dataset_level(df, metric),
        "dataset_friedman": friedman_by_dataset(df, metric),
        "dataset_rankings": rankings_by_dataset(df, metric, ascending),
    }
