"""Design-of-experiments tables.

Every generator takes one row per campaign with ``low`` and ``high`` arrays and returns the design
runs of each campaign as (keys, run, x). Runs are made by arithmetic on the run number, so no grid
is built in memory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_int
from ..session import cut_lineage, join_small
from .exact import hash_row_number
from .generate import key_cols, latin_hypercube, numbered, scale_points

# Run numbers are 64-bit.
MAX_RUNS = 2**62

# First rows of the Plackett-Burman designs with 4, 8 and 12 runs.
PB_ROWS = {
    4: [1, 1, -1],
    8: [1, 1, 1, -1, 1, -1, -1],
    12: [1, 1, -1, 1, 1, 1, -1, -1, -1, 1, -1],
}


def decode_design(code: Column, low: Column, high: Column) -> Column:
    """Coded levels in [-1, 1] placed in the data range of the leading coordinates."""
    low, high = (F.slice(side, F.lit(1), F.size(code)) for side in (low, high))
    width = F.zip_with(high, low, lambda h, l: h - l)
    share = F.transform(code, lambda c: (c + 1) / F.lit(2.0))
    return F.zip_with(low, F.zip_with(share, width, lambda s, w: s * w), lambda l, v: l + v)


def _runs(limits: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    return numbered(limits, F.lit(n), "run")


def _digit(base: int, j: int) -> Column:
    """Digit ``j`` of the run number."""
    return F.floor(F.col("run") / F.lit(base**j)).cast("bigint") % base


def _codes(values: Sequence[Column]) -> Column:
    return F.array(*[v.cast("double") for v in values])


def _placed(runs: DataFrame, keys: Sequence[str], code: Column) -> DataFrame:
    return runs.select(
        *keys, "run", decode_design(code, F.col("low"), F.col("high")).alias("x")
    )


def full_factorial(limits: DataFrame, keys: Sequence[str], d: int, levels: int = 3) -> DataFrame:
    """All level combinations of the leading ``d`` coordinates, the first varying fastest."""
    n = _combinations(levels, d)
    code = _codes([_digit(levels, j) * 2 / F.lit(levels - 1.0) - 1 for j in range(d)])
    return _placed(_runs(limits, keys, n), keys, code)


def _combinations(levels: int, d: int) -> int:
    if levels**d > MAX_RUNS:
        raise ValueError(f"{d} factors at {levels} levels have too many combinations")
    return levels**d


def fractional_factorial(
    limits: DataFrame,
    keys: Sequence[str],
    d: int,
    levels: int = 3,
    fraction: float = 0.5,
    seed: int | str = 0,
    max_runs: int | None = None,
) -> DataFrame:
    """A hashed share of the combinations, drawn with replacement, at the bin centres.

    ``max_runs`` bounds the design where the caller wants a bound.
    """
    n = max(1, int(_combinations(levels, d) * fraction))
    n = n if max_runs is None else min(n, max_runs)
    level = [
        hash_int(str(seed), *key_cols(keys), F.col("run"), str(j), mod=levels) for j in range(d)
    ]
    code = _codes([(v + 0.5) * 2 / F.lit(float(levels)) - 1 for v in level])
    return _placed(_runs(limits, keys, n), keys, code)


def plackett_burman(
    limits: DataFrame, keys: Sequence[str], d: int, seed: int | str = 0
) -> DataFrame:
    """Cyclic two-level rows plus one run with every factor low; levels stay coded.

    The run count is the smallest multiple of four above ``d``. Beyond twelve runs the first row
    is hashed.
    """
    n = 4 * (d // 4 + 1)
    if n in PB_ROWS:
        base = F.array(*[F.lit(float(v)) for v in PB_ROWS[n]])
    else:
        base = F.array(
            *[(hash_int(str(seed), "pb", str(j), mod=2) * 2 - 1).cast("double") for j in range(n - 1)]
        )
    value = [
        F.when(F.col("run") == n - 1, F.lit(-1.0)).otherwise(
            F.get(base, F.pmod(F.lit(j) - F.col("run"), F.lit(n - 1)).cast("int"))
        )
        for j in range(d)
    ]
    return _runs(limits, keys, n).select(*keys, "run", F.array(*value).alias("x"))


def central_composite(
    limits: DataFrame, keys: Sequence[str], d: int, alpha: float = 1.414
) -> DataFrame:
    """Corners, axial points at plus and minus ``alpha``, and the centre."""
    k = d
    corners = _combinations(2, k)
    code = []
    for j in range(k):
        corner = _digit(2, k - 1 - j) * 2.0 - 1
        axis = F.when(F.col("run") == corners + 2 * j, F.lit(alpha)).when(
            F.col("run") == corners + 2 * j + 1, F.lit(-alpha)
        )
        code.append(F.when(F.col("run") < corners, corner).otherwise(F.coalesce(axis, F.lit(0.0))))
    return _placed(_runs(limits, keys, corners + 2 * k + 1), keys, _codes(code))


def box_behnken(limits: DataFrame, keys: Sequence[str], d: int) -> DataFrame:
    """Four plus/minus runs for each pair of factors, others at the centre, and one centre run."""
    pairs = [(i, j) for i in range(d) for j in range(i + 1, d)]
    pair = F.floor(F.col("run") / 4).cast("int")
    first = F.array(*[F.lit(i) for i, _ in pairs]) if pairs else F.array(F.lit(-1))
    second = F.array(*[F.lit(j) for _, j in pairs]) if pairs else F.array(F.lit(-1))
    sign_i = F.when(F.col("run") % 4 >= 2, F.lit(1.0)).otherwise(F.lit(-1.0))
    sign_j = F.when(F.col("run") % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    code = [
        F.when(F.get(first, pair) == f, sign_i).when(F.get(second, pair) == f, sign_j).otherwise(
            F.lit(0.0)
        )
        for f in range(d)
    ]
    return _placed(_runs(limits, keys, 4 * len(pairs) + 1), keys, _codes(code))


def lhs_runs(
    limits: DataFrame,
    keys: Sequence[str],
    n: Column,
    d: int,
    seed: int | str = 0,
    max_runs: int | None = None,
) -> DataFrame:
    """Latin-hypercube runs scaled to the data range: n / 2 of them, or ``max_runs`` if given."""
    half = F.floor(n / 2)
    size = half if max_runs is None else F.least(F.lit(max_runs), half)
    slots = numbered(limits, size, "run")
    unit = latin_hypercube(slots.select(*keys, "run"), keys, "run", d, seed)
    return cut_lineage(scale_points(unit, limits.select(*keys, "low", "high"), keys), "runs")


def design_order(
    pool: DataFrame, matches: DataFrame, keys: Sequence[str], seed: int | str, point: str = "point_id"
) -> DataFrame:
    """Visiting order of a matched design: its points shuffled, then the rest at random.

    ``tier`` is 0 for design points and 1 for the remainder; ``u`` orders within a tier.
    """
    chosen = matches.select(*keys, point).distinct().withColumn("_in", F.lit(0))
    return pool.join(chosen, [*keys, point], "left").select(
        *keys,
        point,
        F.coalesce("_in", F.lit(1)).alias("tier"),
        hash_int(str(seed), "order", *key_cols(keys), F.col(point)).alias("u"),
    )


def random_order(
    pool: DataFrame, keys: Sequence[str], seed: int | str, point: str = "point_id"
) -> DataFrame:
    """Random visiting order in one tier."""
    return pool.select(
        *keys,
        point,
        F.lit(0).alias("tier"),
        hash_int(str(seed), "order", *key_cols(keys), F.col(point)).alias("u"),
    )


def visiting_position(
    order: DataFrame, keys: Sequence[str], point: str = "point_id"
) -> DataFrame:
    """1-based position of every point in its visiting order."""
    inside = hash_row_number(order, [*keys, "tier"], "u", [point], "_rank")
    sizes = order.groupBy(*keys).agg(F.count(F.when(F.col("tier") == 0, 1)).alias("_first"))
    return (
        join_small(inside, sizes, keys)
        .withColumn(
            "position",
            F.col("_rank") + F.when(F.col("tier") > 0, F.col("_first")).otherwise(F.lit(0)),
        )
        .drop("_rank", "_first")
    )


def steps_from_order(
    order: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    batch: Column | int,
    point: str = "point_id",
) -> DataFrame:
    """Steps until the target is revealed by a fixed order: ``ceil(position / batch)``.

    The position is a count of the points that come no later than the target, so no sort of the
    order is needed. ``targets`` holds one target per key.
    """
    rank = F.struct("tier", "u", point)
    goal = targets.select(*keys, F.col("target_id").alias(point))
    wanted = join_small(order, goal, [*keys, point]).select(
        *keys, F.struct("tier", "u", point).alias("_t")
    )
    size = batch if isinstance(batch, Column) else F.lit(batch)
    return (
        join_small(order, wanted, keys)
        .groupBy(*keys)
        .agg(F.count(F.when(rank <= F.col("_t"), 1)).alias("position"))
        .withColumn("steps_to_target", F.ceil(F.col("position") / size).cast("bigint"))
    )
