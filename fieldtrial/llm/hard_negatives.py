"""Hard negatives by slots: one pass over the scores answers the windows of all positives.

The upper limits of an anchor's positives cut its scores into disjoint slots. Every task keeps the
best k rows of each slot, Spark keeps the best k of those, and merging the slots from the lowest
limit up gives, for each positive, the best k rows under its limit; its window's lower end then cuts
these. Anchors (a stated query set) meet all rows in cells of a grid of bounded blocks and lanes, so
neither side is broadcast and no pair is written but those kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

# Components of all rows of a lane, and of all anchors of a block.
LANE_VALUES, BLOCK_VALUES = 1 << 22, 1 << 20
# Rows below which a lane is not split to busy more tasks, as each lane sends its own best rows.
LEAST_ROWS = 1024
# Scores compared at a time inside a cell.
TILE = 1 << 22
_LEAST = -(1 << 63)

_FOUND = "anchor long, slot int, vec_id long, score long"


def quantized(rows: DataFrame, vector: str, scale: float = 256.0) -> DataFrame:
    """vec_id, label and the whole-number vector q = floor(scale * x) of the rows that take part.

    Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part.
    A component beyond the range of long is held at its end.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    return kept.where(F.col(vector).isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", whole.alias("q")
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors of a list column, shorter ones filled with zeros."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, ends = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    if (ends == width).all():
        return flat.reshape(len(ends), width)
    out = np.zeros((len(ends), width), np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)
    out[np.repeat(np.arange(len(ends)), ends), place] = flat
    return out


def _best(scores: np.ndarray, allowed: np.ndarray, k: int):
    """Rows and columns of the k largest allowed scores of each row; the first columns win ties."""
    n = scores.shape[1]
    least = _LEAST if scores.dtype != object else -(1 << 300)
    key = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), least)
    k = min(k, n)
    at = np.argpartition(key, n - k, axis=1)[:, n - k :]
    row, col = np.nonzero(np.take_along_axis(key, at, 1) > least)
    return row, at[row, col]


def _cells(k: int, same_label: bool):
    """A function of the anchors and the rows of one cell: the best k rows per anchor and slot."""

    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        schema = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not len(anchors) or not len(rows):
            return schema.empty_table()
        rows = rows.sort_by("vec_id")
        width = max(int(t["width"][0].as_py()) for t in (anchors, rows))
        a, b = _matrix(anchors["q"], width), _matrix(rows["q"], width)
        peak = [max((abs(int(m.max())), abs(int(m.min())))) if m.size else 0 for m in (a, b)]
        most = peak[0] * peak[1] * width
        # Products of doubles are exact below 2^53; room is left for the place in the key.
        kind = np.float64 if most * len(rows) < 1 << 53 else object
        a, b = a.astype(kind), b.astype(kind).T
        vec_id, row_id, label = (rows[c].to_numpy() for c in ("vec_id", "row", "label"))
        own_row, own_label = anchors["row"].to_numpy(), anchors["label"].to_numpy()
        limits = _matrix(anchors["limits"], max(1, int(anchors["n_limits"].to_numpy().max())))
        counts, low = anchors["n_limits"].to_numpy(), anchors["low"].to_numpy()
        found = []
        step = max(1, TILE // len(rows))
        for start in range(0, len(a), step):
            part = slice(start, start + step)
            scores = a[part] @ b
            scores = scores.astype(np.int64) if kind is np.float64 else np.clip(scores, 1 - (1 << 63), (1 << 63) - 1)
            equal = own_label[part, None] == label[None, :]
            fits = (equal & (own_row[part, None] != row_id[None, :])) if same_label else ~equal
            fits &= (scores >= low[part, None]).astype(bool)
            for slot in range(limits.shape[1]):
                inside = fits & (scores <= limits[part, slot, None]).astype(bool) & (counts[part, None] > slot)
                if slot + 1 < limits.shape[1]:
                    last = counts[part, None] <= slot + 1
                    inside &= last | (scores > limits[part, slot + 1, None]).astype(bool)
                row, col = _best(scores, inside, k)
                found.append((own_row[part][row], np.full(len(row), slot), vec_id[col], scores[row, col].astype(np.int64)))
        cells = [np.concatenate(c) for c in zip(*found)]
        return pa.table([pa.array(c, t) for c, t in zip(cells, schema.types)], schema=schema)

    return cell


def _scan(anchors: DataFrame, rows: DataFrame, n_blocks: int, n_lanes: int, k: int, same_label: bool) -> DataFrame:
    """The best k rows per anchor and slot over all cells: anchor, slot, vec_id, score, place."""
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])
    block = F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")
    lane = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_lanes)).cast("int")
    left = anchors.withColumn("block", block).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(n_lanes - 1))))
    right = rows.withColumn("lane", lane).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    found = left.groupBy("block", "lane").cogroup(right.groupBy("block", "lane")).applyInArrow(
        lambda a, b: _cells(k, same_label)(a, b), _FOUND
    )
    # The limit is applied before the shuffle too, so a task sends k rows per anchor and slot.
    best = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def _share(score: str, percent: int, round_) -> F.Column:
    return round_(F.col(score).cast("decimal(20,0)") * percent / F.lit(100)).cast("long")


def hard_negatives(
    vectors: DataFrame,
    anchors: F.Column,
    n_positives: int = 5,
    n_negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Hard negatives of every anchor and positive.

    ``vectors`` has vec_id, label (of one type, not null) and q (whole numbers); ``anchors`` is a
    condition on vec_id. The score of two rows is their inner product, in which a shorter vector
    counts as filled with zeros and the result is held at the ends of long. A row of higher score
    comes first, of equal ones that of the smaller vec_id. Positives are the first ``n_positives``
    other rows of the anchor's label; per positive the first ``n_negatives`` rows of other labels
    with ``low`` % to ``high`` % of its score are returned: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score. Rows that share a vec_id are rows of their own. An
    anchor without positives and a window without rows give nothing; so does an empty table.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    numbered = vectors.select("vec_id", "label", "q", F.monotonically_increasing_id().alias("row"))
    rows = scratch.write(numbered, "vectors")
    shape = rows.select(
        F.count(F.lit(1)).alias("n"),
        F.count_if(anchors).alias("m"),
        F.coalesce(F.max(F.size("q")), F.lit(0)).alias("width"),
    ).first()
    width = max(1, shape["width"])
    n_blocks = max(1, -(-shape["m"] * width // BLOCK_VALUES))
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = min(-(-parallel // n_blocks), -(-shape["n"] // LEAST_ROWS))
    n_lanes = max(1, spread, -(-shape["n"] * width // LANE_VALUES))

    sized = rows.withColumn("width", F.lit(width))
    chosen = rows.where(anchors).withColumn("width", F.lit(width))
    everything = chosen.select(
        *chosen.columns,
        F.array(F.lit((1 << 63) - 1)).alias("limits"),
        F.lit(1).alias("n_limits"),
        F.lit(_LEAST).alias("low"),
    )
    best = _scan(everything, sized, n_blocks, n_lanes, n_positives, same_label=True)
    each = F.struct(
        "place",
        F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
        _share("score", high, F.floor).alias("high"),
        _share("score", low, F.ceil).alias("low"),
    )
    windows = best.groupBy("anchor").agg(F.sort_array(F.collect_list(each)).alias("positives")).select(
        "anchor",
        "positives",
        F.array_distinct(F.col("positives.high")).alias("limits"),
        F.array_min("positives.low").alias("low"),
    )
    windows = scratch.write(windows, "windows")

    limited = chosen.join(windows.withColumnRenamed("anchor", "row"), "row").select(
        *chosen.columns, "limits", F.size("limits").alias("n_limits"), "low"
    )
    kept = _scan(limited, sized, n_blocks, n_lanes, n_negatives, same_label=False)
    slots = kept.groupBy("anchor").agg(
        F.collect_list(F.struct("slot", (-F.col("score")).alias("down"), "vec_id")).alias("kept")
    )
    entry = "array<struct<down:bigint,vec_id:bigint>>"

    def in_slot(slot):
        of_slot = F.filter("kept", lambda e: e["slot"] == slot)
        return F.transform(of_slot, lambda e: F.struct(e["down"].alias("down"), e["vec_id"].alias("vec_id")))

    def merged(suffixes, slot):
        lower = F.coalesce(F.get(suffixes, F.lit(0)), F.array().cast(entry))
        return F.concat(F.array(F.slice(F.array_sort(F.concat(in_slot(slot), lower)), 1, n_negatives)), suffixes)

    downwards = F.reverse(F.sequence(F.lit(0), F.size("limits") - 1))
    suffixes = F.aggregate(downwards, F.array().cast(f"array<{entry}>"), merged)
    joined = windows.drop("low").join(slots, "anchor").join(
        chosen.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor"
    )
    each = joined.withColumn("suffixes", suffixes).select(
        "anchor_id", "limits", "suffixes", F.explode("positives").alias("p")
    )
    place = F.array_position("limits", F.col("p.high")).cast("int") - 1
    inside = F.filter(F.get("suffixes", place), lambda e: -e["down"] >= F.col("p.low"))
    return each.select("anchor_id", "p.positive_id", "p.positive_score", F.posexplode(inside).alias("at", "e")).select(
        "anchor_id",
        "positive_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("e.vec_id").alias("negative_id"),
        "positive_score",
        (-F.col("e.down")).alias("negative_score"),
    )
