"""Chat formatting: collapse logged snapshots of a conversation, then render the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, key, body and the keys of its proper prefixes.

    Turns are ordered by (turn, role, text). A key is the number of turns with two running hashes
    over (place, role, text); null roles and texts count as empty, rows without conv_id make up
    one conversation.
    """
    flat = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = flat.withColumn("at", F.row_number().over(order).cast("long"))
    running = placed.withColumns(
        {
            "a": F.bit_xor(F.xxhash64(F.lit(1), "at", "role", "text")).over(so_far),
            "b": F.bit_xor(F.xxhash64(F.lit(2), "at", "text", "role")).over(so_far),
        }
    )
    grouped = running.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "a", "b"))).alias("keys"),
        F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("turns"),
    )
    return grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.element_at("keys", -1).alias("key"),
        F.slice("keys", F.lit(1), F.size("keys") - 1).alias("prefixes"),
        "turns",
    )


def render(turns) -> F.Column:
    """The text of a conversation: each turn between its markers."""
    return F.array_join(
        F.transform(
            turns,
            lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE), F.lit("\n")),
        ),
        "",
    )


def chat_format(turns: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Conversations that no longer one continues, rendered.

    Returns conv_id (the smallest of equal conversations), n_turns, n_copies and text. A logged
    snapshot whose turns are the first turns of a longer conversation is left out. An empty table
    gives no rows; columns other than conv_id, turn, role and text are ignored.
    """
    scratch = scratch or Scratch(turns.sparkSession)
    rows = scratch.write(conversations(turns), "conversations")
    classes = rows.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies")
    )
    continued = rows.select(F.explode("prefixes").alias("key")).distinct()
    maximal = classes.join(continued, "key", "left_anti").select(
        F.col("conv_id").alias("_first"), "n_copies"
    )
    first = rows.select("conv_id", "n_turns", render(F.col("turns")).alias("text"))
    same = F.col("_first").eqNullSafe(F.col("conv_id"))
    return first.join(maximal, same).select("conv_id", "n_turns", "n_copies", "text")
