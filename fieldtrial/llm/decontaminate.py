"""Benchmark decontamination: MinHash containment search by size, then exact containment.

An item of k shingles is contained when at least 80 % of them are in a document. So of its
floor(k / 5) + 1 smallest shingle hashes (its bottom sketch) at least one is there. Items are
partitioned by shingle width and size; a document keeps a shingle only if its hash is at most the
largest sketch hash of a partition, and is a candidate only if one of them is in a sketch. This
holds for documents of any length, and no item is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, words

WIDTH = 5
# Filters of 64 * SLOTS bits over item hashes: of fixed size, they only spare work.
SLOTS = 1024


def shingle_hashes(tokens: Column, width: int) -> Column:
    """The distinct hashes of all runs of ``width`` words."""
    return F.when(
        F.size(tokens) >= width,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), F.size(tokens) - width),
                lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(width)]),
            )
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _tokens(text: Column) -> Column:
    return words(F.lower(text))


def item_shingles(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, width, size, hash, in_sketch) of every distinct shingle of every item.

    An item of fewer than ``width`` words is one shingle of all its words; one without words has
    none and is in no document. Rows of one item_id are one item if their texts are equal.
    """
    split = items.select("item_id", _tokens(F.col("text")).alias("t")).distinct()
    split = split.where(F.size("t") > 0).withColumn("width", F.least(F.size("t"), F.lit(width)))
    hashes = F.coalesce(
        *[F.when(F.col("width") == w, shingle_hashes(F.col("t"), w)) for w in range(1, width + 1)]
    )
    sized = split.select("item_id", "width", F.sort_array(hashes).alias("hashes"))
    sized = sized.withColumn("size", F.size("hashes"))
    needed = F.floor((F.col("size") * 4 + 4) / 5)
    each = sized.select(
        "item_id", "width", "size", needed.alias("needed"), F.posexplode("hashes").alias("at", "hash")
    )
    return each.withColumn("in_sketch", F.col("at") <= F.col("size") - F.col("needed")).drop("at")


def _slot(h: Column) -> tuple[Column, Column]:
    """Where a hash is in a filter: the place of its 64 bits, and its bit."""
    return F.shiftright(h, 6).bitwiseAND(F.lit(SLOTS - 1)), h.bitwiseAND(F.lit(63)).cast("int")


def _filter(hashes: DataFrame) -> Column:
    """An array of SLOTS numbers whose bits tell which hashes may be there."""
    place, bit = _slot(F.col("hash"))
    one = F.lit(1).cast("long")
    rows = hashes.groupBy(place.alias("p")).agg(F.bit_or(F.call_function("shiftleft", one, bit)).alias("b"))
    bits = {int(r["p"]): r["b"] for r in rows.collect()}  # SLOTS rows at most
    return F.array(*[F.lit(bits.get(k, 0)).cast("long") for k in range(SLOTS)])


def _may_have(filter_: Column, h: Column) -> Column:
    place, bit = _slot(h)
    bits = F.call_function("shiftright", F.get(filter_, place.cast("int")), bit)
    return bits.bitwiseAND(F.lit(1)) == 1


def _found(width: int, filter_: Column):
    return lambda t: F.filter(shingle_hashes(t, width), lambda h: _may_have(filter_, h))


def _sketched(filter_: Column, most: int):
    return lambda h: (h <= most) & _may_have(filter_, h)


def _with_width(width: int):
    return lambda h: F.struct(F.lit(width).alias("width"), h.alias("hash"))


def contaminated(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, scratch: Scratch | None = None
) -> DataFrame:
    """Pairs of a document and an item it contains: doc_id, text_hash, item_id, n_shingles, n_found.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored, null and
    empty texts contain nothing. Equal rows give one pair; rows of one doc_id with different texts
    give their own, told apart by text_hash. Empty tables give no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    shingles = scratch.write(item_shingles(items, width), "item_shingles")
    partitions = (
        shingles.where("in_sketch")
        .groupBy("width", F.floor(F.log2("size")).alias("band"))
        .agg(F.max("hash").alias("most"))
        .collect()
    )  # one row per width and power of two
    schema = "doc_id bigint, text_hash bigint, item_id bigint, n_shingles bigint, n_found bigint"
    if not partitions:
        return docs.sparkSession.createDataFrame([], schema)
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.array(_tokens(F.col("text"))).alias("t"),
    )
    hits, sketched = [], []
    for w in sorted({r["width"] for r in partitions}):
        own = shingles.where(F.col("width") == w)
        every, sketch = _filter(own), _filter(own.where("in_sketch"))
        most = max(r["most"] for r in partitions if r["width"] == w)
        split = split.withColumn(f"h{w}", F.transform("t", _found(w, every))[0])
        sketched.append(F.exists(f"h{w}", _sketched(sketch, most)))
        hits.append(F.transform(f"h{w}", _with_width(w)))
    test = sketched[0]
    for other in sketched[1:]:
        test = test | other
    candidates = split.where(test).select("doc_id", "text_hash", F.explode(F.concat(*hits)).alias("s"))
    met = candidates.select("doc_id", "text_hash", "s.width", "s.hash").distinct().join(
        shingles, ["width", "hash"]
    )
    counted = met.groupBy("doc_id", "text_hash", "item_id", "width", "size", "needed").agg(
        F.count(F.lit(1)).alias("n_found"), F.max("in_sketch").alias("sketched")
    )
    return counted.where(F.col("sketched") & (F.col("n_found") >= F.col("needed"))).select(
        "doc_id",
        "text_hash",
        F.col("item_id").cast("long").alias("item_id"),
        F.col("size").cast("long").alias("n_shingles"),
        "n_found",
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, scratch: Scratch | None = None
) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item."""
    found = contaminated(docs, items, width, scratch).select(
        F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")
    ).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_gone_id")) & (
        F.xxhash64("text") == F.col("_gone_hash")
    )
    return docs.join(found, same, "left_anti")
