"""Prefix trie of conversations from vertical bitmaps.

Conversations are dealt into shards of bounded size. A shard indexes every (position, turn) as a
bitset over its conversations; going down from a node, the bitset of the parent intersected with a
posting is the bitset of a child, whose population count and ending conversations follow from it.
Turns are known by two hashes; those of a prefix are the exclusive or of those of its turns, which
name one node in every shard. What the shards found is added up by node. A node belongs to the shard
of its smallest member, so sums over subtrees are added up inside shards first, then by node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, join_sized

# Turns that a shard holds on average, at most; small tables have a shard for every task.
SHARD_TURNS = 8192

_LOCAL = (
    "shard int, depth long, a long, b long, parent_a long, parent_b long, n long, first long, "
    "bytes long, ends array<long>"
)
_SUMS = "depth long, a long, b long, n_leaves long, saved_tokens long, conv_id long, parent_conv_id long"
_NODE = ["depth", "a", "b"]


def placed_turns(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, place (from 1), x, y and bytes of every turn that has a conv_id.

    x and y are hashes of role and text, bytes the UTF-8 length of the text. Turns are ordered by
    (turn, role, text), a null turn first; null roles and texts are empty. The order comes from a
    range partitioning, so one conversation may fill many tasks: places are counted within a
    partition and shifted by what the partitions before it hold. Texts are shuffled once.
    """
    flat = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    sorted_rows = flat.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = scratch.write(
        sorted_rows.select(
            "conv_id",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("at"),
            F.xxhash64("role", "text").alias("x"),
            F.xxhash64("text", F.lit(7), "role").alias("y"),
            F.octet_length("text").cast("long").alias("bytes"),
        ),
        "ranged_turns",
    )
    here = W.partitionBy("part", "conv_id").orderBy("at")
    counted = ranged.withColumn("place", F.row_number().over(here).cast("long"))
    # Only conversations at the border of two partitions have rows in several of them.
    rows = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    shifts = scratch.write(
        rows.withColumn("before", before).where("before > 0").drop("n"), "turn_shifts"
    )
    shifted = join_sized(counted, shifts, ["conv_id", "part"], "left", scratch, "turn_shifts")
    place = F.col("place") + F.coalesce("before", F.lit(0))
    return shifted.select("conv_id", place.alias("place"), "x", "y", "bytes")


def branches(placed: DataFrame, span: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt as branches of others, and all conv_ids.

    Conversation c starts with the first h turns of conversation c - c % span (all of them if they
    are fewer, none if it is absent) and goes on with its own turns after its first h, where h is
    crc32 of the decimal c, modulo ``most``.
    """
    sizes = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    ids = sizes.select("conv_id", "size", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % span).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    ids = ids.join(bases, "base", "left").withColumn(
        "lent", F.least("h", F.coalesce("base_size", F.lit(0)))
    )
    heads = placed.where(F.col("place") < most).withColumnRenamed("conv_id", "base")
    lent = ids.select("conv_id", "base", "h").join(heads, "base").where(F.col("place") <= F.col("h"))
    own = placed.join(ids.select("conv_id", "h", "lent"), "conv_id").where(F.col("place") > F.col("h"))
    own = own.withColumn("place", F.col("place") - F.col("h") + F.col("lent"))
    columns = ["conv_id", "place", "x", "y", "bytes"]
    return lent.select(columns).unionByName(own.select(columns)), ids.select("conv_id")


def _down(table: pa.Table) -> pa.Table:
    """The nodes of one shard, from the bitsets of its (position, turn) postings."""
    columns = {name: table[name].to_numpy() for name in ("conv_id", "place", "a", "b", "bytes")}
    order = np.lexsort((columns["place"], columns["conv_id"]))
    conv, place, a, b, size = (columns[name][order] for name in ("conv_id", "place", "a", "b", "bytes"))
    starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])  # a conversation's row of place 0
    ids = conv[starts]
    length = place[np.r_[starts[1:], len(conv)] - 1]
    posting: dict[tuple, int] = {}
    key_of = list(zip(place.tolist(), a.tolist(), b.tolist()))
    ends: dict[int, int] = {}
    for k, (start, n) in enumerate(zip(starts.tolist(), length.tolist())):
        ends[n] = ends.get(n, 0) | 1 << k
        for row in range(start + 1, start + n + 1):
            posting[key_of[row]] = posting.get(key_of[row], 0) | 1 << k
    first_row = starts.tolist()
    everyone = (1 << len(ids)) - 1
    rows = []
    stack = [(0, 0, 0, None, None, 0, everyone)]
    while stack:
        depth, ka, kb, pa_, pb_, last, members = stack.pop()
        over = members & ends.get(depth, 0)
        done = []
        rest = over
        while rest:
            low = rest & -rest
            done.append(int(ids[low.bit_length() - 1]))
            rest ^= low
        first = int(ids[(members & -members).bit_length() - 1])
        rows.append((depth, ka, kb, pa_, pb_, members.bit_count(), first, last, done))
        rest = members & ~over
        while rest:
            row = first_row[(rest & -rest).bit_length() - 1] + depth + 1
            turn = key_of[row]
            child = members & posting[turn]
            stack.append((depth + 1, ka ^ turn[1], kb ^ turn[2], ka, kb, int(size[row]), child))
            rest &= ~child
    shard = table["shard"][0].as_py()
    cells = [[shard] * len(rows), *map(list, zip(*rows))]
    return pa.table(dict(zip(_schema(_LOCAL).names, map(_cast, cells, _schema(_LOCAL).types))), _schema(_LOCAL))


def _cast(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[t]) for n, t in (c.split(" ", 1) for c in ddl.split(", "))])


def _up(table: pa.Table) -> pa.Table:
    """Of one shard's nodes, the sums over subtrees of what the shard owns."""
    at = {}
    depth, a, b, pa_, pb_ = (table[c].to_pylist() for c in ("depth", "a", "b", "parent_a", "parent_b"))
    conv, own = table["conv_id"].to_pylist(), table["own"].to_pylist()
    leaves, saved = table["leaf"].to_pylist(), table["saved"].to_pylist()
    for k, key in enumerate(zip(depth, a, b)):
        at[key] = k
    up = [at.get((d - 1, x, y)) for d, x, y in zip(depth, pa_, pb_)]
    for k in sorted(range(len(depth)), key=lambda k: -depth[k]):
        if up[k] is not None:
            leaves[up[k]] += leaves[k]
            saved[up[k]] += saved[k]
    parents = [conv[up[k]] if own[k] and up[k] is not None else None for k in range(len(depth))]
    owners = [c if mine else None for c, mine in zip(conv, own)]
    schema = _schema(_SUMS)
    return pa.table(dict(zip(schema.names, [depth, a, b, leaves, saved, owners, parents])), schema)


def _digests(batches):
    """The SHA-256 of each node's ids, which arrive in order: one running digest, whatever their number."""
    schema = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
    now, digest = None, None
    for batch in batches:
        keys = list(zip(*(batch[c].to_pylist() for c in _NODE)))
        ids = batch["end"].to_pylist()
        done = []
        for key, conv in zip(keys, ids):
            if key != now:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(str(conv).encode())
            else:
                digest.update(f",{conv}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)
    if now is not None:
        last = [[v] for v in (*now, digest.hexdigest())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(last, schema.types)], schema=schema)


def _shard(n: int) -> Column:
    return F.pmod(F.xxhash64("conv_id"), F.lit(n)).cast("int")


def prefix_trie(
    turns: DataFrame, ids: DataFrame, shard_turns: int = SHARD_TURNS, scratch: Scratch | None = None
) -> DataFrame:
    """Every node of the trie of conversations, with what its subtree holds.

    ``turns`` has conv_id, place (1, 2, ... without gaps), x, y and bytes as ``placed_turns`` gives
    them; ``ids`` has every conv_id once, those without turns too. Columns of the result: conv_id (the smallest member), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens (bytes of last
    texts that members after the first repeat, over the subtree) and ends_sha256 (the members that
    end here). No conversations give no nodes. A shard holds two hashes and a length per turn, no
    text; one conversation must fit in a shard with these 24 bytes per turn.
    """
    scratch = scratch or Scratch(turns.sparkSession)
    hashed = turns.select(
        "conv_id",
        "place",
        F.xxhash64("place", "x", "y").alias("a"),
        F.xxhash64("y", "place", "x").alias("b"),
        "bytes",
    )
    zero = F.lit(0).cast("long")
    start = ids.select("conv_id", *[zero.alias(c) for c in ("place", "a", "b", "bytes")])
    rows = scratch.write(hashed.unionByName(start), "trie_turns")
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_shards = max(tasks, -(-rows.count() // shard_turns))
    local = rows.withColumn("shard", _shard(n_shards)).groupBy("shard").applyInArrow(_down, _LOCAL)
    local = scratch.write(local, "trie_local")

    nodes = local.groupBy(*_NODE).agg(
        F.sum("n").alias("n_convs"),
        F.min("first").alias("conv_id"),
        F.max("bytes").alias("bytes"),
        F.first("parent_a").alias("parent_a"),
        F.first("parent_b").alias("parent_b"),
    )
    nodes = scratch.write(nodes, "trie_nodes")
    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("parent_a").alias("a"), F.col("parent_b").alias("b")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.drop("parent_a", "parent_b").join(children, _NODE, "left").fillna(0, ["n_children"])
    nodes = scratch.write(nodes, "trie_children")

    own = F.col("first") == F.col("conv_id")
    owned = local.drop("ends", "n", "bytes").join(nodes, _NODE).select(
        "shard",
        *_NODE,
        "parent_a",
        "parent_b",
        "conv_id",
        own.alias("own"),
        F.when(own & (F.col("n_children") == 0), 1).otherwise(0).cast("long").alias("leaf"),
        F.when(own, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(0).alias("saved"),
    )
    sums = owned.groupBy("shard").applyInArrow(_up, _SUMS).groupBy(*_NODE).agg(
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"),
        F.max("parent_conv_id").alias("parent_conv_id"),
    )
    ends = local.select(*_NODE, F.explode("ends").alias("end"))
    ordered = ends.repartition(*_NODE).sortWithinPartitions(*_NODE, "end")
    digests = ordered.mapInArrow(_digests, "depth long, a long, b long, ends_sha256 string")
    empty = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(sums, _NODE)
        .join(digests, _NODE, "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
        )
    )
