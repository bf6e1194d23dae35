"""Token ids packed best-fit-decreasing and written as binary matrices.

Every task packs its own documents in blocks of bounded size, so no token is shuffled and no
key can make a task large.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import END_ID, TOKENIZER, encoder, pieces, with_end

SIZE = 2048
# A block is packed when it holds this many tokens (or after the one document that passes it).
BLOCK_TOKENS = 1 << 21

_BLOCKS = (
    "block string, n_rows int, row_length int, ids binary, cu_seqlens array<int>, "
    "position_resets array<int>, doc_ids array<long>, starts array<long>, crc32s array<long>"
)


class FreeSpace:
    """A segment tree over free capacities 0..size: finds the tightest open row in log(size)."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def push(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def pop(self, need: int) -> tuple[int, int] | None:
        """(capacity, row) with the least capacity of at least ``need``; None without any."""
        node = self.leaves + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.rows[capacity].pop()


def pack_lengths(lengths: list[int], size: int) -> list[list[int]]:
    """Best-fit decreasing: the indexes of the lengths in each row."""
    space, rows = FreeSpace(size), []
    for index in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = space.pop(lengths[index])
        if found is None:
            found = size, len(rows)
            rows.append([])
        capacity, row = found
        rows[row].append(index)
        space.push(capacity - lengths[index], row)
    return rows


def _block(name: str, held: list, size: int, dtype) -> tuple:
    """A block's matrix and the lists that describe it; padding is 0 and belongs to no segment."""
    parts = [(doc, start, ids[start : start + n]) for doc, ids in held for start, n in pieces(len(ids), size)]
    rows = pack_lengths([len(p[2]) for p in parts], size)
    matrix = np.zeros((len(rows), size), dtype=dtype)
    ends, resets, docs, starts, sums = [], [], [], [], []
    for r, row in enumerate(rows):
        at = 0
        for index in row:
            doc, start, ids = parts[index]
            matrix[r, at : at + len(ids)] = ids
            resets.append(r * size + at)
            at += len(ids)
            ends.append(r * size + at)
            docs.append(doc)
            starts.append(start)
            sums.append(zlib.crc32(ids.tobytes()))
    return name, len(rows), size, matrix.tobytes(), ends, resets, docs, starts, sums


def write_packed(
    docs: DataFrame,
    path: str,
    size: int = SIZE,
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
    dtype: str = "<u2",
) -> DataFrame:
    """Write the packed ids of ``docs`` (doc_id, text) under ``path`` and return them.

    A row is a block: ``ids`` is the n_rows x row_length matrix (row-major, ``dtype``); segment k
    covers the flat places position_resets[k] to cu_seqlens[k], where positions start at 0 again,
    and holds the ids of doc_ids[k] from starts[k] on. crc32s[k] checks its little-endian 32-bit
    ids. Overlong documents are cut into several segments, none is lost. A null text is empty and
    keeps its end id; other columns are ignored; an empty table writes no block.
    """
    names = [x.split()[0] for x in _BLOCKS.split(", ")]
    lists = [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64())] * 3
    types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), *lists]

    def pack(batches):
        encode, part, made = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held, tokens = [], 0

        def flush():
            row = _block(f"{part}-{made}", held, size, np.dtype(dtype))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((doc_id, with_end(encode(text.as_py() or ""), end_id)))
                tokens += len(held[-1][1])
                if tokens >= block_tokens:
                    yield flush()
                    held, tokens, made = [], 0, made + 1
        if held:
            yield flush()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    own.mapInArrow(pack, _BLOCKS).write.parquet(path)
    return docs.sparkSession.read.schema(_BLOCKS).parquet(path)


def segments(blocks: DataFrame) -> DataFrame:
    """One row per segment: doc_id, start, length, ids_crc32, sequence_id and offset."""
    zipped = F.arrays_zip("doc_ids", "starts", "crc32s", "position_resets", "cu_seqlens")
    each = blocks.select("block", "row_length", F.explode(zipped).alias("s"))
    row = F.floor(F.col("s.position_resets") / F.col("row_length"))
    return each.select(
        F.col("s.doc_ids").alias("doc_id"),
        F.col("s.starts").alias("start"),
        (F.col("s.cu_seqlens") - F.col("s.position_resets")).cast("long").alias("length"),
        F.col("s.crc32s").alias("ids_crc32"),
        F.concat_ws("-", "block", row.cast("string")).alias("sequence_id"),
        (F.col("s.position_resets") - row * F.col("row_length")).cast("long").alias("offset"),
    )
