"""Best-fit packing by exact complements of lengths.

Only lengths decide where a piece goes, and there are at most ``size`` of them. So the driver plans
with a histogram of lengths (``size`` numbers, whatever the corpus), and every piece finds its place
from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import END_ID, TOKENIZER, encoder, pieces, with_end

SIZE = 1024

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


def piece_rows(docs: DataFrame, size: int = SIZE, tokenizer: str = TOKENIZER, end_id: int = END_ID):
    """One row per piece, with the task that made it and its rank there among pieces of its length."""

    def cut(batches):
        encode, seen, part = encoder(tokenizer), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = with_end(encode(text.as_py() or ""), end_id)
                for k, (start, n) in enumerate(pieces(len(ids), size)):
                    rows.append(
                        (doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), part, seen[n])
                    )
                    seen[n] += 1
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank")
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], list(names)
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return own.mapInArrow(cut, _PIECES)


class _Plan:
    """Consumes availability counts into groups of equally filled sequences."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size = size
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.groups: list[tuple[tuple[int, ...], int]] = []

    def use(self, lengths: tuple[int, ...]) -> int:
        """Fill as many sequences with these lengths as the counts allow."""
        need = Counter(lengths)
        times = min(self.left.get(n, 0) // k for n, k in need.items())
        if times:
            for n, k in need.items():
                self.left[n] -= k * times
                if not self.left[n]:
                    del self.left[n]
            self.groups.append((lengths, times))
        return times

    def complements(self) -> None:
        """Fill gaps exactly by one, two or three lengths, the longest pieces first."""
        for first in sorted(self.left, reverse=True):
            if first == self.size:
                self.use((first,))
                continue
            gap = self.size - first
            if first in self.left:
                self.use((first, gap))
            for combination in self.pairs(gap):
                if first not in self.left:
                    break
                self.use((first, *combination))
        for first in sorted(self.left, reverse=True):
            gap = self.size - first
            for second in sorted((n for n in self.left if n < gap), reverse=True):
                if first not in self.left:
                    break
                for combination in self.pairs(gap - second, second):
                    if first not in self.left or second not in self.left:
                        break
                    self.use((first, second, *combination))

    def pairs(self, total: int, most: int | None = None):
        """Available pairs with this sum, the longer length first and at most ``most``."""
        for a in sorted((n for n in self.left if 2 * n >= total and n < total), reverse=True):
            if (most is None or a <= most) and a in self.left and total - a in self.left:
                yield a, total - a

    def best_fit(self) -> None:
        """Place what is left, longest first, where the least space stays free."""
        open_: dict[int, Counter] = {}
        for n in sorted(self.left, reverse=True):
            todo = self.left[n]
            while todo:
                fits = [free for free in open_ if free >= n]
                if fits:
                    free = min(fits)
                    lengths, have = open_[free].popitem()
                    if not open_[free]:
                        del open_[free]
                else:
                    free, lengths, have = self.size, (), todo
                each = min(free // n, todo)
                times = min(have, todo // each)
                if fits and have > times:
                    open_.setdefault(free, Counter())[lengths] += have - times
                open_.setdefault(free - each * n, Counter())[lengths + (n,) * each] += times
                todo -= each * times
        self.left = {}
        self.groups += [(lengths, c) for bins in open_.values() for lengths, c in bins.items()]


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Groups of (lengths, number of sequences filled with them) that use every count up."""
    made = _Plan(counts, size)
    made.complements()
    made.best_fit()
    return made.groups


def places(groups) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, sequence ids and offsets of its runs of places."""
    runs: dict[int, list] = {}
    filled: Counter = Counter()
    base = 0
    for lengths, times in groups:
        offset = 0
        for n in lengths:
            runs.setdefault(n, []).append((filled[n], base, offset))
            filled[n] += times
            offset += n
        base += times
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for n, r in runs.items()}


def pack_documents(
    docs: DataFrame,
    size: int = SIZE,
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Pack whole documents (longer ones in pieces) into sequences of at most ``size`` tokens.

    ``docs`` has doc_id and text; a null text is empty and still has its end id. Other columns are
    ignored, equal rows are packed as often as they occur, an empty table gives no rows. Returns
    doc_id, piece, start, length, ids_crc32, sequence_id and offset.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.write(piece_rows(docs, size, tokenizer, end_id), "pieces")
    sizes = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = places(plan(counts, size))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = rows.join(first, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local_rank")).alias("rank")
    )

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(group):
                    starts, bases, offsets = runs[int(length[group[0]])]
                    at = np.searchsorted(starts, rank[group], side="right") - 1
                    sequence[group] = bases[at] + rank[group] - starts[at]
                    offset[group] = offsets[at]
            kept = [batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
