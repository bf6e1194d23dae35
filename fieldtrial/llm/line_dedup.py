"""Line dedup by prefix doubling over line ids.

The suffixes of all texts, as sequences of line ids, are grouped by ever longer prefixes: round k
names the runs of 2^k lines from two names of round k - 1, and suffixes whose run occurs once leave.
Suffixes with one name are one interval of the suffix array, with a common prefix of at least 2^k
lines. A run of any length is the pair of names of its first and its last 2^k lines, so the shortest
runs with enough words from every line on, and up to every line, tell all repeated runs of that many
words: a maximal repeated run is the union of the ones it holds. The first copy of a run stays.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_sized, pack, unpack

# A repeated run is deleted when it has at least this many words.
MIN_WORDS = 50

_LINES = "r long, h long, pos int, a long, b long, forth int, back int"


def shortest_runs(words: list[int], enough: int) -> tuple[list[int], list[int]]:
    """Lines of the shortest run with ``enough`` words from, and up to, every line; 0 for none."""
    forth, back = [0] * len(words), [0] * len(words)
    end = total = 0
    for start, n in enumerate(words):
        while end < len(words) and total < enough:
            total += words[end]
            end += 1
        if total >= enough:
            forth[start] = end - start
        total -= n
    start = total = 0
    for last, n in enumerate(words):
        total += n
        while total - words[start] >= enough:
            total -= words[start]
            start += 1
        if total >= enough:
            back[last] = last - start + 1
    return forth, back


def line_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """One row per line with words: its document's key, place, id (128 bits) and shortest runs."""

    def cut(batches):
        names = [x.split()[0] for x in _LINES.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        for batch in batches:
            rows = []
            for r, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = [x for x in map(str.strip, (text or "").split("\n")) if x]
                forth, back = shortest_runs([len(x.split()) for x in own], min_words)
                for pos, line in enumerate(own):
                    whole = xxhash.xxh3_128_digest(line.encode("utf-8", "replace"))
                    a, b = (int.from_bytes(x, "big", signed=True) for x in (whole[:8], whole[8:]))
                    rows.append((r, h, pos, a, b, forth[pos], back[pos]))
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return keyed(docs).select("r", "h", F.col("text").cast("string")).mapInArrow(cut, _LINES)


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with the key (r, h): the id (null as the least number) and a hash of the text."""
    return docs.withColumns(
        {
            "r": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))),
            "h": F.xxhash64("text"),
        }
    )


def repeated(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows whose id (a, b) occurs at several places."""
    counts = scratch.write(rows.groupBy("a", "b").count().where("count > 1").select("a", "b"), f"{name}-ids")
    return scratch.write(rows.join(counts, ["a", "b"], "left_semi"), name)


def repeated_runs(docs: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """(r, h, start, m) of every shortest run with ``min_words`` words that occurs earlier."""
    # Equal rows are one document here; they are treated alike.
    lines = scratch.write(line_rows(docs.dropDuplicates(["doc_id", "text"]), min_words), "lines")
    base = repeated(lines, scratch, "round-0")
    scratch.drop("lines", "round-0-ids")
    runs = (
        base.where("forth > 0").select("r", "h", F.col("pos").alias("start"), F.col("forth").alias("m"))
        .unionByName(
            base.where("back > 0").select("r", "h", (F.col("pos") - F.col("back") + 1).alias("start"), F.col("back").alias("m"))
        )
        .distinct()
        .withColumn("level", F.floor(F.log2("m")).cast("int"))
    )
    runs = scratch.write(runs, "runs")
    levels = [r["level"] for r in runs.select("level").distinct().collect()]  # log2(min_words) + 1 at most
    names = base.select("r", "h", "pos", "a", "b")
    found = None
    for level in range(max(levels, default=-1) + 1):
        size = 1 << level
        head = names.select("r", "h", F.col("pos").alias("start"), F.col("a").alias("a1"), F.col("b").alias("b1"))
        tail = names.select("r", "h", F.col("pos").alias("last"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        own = runs.where(F.col("level") == level).withColumn("last", F.col("start") + F.col("m") - size)
        if size == 1:  # runs of one line
            named = own.join(head, ["r", "h", "start"]).withColumns({"a2": F.col("a1"), "b2": F.col("b1")})
        else:
            named = own.join(head, ["r", "h", "start"]).join(tail, ["r", "h", "last"])
        named = named.select("r", "h", "start", "m", "a1", "b1", "a2", "b2")
        found = named if found is None else found.unionByName(named)
        if level < max(levels):
            after = names.select("r", "h", (F.col("pos") - size).alias("pos"), F.col("a").alias("a2"), F.col("b").alias("b2"))
            double = names.join(after, ["r", "h", "pos"]).select(
                "r",
                "h",
                "pos",
                F.xxhash64(F.lit(level), "a", "a2").alias("a"),
                F.xxhash64(F.lit(-1 - level), "b", "b2").alias("b"),
            )
            names = repeated(scratch.write(double, f"pairs-{level}"), scratch, f"round-{level + 1}")
    if found is None:
        return runs.select("r", "h", "start", "m")
    found = scratch.write(found, "named")
    key = ["m", "a1", "b1", "a2", "b2"]
    first = found.groupBy(*key).agg(F.min(F.struct("r", "h", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = scratch.write(first.where("n > 1").drop("n"), "first")
    later = found.join(first, key).where(F.struct("r", "h", "start") > F.col("first"))
    return later.select("r", "h", "start", "m")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """Every row of ``docs``, its text without the later copies of repeated runs of lines.

    A run repeats when its lines, stripped, occur in the same order earlier (by doc_id) in the same
    or another text, lines without words not counted; it is deleted when it has ``min_words`` words
    or more, and of each run the first copy stays. All columns stay, n_lines, n_removed and
    removed_all are added (own columns of these names are replaced). A null text stays null, a
    text without a deleted line is unchanged to the byte; equal rows are one document and stay
    equal; an empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    runs = repeated_runs(docs.select("doc_id", F.col("text").cast("string")), min_words, scratch)
    per_text = runs.groupBy("r", "h").agg(F.collect_set(F.struct("start", "m")).alias("cut"))
    cuts = scratch.write(
        per_text.select("r", "h", F.col("cut.start").alias("_starts"), F.col("cut.m").alias("_sizes")), "cuts"
    )
    scratch.drop(*[name for name in scratch.paths if name != "cuts"])
    rows = keyed(pack(docs, "doc_id", "text"))
    joined = join_sized(rows, cuts, ["r", "h"], "left", scratch, "cuts").drop("r", "h")
    text = joined.columns.index("text")
    names = [c for c in joined.columns if c not in ("_starts", "_sizes")]

    def clean(batches):
        for batch in batches:
            texts, counts, gone = [], [], []
            columns = (batch.column(k).to_pylist() for k in ("text", "_starts", "_sizes"))
            for own, starts, sizes in zip(*columns):
                lines = (own or "").split("\n")
                kept, pos, removed = [], 0, 0
                cut = {p for s, m in zip(starts or (), sizes or ()) for p in range(s, s + m)}
                for line in lines:
                    if line.strip():
                        removed += pos in cut
                        if pos not in cut:
                            kept.append(line)
                        pos += 1
                    else:
                        kept.append(line)
                texts.append("\n".join(kept) if removed else own)
                counts.append(pos)
                gone.append(removed)
            arrays = [pa.array(texts, pa.string()) if k == text else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(counts, pa.int32()), pa.array(gone, pa.int32())],
                [*names, "n_lines", "n_removed"],
            )

    types = dict(joined.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in names] + ["n_lines int", "n_removed int"])
    done = joined.select(*names, "_starts", "_sizes").mapInArrow(clean, schema)
    added = {
        "n_lines": F.col("n_lines"),
        "n_removed": F.col("n_removed"),
        "removed_all": (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines")),
    }
    own = [c for c in docs.columns if c not in added]
    return done.select(*unpack(done, own, "doc_id", "text"), *[v.alias(k) for k, v in added.items()])
