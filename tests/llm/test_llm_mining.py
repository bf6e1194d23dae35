"""Conversation trie, hard negatives and license scan: SQL on awkward rows, and plain Python."""

import hashlib
import random
import zlib

import fixture
import pandas as pd
import pytest
from oracle import differences
from pyspark.sql import functions as F

from fieldtrial.llm.common import Scratch
from fieldtrial.llm.conversation_trie import branches, placed_turns, prefix_trie
from fieldtrial.llm.hard_negatives import hard_negatives, quantized
from fieldtrial.llm.license_scan import TEMPLATES, license_scan, license_spans
from fieldtrial.llm.queries import QUERIES, SQL

TURNS = "conv_id long, turn long, role string, text string, place string, a int"


def turns():
    rng = random.Random(3)
    rows = []
    for conv in [*range(60), 1000, 1003, -7]:
        for turn in range(rng.randrange(1, 11)):
            rows.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "ü"]), "x", 1))
    rows += [(70, None, None, None, "x", 1), (70, None, "user", "z", "x", 1), (70, 1, "user", "z", "x", 1)]
    rows += [(71, 1, "user", "tie", "x", 1), (71, 1, "user", "tie", "x", 1), (71, 1, "user", "other", "x", 1)]
    rows += [(72, 1, "user", "long " * 40000, "x", 1), (None, 1, "user", "nobody", "x", 1)]
    return rows


def plain_trie(rows):
    """Every node as a dict by prefix, straight from the definition."""
    convs = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members, ends = {}, {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, convs_ in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(convs_) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


@pytest.mark.parametrize("shard_turns", [20, 100_000])
def test_trie_against_plain_python(spark, shard_turns):
    rows = turns()
    table = spark.createDataFrame(rows, TURNS).repartition(7)
    scratch = Scratch(spark)
    placed = scratch.write(placed_turns(table, scratch), "placed")
    got = prefix_trie(*branches(placed), shard_turns=shard_turns).collect()
    assert sorted(map(tuple, got)) == plain_trie(rows)


def test_trie_query_equals_sql(spark, tmp_path):
    frame = pd.DataFrame(turns(), columns=[c.split(" ")[0] for c in TURNS.split(", ")])
    frame = frame.where(frame.conv_id.isna() | (frame.conv_id >= 0)).dropna(how="all")
    frame = frame.astype({"conv_id": "Int64", "turn": "Int64"})
    folder = fixture.write(tmp_path, conversations=frame)
    name = "op11_conversation_trie"
    assert differences(QUERIES[name](spark, folder), fixture.connect(folder, "conversations"), SQL[name]) == []


def test_one_conversation_over_many_partitions(spark):
    rows = [(5, k, "user", "t" * (k + 1)) for k in range(400)] + [(9, k, "user", "x") for k in range(3)]
    scratch = Scratch(spark)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = placed_turns(table, scratch).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r["place"], r["bytes"]) for r in placed if r["conv_id"] == 5) == [(k + 1, k + 1) for k in range(400)]


def vectors():
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(6)], rng.randrange(3), 1, "x") for k in range(400)]
    rows += [(k, rows[k % 7][1], k % 3, 1, "x") for k in range(400, 460)]
    rows += [(500, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 1, "x"), (550, [float("nan")] * 6, 1, 1, "x")]
    rows += [(600, [float("inf")] * 6, 1, 1, "x"), (650, None, 1, 1, "x"), (700, rows[0][1], None, 1, "x")]
    return rows + [(50, rows[50][1], rows[50][2], 1, "x"), (3, rows[3][1], rows[3][2], 1, "x")]


VECTORS = "vec_id long, embedding array<double>, label int, row long, anchor string"


def test_negatives_query_equals_sql(spark, tmp_path):
    table = spark.createDataFrame(vectors(), VECTORS)
    table.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = fixture.connect("")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    name = "op12_hard_negatives"
    assert differences(QUERIES[name](spark, str(tmp_path)), con, SQL[name]) == []


def plain_negatives(rows, anchors, n_positives, n_negatives):
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    out = []
    for i, (anchor, q, label) in enumerate(rows):
        if not anchors(anchor):
            continue
        scored = [(-max(-(2**63) + 1, min(2**63 - 1, dot(q, r[1]))), r[0], r[2] == label) for j, r in enumerate(rows) if j != i]
        scored.sort()
        for down, positive, _ in [s for s in scored if s[2]][:n_positives]:
            hard = [s for s in scored if not s[2] and 50 * -down <= 100 * -s[0] <= 95 * -down][:n_negatives]
            out += [(anchor, positive, k + 1, s[1], -down, -s[0]) for k, s in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("scale", [5, 10**8, 10**12])
def test_negatives_of_any_size(spark, scale):
    rng = random.Random(scale)
    rows = [(k, [rng.randrange(-scale, scale) for _ in range(rng.choice([3, 4]))], rng.choice("ab")) for k in range(80)]
    given = [(k, label, q) for k, q, label in rows]
    table = spark.createDataFrame(given, "vec_id long, label string, q array<long>")
    got = hard_negatives(table, F.col("vec_id") % 4 == 0, 3, 2).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows, lambda k: k % 4 == 0, 3, 2)


def test_negatives_of_nothing(spark):
    empty = quantized(spark.createDataFrame([], VECTORS), "embedding")
    assert hard_negatives(empty, F.col("vec_id") % 50 == 0).count() == 0


def licensed():
    rng = random.Random(6)
    long_text = next(t for label, t in TEMPLATES if label == "mit" and len(t) > 200)
    words = long_text.split()
    added = " ".join(words[:20] + ["new", "words"] + words[20:45] + words[46:])
    out = [None, "", " \n", "MIT", "mit license", "The M.I.T License; mit\nLICENSE mit-license", "apache license " * 3000]
    out += ["General public, license. general public license general", "É mit license é", "x" * 50000]
    out += [f"{fixture.sentence(rng, 40)}\n{t}\n{fixture.sentence(rng, 20)}" for _, t in TEMPLATES]
    out += [added, f"{long_text} {fixture.sentence(rng, 9)} {long_text}", " ".join(words[:30]), long_text.upper()]
    out += [" ".join(rng.sample(words, len(words))), "Licensed under CC BY", fixture.sentence(rng, 3000)]
    return out


def test_licenses_query_equals_sql(spark, tmp_path):
    own = licensed()
    frame = pd.DataFrame({"doc_id": range(len(own)), "text": own, "label": "l", "template": 1, "hash": 1, "at": 2})
    folder = fixture.write(tmp_path, documents=frame)
    name = "op13_license_scan"
    assert differences(QUERIES[name](spark, folder), fixture.connect(folder, "documents"), SQL[name]) == []


def test_license_labels_and_spans(spark):
    own = licensed()
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan(docs).collect()}
    first = own.index("x" * 50000) + 1
    for k, (label, _) in enumerate(TEMPLATES):
        assert label in got[first + k]["labels"].split(",")
    added = first + len(TEMPLATES)
    assert [got[added + j]["labels"] for j in range(7)] == ["mit", "mit", "", "mit", "", "", ""]
    assert (got[5]["n_base"], got[5]["first_word"], got[5]["last_word"]) == (2, 5, 7)
    spans = license_spans(docs).where(F.col("doc_id") == added + 1).orderBy("first").collect()
    words = len(next(t for label, t in TEMPLATES if label == "mit" and len(t) > 200).replace("/", " ").split())
    assert [(s["first"], s["last"]) for s in spans] == [(0, words - 1), (words + 9, 2 * words + 8)]


def test_license_rows_that_repeat(spark):
    row = (1, "Released under the MIT License.")
    docs = spark.createDataFrame([row, row, (1, "plain"), (None, row[1]), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["labels"], r["n_words"]) for r in license_scan(docs).collect())
    assert got == [(0, "", 0), (0, "mit", 5), (1, "", 1), (1, "mit", 5), (1, "mit", 5)]


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_hard_negatives", "op13_license_scan"])
def test_empty_tables(spark, tmp_path, name):
    for table, schema in [
        ("documents", "doc_id long, text string"), ("conversations", TURNS), ("embeddings", VECTORS)
    ]:
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
