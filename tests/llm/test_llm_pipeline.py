"""The pipeline's stages: their columns, decisions and awkward input."""

import random

import fixture
import pandas as pd
import pytest

from test_llm_join import components

import corpus_pipeline as P


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    docs = fixture.documents()
    labels = pd.DataFrame({"doc_id": docs.doc_id, "quality": 1, "toxic": 0})
    rng = random.Random(8)
    for k in range(120):
        text = fixture.sentence(rng, 40) + (" blockhead scoundrel" if k % 2 else "")
        docs.loc[len(docs)] = [1000 + k, text, "en", "s", len(text)]
        labels.loc[len(labels)] = [1000 + k, 1, k % 2]
    labels = labels[labels.doc_id < 1100]  # the last twenty are not labelled
    docs["score"] = "own"
    docs["_h"] = "own"
    return fixture.write(tmp_path_factory.mktemp("pipeline"), documents=docs, labels=labels, benchmark=fixture.benchmark())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        seen[name] = docs
        docs = stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == seen[name].columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    seen["end"] = docs
    ids = {k: [r.doc_id for r in v.select("doc_id").collect()] for k, v in seen.items()}
    toxic = {1000 + k for k in range(1, 120, 2)}
    assert set(ids["toxicity"]) - set(ids["line_dedup"]) == toxic
    for r in seen["near_copies"].collect():
        assert r.n_chars == len(r.text or "") and r.score == "own"
    classes = components([(r.doc_id, r.text) for r in seen["near_copies"].collect()], 5, 80)
    assert sorted(ids["decontamination"]) == sorted(d for d, (_, least) in classes.items() if d == least)
    left = [r.text or "" for r in seen["packing"].collect()]
    item = fixture.benchmark().text[0].split()
    for text in left:
        words = text.lower().split()
        grams = {tuple(words[k : k + 5]) for k in range(len(words))}
        hits = sum(tuple(item[k : k + 5]) in grams for k in range(len(item) - 4))
        assert hits < 0.8 * (len(item) - 4)
    assert set(ids["end"]) == set(ids["packing"])


def test_run(spark, folder):
    rows = P.run(spark, folder)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0


def test_empty_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
