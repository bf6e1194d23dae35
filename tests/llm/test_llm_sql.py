"""Queries with SQL, over awkward rows."""


import fixture
import pandas as pd
import pytest
from oracle import differences

from fieldtrial.llm.queries import QUERIES, SQL

# Those of test_llm_mining.py have tables of their own.
NAMES = sorted(n for n in SQL if not n.startswith(("op11", "op12", "op13")))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    turns = []
    for conv, texts in enumerate(
        [["hi", "yo"], ["hi", "yo", "more"], ["hi", "yo", "more"], ["hi"], ["other", None], ["hi", "no"], [""], ["y", "hi"]]
    ):
        turns += [(conv, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]
    turns += [(20, 3, None, "a"), (20, 3, "user", "a"), (21, None, "user", "b"), (21, 1, "user", "c")]
    conversations = pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"])
    conversations["turn"] = conversations["turn"].astype("Int64")
    return fixture.write(
        tmp_path_factory.mktemp("sql"),
        documents=fixture.documents(), benchmark=fixture.benchmark(), conversations=conversations,
    )


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, folder, name):
    con = fixture.connect(folder, "documents", "benchmark", "conversations")
    assert differences(QUERIES[name](spark, folder), con, SQL[name]) == []


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, tmp_path, name):
    documents = fixture.documents().iloc[:0].astype({"text": "string", "lang": "string", "source": "string"})
    conversations = pd.DataFrame({"conv_id": [1], "turn": [0], "role": ["a"], "text": ["b"]}).iloc[:0]
    folder = fixture.write(
        tmp_path, documents=documents, benchmark=fixture.benchmark(), conversations=conversations
    )
    assert QUERIES[name](spark, folder).count() == 0
