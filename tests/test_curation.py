from pyspark.sql import functions as F

from fieldtrial.functions import text as tx
from fieldtrial.operators import curation


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_temperatures(spark):
    cases = {
        "64.2 °C": "64.2", "64.2 ± 0.5 °C": "64.2 ± 0.5", "64.2 +/- 0.5°C": "64.2 +/- 0.5",
        "64.2 ± 0.5 °C": "64.2 ± 0.5", "64.2": None, "": None, None: None,
        "51 °C then 70 °C": "51",
    }
    assert column(spark, list(cases), tx.extract_tm) == list(cases.values())


def test_mismatches(spark):
    df = spark.createDataFrame(
        [("A 50 °C", "50 °C"), ("A 50 °C", "51 °C"), ("A", "51 °C"), ("A 50 °C", None)], "`TM Variant` string, Tm string"
    )
    assert [(r["Tm_extracted"], r["Tm_dep_extracted"]) for r in curation.tm_mismatches(df).collect()] == [("50", "51")]


def test_variants(spark):
    cases = {
        '{"variants": ["EGF WT", " EGF L52I ", "EGF WT", ""]}': ["EGF WT", "EGF L52I"],
        '["a", "b", "a"]': ["a", "b"],
        '{"variants": []}': [],
        "- one\n• two\r\n\n  - one \n": ["one", "two"],
        '{"names": ["x"]}': ['{"names": ["x"]}'],
        '```json\n["a"]\n```': ["```json", '["a"]', "```"],
        "": [],
    }
    assert column(spark, list(cases), tx.parse_variants) == list(cases.values())


def test_verdicts_and_flags(spark):
    answers = [
        '{"buffer": true, "pH": true, "concentration": true}',
        '{"concentration": true, "buffer": false, "pH": true}',
        '{"buffer": true, "pH": null, "concentration": true}',
        "no json", None,
    ]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    flags = curation.summarize_flags(df.select("i", tx.parse_verdict(F.col("a")).alias("v")).select("i", "v.*"))
    got = [(r["inconsistent_fields"], r["any_inconsistent"]) for r in flags.orderBy("i").collect()]
    every = "Buffer; pH; Protein concentration"
    assert got == [("", False), ("Buffer", True), ("pH", True), (every, True), (every, True)]
    assert flags.where("i = 2").first()["pH_ok"] is None and flags.where("i = 3").first()["pH_ok"] is False


REVIEW = [
    (1, "P1", "v1 ", "Correct", ""), (2, "P1", "v2", "revised", " v2b "), (3, "P1", "v3", "Added", "v3b"),
    (4, "P1", "v4", "incorrect", "v4b"), (5, "P1", "v5", "", "v5b"), (6, "P2", "w1", "correct", ""),
]


def test_reviewed_variants(spark):
    df = spark.createDataFrame(
        REVIEW, "row long, Key string, `TM Variant` string, `Correct or not?` string, `Revised or Not.` string"
    )
    for block in (1, 2, 1000):
        got = sorted(tuple(r) for r in curation.variants_by_key(df, "row", block).collect())
        assert got == [("P1", 1, "v1"), ("P1", 2, "v2b"), ("P1", 3, "v3b"), ("P1", 4, "v4"), ("P2", 1, "w1")]


def test_combined_texts(spark):
    files = spark.createDataFrame(
        [("a", 2, "second", "f2"), ("a", 1, "first", "f1"), ("b", 1, " \n", "g"), ("a", 3, None, "f3")],
        "k string, n int, t string, f string",
    )
    got = curation.combine_texts(files, "k", "n", "t", "f").collect()
    assert [tuple(r) for r in got] == [("a", 0, "first\nsecond\n\n", "f1; f2; f3")]
    parts = curation.combine_texts(files, "k", "n", "t", "f", chunk_chars=6, block_size=1).orderBy("chunk").collect()
    assert "".join(r["text"] for r in parts) == "first\nsecond\n\n" and len(parts) > 1


def test_questions_and_answers(spark):
    papers = spark.createDataFrame([("p",), ("q",)], "key string")
    variants = spark.createDataFrame([("p", "L52I")], "key string, variant string")
    questions = curation.paper_questions(papers, variants)
    assert questions.count() == 2 * 4 + 9
    prompts = curation.build_prompts(questions, curation.template_table(spark))
    row = prompts.where("column = 'Engineered variant?'").first()
    assert row["prompt"] == "For variant “L52I”, is it engineered? Answer Yes or No."
    assert prompts.where("prompt like '%{variant}%' or prompt like '%{column}%'").count() == 0
    answers = prompts.where("variant is not null").select("key", "variant", "column", F.length("prompt").cast("string").alias("answer"))
    wide = curation.assemble_answers(answers, ["Tm", "Buffer"]).collect()
    assert len(wide) == 1 and wide[0]["Tm"] is not None


def test_judge_request(spark):
    df = spark.createDataFrame(
        [("d" * 3000, "{ph}", "7", None)],
        "`Experimental Conditions/Methods Description` string, Buffer string, pH string, `Protein concentration` string",
    )
    text = curation.build_judge_request(df).first()["request"]
    assert "d" * 3000 in text
    cut = curation.build_judge_request(df, max_chars=2000).first()
    assert "d" * 2000 in cut["request"] and "d" * 2001 not in cut["request"]
    assert cut["system"] == curation.JUDGE_SYSTEM
    assert '- Buffer: "{ph}"' in text and '- pH: "7"' in text and '- Protein concentration: ""' in text


def test_variants_by_sql_equal_the_column_function(spark):
    from fieldtrial.functions.sql import register_functions
    from fieldtrial.functions.text import parse_variants

    register_functions(spark)
    answers = [
        None, "", "  ", '{"variants": [" A ", "", "A", null, "B"]}', '["x", "y", "x"]', "• one\n- two\r\n\tone three",
        '{"other": 1}', "[broken", "{broken}", "it's 'quoted'\n\\d+", " \n",
    ]
    table = spark.createDataFrame(list(enumerate(answers)), "id int, answer string")
    rows = spark.sql(
        "SELECT t.id, v.ordinal, v.variant FROM {t} AS t, LATERAL paper_variants(t.answer) AS v", t=table
    ).collect()
    got = {i: [] for i in range(len(answers))}
    for r in sorted(rows):
        got[r.id].append(r.variant)
    want = table.select("id", parse_variants(table.answer).alias("v")).collect()
    assert got == {r.id: r.v or [] for r in want}
