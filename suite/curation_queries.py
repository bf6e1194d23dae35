"""Curation and streaming queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from fieldtrial.functions import text as tx
from fieldtrial.functions.sql import register_functions
from fieldtrial.operators import curation
from fieldtrial.session import scratch_path
from fieldtrial.sources import results as result_files
from fieldtrial.streaming import results_stream

from .inputs import rounded
from .prep_queries import _result_documents
from .registry import query, table

TM_TAIL = """' Tm was ' || (n_chars % 90) || CASE doc_id % 4
    WHEN 0 THEN '.5 ± 0.' || (doc_id % 9) || ' °C' WHEN 1 THEN ' +/- 1°C'
    WHEN 2 THEN chr(160) || '±' || chr(160) || '2.25 °C' ELSE ' K' END"""
TM_REGEX = (
    r"([0-9]+(?:\.[0-9]+)?(?:[\s\x{00A0}]*(?:±|\+/-)[\s\x{00A0}]*[0-9]+(?:\.[0-9]+)?)?)"
    r"[\s\x{00A0}]*°C"
)


def _tm_text():
    k = F.col("doc_id") % 4
    nbsp = " "
    tail = (
        F.when(k == 0, F.concat(F.lit(".5 ± 0."), (F.col("doc_id") % 9).cast("string"), F.lit(" °C")))
        .when(k == 1, F.lit(" +/- 1°C"))
        .when(k == 2, F.lit(f"{nbsp}±{nbsp}2.25 °C"))
        .otherwise(F.lit(" K"))
    )
    return F.concat(F.col("text"), F.lit(" Tm was "), (F.col("n_chars") % 90).cast("string"), tail)


@query(
    "p15_extract_tm",
    f"""SELECT doc_id, nullif(regexp_extract(text || {TM_TAIL}, '{TM_REGEX}', 1), '') AS tm
    FROM documents""",
)
def p15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.extract_tm(_tm_text()).alias("tm"))


@query(
    "p16_tm_mismatches",
    f"""WITH t AS (SELECT doc_id,
      nullif(regexp_extract(text || {TM_TAIL}, '{TM_REGEX}', 1), '') AS Tm_extracted,
      nullif(regexp_extract('about ' || (n_chars % 45) || ' °C', '{TM_REGEX}', 1), '') AS Tm_dep_extracted
      FROM documents)
    SELECT * FROM t WHERE Tm_extracted <> Tm_dep_extracted""",
)
def p16(spark, sf):
    second = F.concat(F.lit("about "), (F.col("n_chars") % 45).cast("string"), F.lit(" °C"))
    d = table(spark, sf, "documents").select(
        "doc_id", _tm_text().alias("TM Variant"), second.alias("Tm")
    )
    return curation.tm_mismatches(d).select("doc_id", "Tm_extracted", "Tm_dep_extracted")


FLAGS = """CASE doc_id % 6 WHEN 0 THEN 'Correct' WHEN 1 THEN ' incorrect ' WHEN 2 THEN 'REVISED'
    WHEN 3 THEN 'added later' WHEN 4 THEN '' ELSE 'unclear' END"""
REVIEW = f"""review AS (SELECT source AS key, doc_id, {FLAGS} AS flag,
    lang || ' ' || n_chars AS variant, lang || '*' || doc_id AS revision FROM documents),
chosen AS (SELECT key, doc_id, CASE WHEN doc_id % 6 IN (0, 1) THEN variant
    WHEN doc_id % 6 IN (2, 3) THEN revision END AS variant FROM review WHERE doc_id % 6 < 4)"""


def _review(spark, sf):
    k = F.col("doc_id") % 6
    flag = (
        F.when(k == 0, F.lit("Correct")).when(k == 1, F.lit(" incorrect ")).when(k == 2, F.lit("REVISED"))
        .when(k == 3, F.lit("added later")).when(k == 4, F.lit("")).otherwise(F.lit("unclear"))
    )
    return table(spark, sf, "documents").select(
        F.col("source").alias("Key"),
        "doc_id",
        flag.alias("Correct or not?"),
        F.concat(F.lit("\t"), F.col("lang"), F.lit(" "), F.col("n_chars").cast("string"), F.lit(" ")).alias("TM Variant"),
        F.concat("lang", F.lit("*"), F.col("doc_id").cast("string")).alias("Revised or Not."),
    )


@query("p14_choose_variant", f"WITH {REVIEW} SELECT doc_id, variant FROM chosen")
def p14(spark, sf):
    return curation.reviewed_variants(_review(spark, sf)).select("doc_id", "variant")


@query(
    "a17_variants_by_key",
    f"""WITH {REVIEW} SELECT key, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS position,
    variant FROM chosen""",
)
def a17(spark, sf):
    return curation.variants_by_key(_review(spark, sf), "doc_id", block_size=64)


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ALL_COLUMNS = [*curation.PAPER_COLUMNS, *curation.DEPENDENT_COLUMNS, curation.ENGINEERED_COLUMN]
TEMPLATE_SQL = "templates(col, template) AS (VALUES {})".format(
    ", ".join(f"({_quote(c)}, {_quote(curation.TEMPLATES[c])})" for c in ALL_COLUMNS)
)
PAPER_LIST = ", ".join(_quote(c) for c in curation.PAPER_COLUMNS)
PAPERS = """papers AS (SELECT DISTINCT 'conv ' || conv_id AS key FROM conversations),
variants AS (SELECT 'conv ' || conv_id AS key, role || ' ' || turn AS variant FROM conversations
  WHERE role <> 'system')"""
QUESTIONS = f"""questions AS (
  SELECT key, NULL::VARCHAR AS variant, col FROM papers, templates WHERE col IN ({PAPER_LIST})
  UNION ALL
  SELECT key, variant, col FROM papers JOIN variants USING (key), templates
  WHERE col NOT IN ({PAPER_LIST}))"""


def _papers(spark, sf):
    c = table(spark, sf, "conversations").withColumn(
        "key", F.concat(F.lit("conv "), F.col("conv_id").cast("string"))
    )
    variants = c.where("role <> 'system'").select(
        "key", F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("variant")
    )
    return c.select("key").distinct(), variants


@query(
    "j3_fan_out",
    f'WITH {PAPERS}, {TEMPLATE_SQL}, {QUESTIONS} SELECT key, variant, col AS "column" FROM questions',
)
def j3(spark, sf):
    return curation.paper_questions(*_papers(spark, sf))


@query("j4_join_variants", f"WITH {PAPERS} SELECT key, variant FROM papers JOIN variants USING (key)")
def j4(spark, sf):
    return curation.join_variants(*_papers(spark, sf))


@query(
    "p17_build_prompts",
    f"""WITH {PAPERS}, {TEMPLATE_SQL}, {QUESTIONS}
    SELECT key, variant, col AS "column",
    replace(replace(template, '{{column}}', col), '{{variant}}', coalesce(variant, '')) AS prompt
    FROM questions JOIN templates USING (col)""",
)
def p17(spark, sf):
    questions = curation.paper_questions(*_papers(spark, sf))
    return curation.build_prompts(questions, curation.template_table(spark))


@query(
    "j5_assemble_answers",
    """SELECT conv_id AS key, turn // 2 AS variant, min(CASE WHEN role = 'user' THEN text END) AS "user",
    min(CASE WHEN role = 'assistant' THEN text END) AS assistant,
    min(CASE WHEN role = 'system' THEN text END) AS system
    FROM conversations GROUP BY 1, 2""",
)
def j5(spark, sf):
    answers = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("key"),
        F.floor(F.col("turn") / 2).alias("variant"),
        F.col("role").alias("column"),
        F.col("text").alias("answer"),
    )
    return curation.assemble_answers(answers, ["user", "assistant", "system"])


@query(
    "a16_combine_texts",
    """SELECT conv_id AS key, 0 AS chunk,
    string_agg(text, chr(10) ORDER BY turn) || chr(10) AS text,
    string_agg(role || turn, '; ' ORDER BY turn) AS file_names
    FROM conversations GROUP BY conv_id""",
)
def a16(spark, sf):
    c = table(spark, sf, "conversations").withColumn(
        "name", F.concat("role", F.col("turn").cast("string"))
    )
    return curation.combine_texts(c, "conv_id", "turn", "text", "name")


@query(
    "a16_combine_texts_by_source",
    """WITH f AS (SELECT source AS key, doc_id, text, sum(length(text) + 1) OVER
      (PARTITION BY source ORDER BY doc_id) - length(text) - 1 AS before FROM documents)
    SELECT key, CAST(before // 50000 AS INTEGER) AS chunk,
    string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS text,
    string_agg('d' || doc_id, '; ' ORDER BY doc_id) AS file_names FROM f GROUP BY 1, 2""",
)
def a16_source(spark, sf):
    d = table(spark, sf, "documents").withColumn(
        "name", F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    )
    return curation.combine_texts(d, "source", "doc_id", "text", "name", 50_000, 100)


@query(
    "p18_truncate",
    """SELECT doc_id, substr(text, 1, 2000) AS short_text, length(substr(text, 1, 200000)) AS kept_chars
    FROM documents""",
)
def p18(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", tx.truncate(F.col("text"), curation.JUDGE_CHARS).alias("short_text"),
        F.length(tx.truncate(F.col("text"), curation.CONTEXT_CHARS)).cast("bigint").alias("kept_chars"),
    )


def _judge_sql() -> str:
    out, rest = [], curation.JUDGE_TEMPLATE
    values = {
        "{description}": "text", "{buffer}": "lang", "{ph}": "'7.' || (doc_id % 10)",
        "{concentration}": "n_chars || ' mg'",
    }
    for mark, value in values.items():
        before, rest = rest.split(mark, 1)
        out += [_quote(before), value]
    return " || ".join([*out, _quote(rest)])


@query(
    "p19_judge_request",
    f"SELECT doc_id, '{curation.JUDGE_SYSTEM}' AS system, {_judge_sql()} AS request FROM documents",
)
def p19(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id",
        F.col("text").alias("Experimental Conditions/Methods Description"),
        F.col("lang").alias("Buffer"),
        F.concat(F.lit("7."), (F.col("doc_id") % 10).cast("string")).alias("pH"),
        F.concat(F.col("n_chars").cast("string"), F.lit(" mg")).alias("Protein concentration"),
    )
    return curation.build_judge_request(d).select("doc_id", "system", "request")


VERDICT = """verdicts AS (SELECT doc_id, doc_id % 5 = 4 AS broken, quality = 1 AS q, toxic = 1 AS t
    FROM labels),
flags AS (SELECT doc_id, CASE WHEN broken THEN false ELSE q END AS buffer_ok,
    CASE WHEN broken THEN false ELSE t END AS pH_ok,
    CASE WHEN broken THEN false WHEN doc_id % 5 < 2 THEN q END AS conc_ok FROM verdicts)"""


def _verdicts(spark, sf):
    labels = table(spark, sf, "labels")
    body = F.to_json(
        F.struct(
            (F.col("toxic") == 1).alias("pH"),
            (F.col("quality") == 1).alias("buffer"),
            F.when(F.col("doc_id") % 5 < 2, F.col("quality") == 1).alias("concentration"),
        )
    )
    answer = F.when(F.col("doc_id") % 5 == 4, F.lit("sorry {")).otherwise(body)
    return labels.select("doc_id", tx.parse_verdict(answer).alias("v")).select("doc_id", "v.*")


@query("p20_parse_verdict", f"WITH {VERDICT} SELECT * FROM flags")
def p20(spark, sf):
    return _verdicts(spark, sf)


@query(
    "p21_summarize_flags",
    f"""WITH {VERDICT}, s AS (SELECT *, concat_ws('; ',
      CASE WHEN NOT coalesce(buffer_ok, false) THEN 'Buffer' END,
      CASE WHEN NOT coalesce(pH_ok, false) THEN 'pH' END,
      CASE WHEN NOT coalesce(conc_ok, false) THEN 'Protein concentration' END) AS inconsistent_fields
      FROM flags) SELECT *, inconsistent_fields <> '' AS any_inconsistent FROM s""",
)
def p21(spark, sf):
    return curation.summarize_flags(_verdicts(spark, sf))


_P22_SQL = r"""WITH a AS (SELECT doc_id, CASE doc_id % 3
      WHEN 0 THEN [lang, ' ' || source || ' ', '', lang, 'v' || n_chars]
      WHEN 1 THEN ['w' || n_chars, source, 'w' || n_chars]
      ELSE string_split(text, chr(10)) END AS raw FROM documents),
    b AS (SELECT doc_id, list_filter(list_transform(raw, lambda v:
      trim(CASE WHEN doc_id % 3 = 2 THEN trim(v, '•- ' || chr(9)) ELSE v END,
        ' ' || chr(9) || chr(13) || chr(160))),
      lambda v: v <> '') AS l FROM a)
    SELECT doc_id, list_filter(l, lambda v, i: list_position(l, v) = i) AS variants FROM b"""


@query(
    "p22_parse_variants",
    _P22_SQL,
)
def p22(spark, sf):
    answers = _answers(spark, sf)
    return answers.select("doc_id", tx.parse_variants(F.col("answer")).alias("variants"))


def _answers(spark, sf):
    """Documents as answers: a JSON object, a JSON array, or lines of text."""
    d = table(spark, sf, "documents")
    k = F.col("doc_id") % 3
    n = F.col("n_chars").cast("string")
    first = F.array("lang", F.concat(F.lit(" "), "source", F.lit(" ")), F.lit(""), "lang", F.concat(F.lit("v"), n))
    second = F.array(F.concat(F.lit("w"), n), F.col("source"), F.concat(F.lit("w"), n))
    answer = (
        F.when(k == 0, F.to_json(F.struct(first.alias("variants"))))
        .when(k == 1, F.to_json(second))
        .otherwise(F.col("text"))
    )
    return d.select("doc_id", answer.alias("answer"))


@query(
    "p22_variants_by_sql",
    _P22_SQL.replace(
        "SELECT doc_id, list_filter(l, lambda v, i: list_position(l, v) = i) AS variants FROM b",
        """, c AS (SELECT doc_id, list_filter(l, lambda v, i: list_position(l, v) = i) AS variants FROM b)
    SELECT doc_id, unnest(variants) AS variant, CAST(unnest(range(1, len(variants) + 1)) AS INTEGER) AS ordinal FROM c""",
    ),
)
def p22_sql(spark, sf):
    """The variants of every answer by a table function, called from SQL with LATERAL."""
    register_functions(spark)
    return spark.sql(
        "SELECT a.doc_id, v.ordinal, v.variant FROM {answers} AS a, LATERAL paper_variants(a.answer) AS v",
        answers=_answers(spark, sf),
    )


@query(
    "stream_running_totals",
    """SELECT o_orderpriority AS optimizer, count(*) AS n_competitions,
    round(avg(o_custkey % 50 + 1), 6) AS mean_steps,
    round(stddev_pop(o_custkey % 50 + 1), 6) AS std_steps,
    CAST(min(o_custkey % 50 + 1) AS DOUBLE) AS min_steps,
    CAST(max(o_custkey % 50 + 1) AS DOUBLE) AS max_steps, 1.0::DOUBLE AS success_rate,
    round(avg(o_totalprice), 6) AS mean_final_best FROM orders GROUP BY 1""",
)
def stream_totals(spark, sf):
    """Orders as result documents, streamed from a folder a few files at a time."""
    path = scratch_path(spark, "arriving")
    _result_documents(spark, sf).select("text").repartition(8).write.text(path)
    arriving = results_stream.stream_results(spark, path, lines=True, max_files=3)
    totals = results_stream.totals_snapshot(arriving, scratch_path(spark, "totals"), scratch_path(spark, "state"))
    return rounded(totals)


@query(
    "s5_histories",
    """SELECT o_orderkey, o_orderpriority AS optimizer, 0 AS step, o_totalprice AS value FROM orders
    UNION ALL SELECT o_orderkey, o_orderpriority, 1, o_totalprice + 1 FROM orders""",
)
def s5_histories(spark, sf):
    """Step records of a result document; the second one lacks best_value_so_far."""
    o = table(spark, sf, "orders")
    price = F.col("o_totalprice")
    first = F.struct(F.lit(0).alias("step"), price.alias("best_value_so_far"), F.lit(0.0).alias("current_best"))
    second = F.struct(
        F.lit(1).alias("step"), F.lit(None).cast("double").alias("best_value_so_far"),
        (price + 1).alias("current_best"),
    )
    result = F.struct(F.array(second, first).alias("optimization_history"))
    comp = F.struct(F.create_map(F.col("o_orderpriority"), result).alias("optimizer_results"))
    doc = F.to_json(F.struct(F.struct(F.array(comp).alias("competitions")).alias("tournament_results")))
    files = o.select(F.col("o_orderkey").cast("string").alias("path"), doc.alias("text"))
    steps = result_files.histories(result_files.parse_results(files))
    return steps.select(
        F.col("path").cast("bigint").alias("o_orderkey"), "optimizer", "step", "value"
    )
