"""The registered queries: each operator over its whole table."""

from __future__ import annotations

from ..session import scratch_path
from . import license_queries, negative_queries, trie_queries  # noqa: F401  (they register their queries)
from .chat import chat_format
from .common import read_table
from .decontaminate import contaminated
from .html_extract import extract_pages
from .jaccard_join import similar_documents
from .line_dedup import line_dedup
from .packing import pack_documents
from .pii import personal_data, summary
from .quality_rules import RULES, STOP_WORDS, quality_rules
from .registry import QUERIES, SQL, query
from .token_output import segments, write_packed
from .toxicity import toxicity

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _bound(measure: str, name: str) -> str:
    rule = next(r for r in RULES if r.name == name)
    tests = [f"{measure} < {rule.low}"] if rule.low is not None else []
    tests += [f"{measure} > {rule.high}"] if rule.high is not None else []
    return " OR ".join(tests)


# Words and lines are counted by unnesting; the windows are compared as texts, not as hashes.
OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), ws AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), seq AS (
  SELECT doc_id, i, word, lag(word) OVER v AS before,
    CASE WHEN lead(word, 4) OVER v IS NOT NULL THEN concat_ws(' ', word, lead(word, 1) OVER v,
      lead(word, 2) OVER v, lead(word, 3) OVER v, lead(word, 4) OVER v) END AS g
  FROM ws WINDOW v AS (PARTITION BY doc_id ORDER BY i)
), hit AS (
  SELECT doc_id, i, word, before, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS twice
  FROM seq
), cover AS (
  SELECT doc_id, word, before,
    max(CAST(twice AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS 4 PRECEDING) AS covered,
    regexp_replace(lower(word), '^[.,;:!?]+|[.,;:!?]+$', '', 'g') IN ({_STOPS}) AS is_stop
  FROM hit
), per AS (
  SELECT doc_id, sum(covered) AS n_repeat_words, sum(CAST(word = before AS INTEGER)) AS stutters,
    sum(CAST(is_stop AS INTEGER)) AS stops
  FROM cover GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    length(t) - length(replace(t, '!', '')) AS marks,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(\||\.\.\.|…)\s*$'))) AS open_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(stutters, 0) AS stutters,
    coalesce(stops, 0) AS stops
  FROM d LEFT JOIN per USING (doc_id)
), r AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    greatest(n_words, 1)::DOUBLE AS nw, greatest(n_lines, 1)::DOUBLE AS nl
  FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
  n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR {_bound("word_chars / nw", "word_length")} OR {_bound("n_symbols / nw", "symbols")}
    OR {_bound("marks / nw", "exclamations")} OR {_bound("stops / nw", "stop_words")}
    OR {_bound("stutters / nw", "stutter")} OR {_bound("n_dup_lines / nl", "equal_lines")}
    OR {_bound("open_lines / nl", "open_lines")}) AS kept
FROM r
"""


@query("op2_quality_rules", OP2_SQL)
def op2_quality_rules(spark, sf_dir):
    """Counts and the verdict of the quality rules for every document."""
    rated = quality_rules(read_table(spark, sf_dir, "documents"))
    return rated.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


# The prefixes are compared as whole texts.
OP7_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
    '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS body
  FROM conversations
), p AS (
  SELECT conv_id, place, string_agg(body, '') OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM t
), whole AS (
  SELECT conv_id, max(place) AS n_turns, arg_max(upto, place) AS text FROM p GROUP BY conv_id
), classes AS (
  SELECT n_turns, text, min(conv_id) AS conv_id, count(*) AS n_copies FROM whole GROUP BY n_turns, text
), inner_keys AS (
  SELECT DISTINCT p.place, p.upto FROM p JOIN whole w ON p.conv_id = w.conv_id AND p.place < w.n_turns
)
SELECT c.conv_id, c.n_turns::BIGINT AS n_turns, c.n_copies::BIGINT AS n_copies, c.text
FROM classes c ANTI JOIN inner_keys k ON c.n_turns = k.place AND c.text = k.upto
"""


@query("op7_chat_format", OP7_SQL)
def op7_chat_format(spark, sf_dir):
    """Every maximal conversation, rendered."""
    return chat_format(read_table(spark, sf_dir, "conversations"))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark, sf_dir):
    """Every piece of every document with its sequence and place."""
    return pack_documents(read_table(spark, sf_dir, "documents"))


@query("op5_token_output")
def op5_token_output(spark, sf_dir):
    """Every segment of the packed matrices, as written and read back."""
    blocks = write_packed(read_table(spark, sf_dir, "documents"), scratch_path(spark, "packed"))
    return segments(blocks)


@query("op6_html_extraction")
def op6_html_extraction(spark, sf_dir):
    """The main text of every page."""
    return extract_pages(read_table(spark, sf_dir, "pages"))


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    """The toxicity of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op8_pii")
def op8_pii(spark, sf_dir):
    """Counts and digests of the personal data in every document."""
    return summary(personal_data(read_table(spark, sf_dir, "documents")))


# Every shingle of every document against every shingle of every item, as texts.
OP10_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') AS w FROM documents
), iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') AS w FROM benchmark
), sized AS (
  SELECT item_id, w, least(len(w), 5) AS width FROM iw WHERE len(w) > 0
), item AS (
  SELECT DISTINCT item_id, width, unnest(list_transform(range(1, len(w) - width + 2),
    lambda i: array_to_string(w[i:i + width - 1], ' '))) AS s FROM sized
), size AS (SELECT item_id, count(*) AS n FROM item GROUP BY item_id),
widths AS (SELECT DISTINCT width FROM item),
doc AS (
  SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, len(w) - width + 2),
    lambda i: array_to_string(w[i:i + width - 1], ' '))) AS s FROM dw, widths WHERE len(w) >= width
), met AS (
  SELECT doc_id, item_id, count(*) AS n_found FROM doc JOIN item USING (width, s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n AS n_shingles, n_found FROM met JOIN size USING (item_id)
WHERE 100 * n_found >= 80 * n
"""


@query("op10_decontamination", OP10_SQL)
def op10_decontamination(spark, sf_dir):
    """Every document with the benchmark items it contains."""
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return contaminated(docs, items).drop("text_hash")


@query("op3_line_dedup")
def op3_line_dedup(spark, sf_dir):
    """Every document with what line dedup leaves of its text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs)


# The sets as texts, the links by counting common shingles, the components by recursion.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (s)
  WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * c >= 90 * (a.n + b.n - c)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN link l ON r.other = l.x
)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


@query("op1_ngram_jaccard_join", OP1_SQL)
def op1_ngram_jaccard_join(spark, sf_dir):
    """Every document with the component of its near copies."""
    found = similar_documents(read_table(spark, sf_dir, "documents"), width=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")
