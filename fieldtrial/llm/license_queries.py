"""The registered query of the license scan."""

from __future__ import annotations

from .common import read_table
from .license_scan import COVER, PHRASES, SLACK, TEMPLATES, license_scan
from .registry import query

_quoted = lambda text: "'" + text.replace("'", "''") + "'"
_templates = ", ".join(f"({i}, {_quoted(label)}, {_quoted(text)})" for i, (label, text) in enumerate(TEMPLATES))
_phrases = ", ".join(f"({_quoted(phrase)}, {_quoted(label)})" for phrase, label in PHRASES)
_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

# Runs are texts; spans are counted over the ranges of diagonals.
OP13_SQL = f"""
WITH template(template, label, text) AS (VALUES {_templates}),
phrase(phrase, label) AS (VALUES {_phrases}),
tw AS (SELECT template, label, {_WORDS} AS w FROM template),
run AS (
  SELECT template, label, len(w) - 2 AS n_runs, i AS t_at, array_to_string(w[i + 1:i + 3], ' ') AS gram
  FROM tw, unnest(range(0, len(w) - 2)) AS u(i)
), dw AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), word AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM dw
), near AS (
  SELECT doc_id, pos, word, lead(word) OVER v AS word_2, lead(word, 2) OVER v AS word_3
  FROM word WINDOW v AS (PARTITION BY doc_id ORDER BY pos)
), vote AS (
  SELECT DISTINCT doc_id, template, label, n_runs, pos - t_at AS diagonal, t_at
  FROM near JOIN run ON gram = concat_ws(' ', word, word_2, word_3) AND word_3 IS NOT NULL
), band AS (
  SELECT doc_id, label, n_runs, count(DISTINCT t_at) OVER (PARTITION BY doc_id, template ORDER BY diagonal
    RANGE BETWEEN CURRENT ROW AND {SLACK} FOLLOWING) AS n_covered
  FROM vote
), found AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(n_covered / n_runs) AS share
  FROM band WHERE 100 * n_covered >= {COVER} * n_runs GROUP BY doc_id
), place AS (
  SELECT doc_id, pos, label FROM near JOIN phrase
    ON phrase = concat_ws(' ', word, word_2) OR phrase = concat_ws(' ', word, word_2, word_3)
), base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels
  FROM (SELECT DISTINCT * FROM place) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
  first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
  greatest(coalesce(share, 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM dw LEFT JOIN base b USING (doc_id) LEFT JOIN found f USING (doc_id)
"""


@query("op13_license_scan", OP13_SQL)
def op13_license_scan(spark, sf_dir):
    """License phrases, labels and score of every document."""
    return license_scan(read_table(spark, sf_dir, "documents"))
