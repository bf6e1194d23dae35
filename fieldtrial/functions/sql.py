"""Operators as functions of SQL: they are called from ``spark.sql`` with ``LATERAL``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import _BLANK, _BREAK

_STRIP = rf"(?U)^{_BLANK}+|{_BLANK}+$"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, r'{_STRIP}', '')"


def register_functions(spark: SparkSession) -> None:
    """Make ``paper_variants(answer)`` known to this session.

    It returns the variant names in an answer, one row each, by (ordinal, variant) and by the rules of
    ``text.parse_variants``: a JSON object or array, else one name per line; trimmed, without empty and
    repeated ones. A null answer has no rows. The body is SQL, so no Python runs on the executors.
    """
    named = f"transform(listed, v -> {_strip("coalesce(v, 'None')")})"
    by_line = f"transform(split(answer, r'{_BREAK}'), v -> {_strip("btrim(v, '•- \t')")})"
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION paper_variants(answer STRING)
        RETURNS TABLE(ordinal INT, variant STRING)
        RETURN SELECT CAST(pos + 1 AS INT) AS ordinal, name AS variant FROM (
          SELECT array_distinct(filter(coalesce({named}, {by_line}), v -> v <> '')) AS names FROM (
            SELECT answer, coalesce(
              CASE WHEN startswith(body, '{{') AND endswith(body, '}}')
                THEN from_json(body, 'variants array<string>').variants END,
              CASE WHEN startswith(body, '[') AND endswith(body, ']') THEN from_json(body, 'array<string>') END
            ) AS listed FROM (SELECT answer, {_strip("answer")} AS body)))
        LATERAL VIEW posexplode(names) AS pos, name"""
    )
