"""Text expressions for extracted tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Temperature with an optional error before the degree sign.
TM_PATTERN = (
    r"(?U)([0-9]+(?:\.[0-9]+)?(?:[\s\x1c-\x1f]*(?:±|\+/-)[\s\x1c-\x1f]*[0-9]+(?:\.[0-9]+)?)?)"
    r"[\s\x1c-\x1f]*°C"
)

# Line ends and blanks as Python sees them.
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
_BLANK = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.regexp_replace(c, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def lines(c: Column) -> Column:
    return F.split(c, _BREAK)


def extract_tm(c: Column) -> Column:
    """First melting temperature in a text, null when there is none."""
    return F.nullif(F.regexp_extract(c, TM_PATTERN, 1), F.lit(""))


def truncate(c: Column, n: int) -> Column:
    """First ``n`` characters."""
    return F.substring(c, 1, n)


def choose_variant(flag: Column, variant: Column, revision: Column) -> Column:
    """Reviewed name of a variant, null when the row is to be dropped.

    A flag that contains ``correct`` keeps the original, so ``incorrect`` does too.
    """
    mark = F.lower(strip(flag))
    return F.when(mark.contains("correct"), strip(variant)).when(
        mark.contains("revised") | mark.contains("added"), strip(revision)
    )


def parse_variants(answer: Column) -> Column:
    """Variant names in an answer: JSON object, JSON array, else one per line.

    Names are trimmed, empty ones dropped and repeats removed in first-seen order.
    """
    text = strip(answer)
    braces = text.startswith("{") & text.endswith("}")
    brackets = text.startswith("[") & text.endswith("]")
    listed = F.coalesce(
        F.when(braces, F.from_json(text, "struct<variants:array<string>>")["variants"]),
        F.when(brackets, F.from_json(text, "array<string>")),
    )
    named = F.transform(listed, lambda v: strip(F.coalesce(v, F.lit("None"))))
    bullets = F.transform(lines(answer), lambda v: strip(F.btrim(v, F.lit("•- \t"))))
    found = F.coalesce(named, bullets)
    return F.array_distinct(F.filter(found, lambda v: v != ""))


def parse_verdict(answer: Column) -> Column:
    """Struct of nullable booleans read by key; an unreadable answer makes all false."""
    raw = F.from_json(
        answer,
        "struct<buffer:boolean,pH:boolean,concentration:boolean,broken:string>",
        {"columnNameOfCorruptRecord": "broken"},
    )
    failed = raw.isNull() | raw["broken"].isNotNull()
    return F.struct(
        *[
            F.when(failed, F.lit(False)).otherwise(raw[key]).alias(name)
            for key, name in (("buffer", "buffer_ok"), ("pH", "pH_ok"), ("concentration", "conc_ok"))
        ]
    )


# Flag columns and the field names they report.
FLAG_FIELDS = {"buffer_ok": "Buffer", "pH_ok": "pH", "conc_ok": "Protein concentration"}


def inconsistent_fields(fields: dict[str, str] = FLAG_FIELDS) -> Column:
    """Names of the fields whose flag is false or null."""
    return F.concat_ws(
        "; ",
        *[
            F.when(~F.coalesce(F.col(flag), F.lit(False)), F.lit(name))
            for flag, name in fields.items()
        ],
    )
