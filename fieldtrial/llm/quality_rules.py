"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACES, let, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"

# Common function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    sorted(
        set(
            "the of and to in is that it for was on are as with be at by this from or an a "
            "der die und den das von zu mit sich des auf im ist nicht ein eine dem es "
            "le la les de et en un une est que dans qui pour du sur au avec par "
            "el los las y del se por con no su para al lo como".split()
        )
    )
)


class Rule(NamedTuple):
    """A text fails when ``measure`` lies outside [``low``, ``high``]; None is no bound."""

    name: str
    measure: str
    low: float | None
    high: float | None


# The measures are columns of ``measures``; ratios of texts without words or lines count as 0.
RULES = (
    Rule("length", "n_words", 10, None),
    Rule("repeats", "repeat_ratio", None, 0.2),
    Rule("word_length", "mean_word_chars", 2, 12),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("exclamations", "exclamation_ratio", None, 0.2),
    Rule("stop_words", "stop_ratio", 0.06, None),
    Rule("stutter", "stutter_ratio", None, 0.3),
    Rule("equal_lines", "dup_line_ratio", None, 0.4),
    Rule("open_lines", "open_line_ratio", None, 0.5),
)
# The rules that make up ``base_failed``.
BASE_RULES = ("length", "repeats")


def repeated_words(tokens: Column) -> Column:
    """How many words lie in a window of five words that occurs twice or more.

    Equal windows have equal hashes. Only a text that repeats a window sorts its windows; the
    words covered are the union of [p, p + 5) over the starts p of repeated windows.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(
            pairs,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        s,
                        lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        none = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
        return F.aggregate(
            starts,
            none,
            lambda acc, p: F.struct(
                p.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["at"])).alias("n")
            ),
        )["n"]

    def windows(single: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(single) - WINDOW),
            lambda i: F.xxhash64(*[F.get(single, i + k) for k in range(WINDOW)]),
        )

    counted = let(
        F.transform(tokens, lambda w: F.xxhash64(w)),
        lambda single: let(
            windows(single),
            lambda hashes: F.when(
                F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)
            ).otherwise(covered(hashes)),
        ),
    )
    return F.when(F.size(tokens) < WINDOW, F.lit(0)).otherwise(counted)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` (but for clashing names) with the counts and ratios of the rules.

    A null or empty text has no words and no lines: counts and ratios 0.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    made = docs.withColumn("_words", words(own)).withColumn(
        "_lines", F.filter(F.split(own, "\n", -1), lambda x: F.rlike(x, F.lit(NOT_SPACE)))
    )
    marks = F.lit(".,;:!?")
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.char_length(F.regexp_replace(own, SPACES, "")),
        "n_symbols": F.char_length(own) - F.char_length(F.translate(own, SYMBOLS, "")),
        "n_exclamations": F.char_length(own) - F.char_length(F.translate(own, "!", "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_open_lines": F.size(F.filter("_lines", lambda x: F.rlike(x, F.lit(r"(\||\.\.\.|…)\s*$")))),
        "n_stop_words": F.size(
            F.filter("_words", lambda w: F.lower(F.trim(w, marks)).isin(*STOP_WORDS))
        ),
        "n_stutters": let(
            F.col("_words"),
            lambda w: F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))),
        ),
        "n_repeat_words": repeated_words(F.col("_words")),
    }
    made = made.withColumns({k: v.cast("long") for k, v in counts.items()})

    def ratio(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    return made.withColumns(
        {
            "repeat_ratio": ratio("n_repeat_words", "n_words"),
            "mean_word_chars": ratio("word_chars", "n_words"),
            "symbol_ratio": ratio("n_symbols", "n_words"),
            "exclamation_ratio": ratio("n_exclamations", "n_words"),
            "stop_ratio": ratio("n_stop_words", "n_words"),
            "stutter_ratio": ratio("n_stutters", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "open_line_ratio": ratio("n_open_lines", "n_lines"),
        }
    ).drop("_words", "_lines")


def failure(rule: Rule) -> Column:
    """Whether a row breaks one rule."""
    value = F.col(rule.measure)
    bounds = [value < rule.low] if rule.low is not None else []
    bounds += [value > rule.high] if rule.high is not None else []
    return reduce(Column.__or__, bounds, F.lit(False))


def quality_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[str, ...] = BASE_RULES
) -> DataFrame:
    """The measured rows with ``base_failed``, ``failed_rules`` (names) and ``kept``.

    Ratios are compared as doubles, but the base's repeat rule is compared in whole numbers.
    """
    exact = {"repeats": F.col("n_repeat_words") * 100 > F.col("n_words") * 20}
    broken = {r.name: exact.get(r.name, failure(r)) if r in RULES else failure(r) for r in rules}
    failed = F.array_compact(
        F.array(*[F.when(test, F.lit(name)) for name, test in broken.items()], F.lit(None).cast("string"))
    )
    in_base = reduce(Column.__or__, [broken[n] for n in base if n in broken], F.lit(False))
    return measures(docs).withColumns(
        {"base_failed": in_base, "failed_rules": failed, "kept": F.size(failed) == 0}
    )
