"""Personal data: exact patterns, and candidate spans selected by boosted trees.

The base patterns always count. Around them generators propose further, overlapping spans (parts of
runs that the base rejects as a whole, other spellings). A proposal is right where it equals a base
span or bears its own evidence; one that only overlaps a base span teaches nothing. Boosted trees
rate them by format and context, and a threshold per generator, calibrated on proposals the trees
have not seen, selects. All of it are column functions and MLlib.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base. Possessive quantifiers and the tests before a run match the same spans
# as plain ones, but in linear time and without recursion.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Proposals: parts of longer runs and other spellings. Each finds what stands alone.
CANDIDATES = (
    ("email", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+(?:(?:\.| \. | ?(?:\(dot\)|\[dot\]|\{dot\}) ?)[A-Za-z0-9-]{1,63}+){1,4}"),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.]*[0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{16,19}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
)
FEATURES = (
    "is_email", "is_ip", "is_card", "is_phone", "n_chars", "n_digits", "n_separators", "n_dots", "n_at",
    "has_plus", "has_parenthesis", "luhn", "octets", "after_letter", "before_letter", "after_space",
    "keyword", "evidence",
)
# Trees learn from at most this many different proposals, chosen by a hash.
MAX_SAMPLE = 20_000
PRECISION = 0.98
CONTEXT = 24
_KEYWORDS = r"(?i)(mail|phone|tel|call|fax|mobile|card|visa|credit|ip|address|host|contact)\W*$"


def find(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches: array of (start, end, match) in code points."""
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(gaps.alias("gap"), matches.alias("match"))
    typed = "array<struct<start:int,end:int,match:string>>"
    none = F.struct(F.lit(0).alias("at"), F.array().cast(typed).alias("found"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["match"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match")))
        return F.struct(end.alias("at"), F.concat(acc["found"], span.cast(typed)).alias("found"))

    zipped = F.filter(pairs, lambda p: p["match"].isNotNull())
    return F.aggregate(zipped, none, step)["found"]


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def value(n: Column, i: Column) -> Column:
        digit = F.substring(n, -i, F.lit(1)).try_cast("int")
        twice = digit * 2
        doubled = F.when(twice > 9, twice - 9).otherwise(twice)
        return F.when(i % 2 == 0, doubled).otherwise(digit)

    total = let(
        number,
        lambda n: F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.char_length(n), F.lit(1))),
            F.lit(0),
            lambda acc, i: acc + F.coalesce(value(n, i), F.lit(0)),
        ),
    )
    return total % 10 == 0


def octets(match: Column) -> Column:
    """Whether all parts between dots are at most 255."""
    return F.rlike(match, F.lit(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"))


def valid(kind: str, match: Column) -> Column:
    n = F.char_length(digits(match))
    return {
        "email": F.lit(True),
        "ip": octets(match),
        "card": F.when(n.between(16, 19), luhn(digits(match))).otherwise(F.lit(False)),
        "phone": n.between(8, 15),
    }[kind]


def evidence(kind: Column, match: Column, keyword: Column) -> Column:
    """Whether a proposal (``kind`` by its place in KINDS) speaks for itself, whatever the base says."""
    plus = F.startswith(match, F.lit("+"))
    grouped = F.rlike(match, F.lit(r"^\([0-9]{3}\)"))
    whole = F.contains(match, F.lit("(")) == F.contains(match, F.lit(")"))
    joined = F.rlike(match, F.lit(r"[.-][0-9]{4}$"))
    national = F.rlike(match, F.lit(r"^\(?[2-9]")) & (grouped | joined | keyword)
    phone = whole & valid("phone", match) & F.when(plus, F.rlike(match, F.lit(r"^\+[1-9]"))).otherwise(national)
    each = {
        "email": F.rlike(match, F.lit(r"^[A-Za-z0-9].*[^A-Za-z0-9-][A-Za-z]{2,24}$")),
        "ip": valid("ip", match),
        "card": valid("card", match) & F.rlike(match, F.lit("^[2-6]")),
        "phone": phone,
    }
    out = F.lit(False)
    for k, name in enumerate(KINDS):
        out = F.when(kind == k, each[name]).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _is_valid(kind: str):
    return lambda s: valid(kind, s["match"])


def _labelled(kind: str, spans: Column) -> Column:
    """Spans as (kind, start, end, match), ``kind`` by its place in KINDS."""
    at = F.lit(KINDS.index(kind))
    return F.transform(
        spans,
        lambda s: F.struct(at.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")),
    )


_SPANS = "array<struct<kind:int,start:int,end:int,match:string>>"


def base_spans(text: Column) -> Column:
    """All base spans of a text, by kind and start."""
    each = [
        F.when(
            F.contains(text, F.lit("@")) if kind == "email" else F.rlike(text, F.lit("[0-9]")),
            _labelled(kind, F.filter(find(text, p), _is_valid(kind))),
        ).otherwise(F.array().cast(_SPANS))
        for kind, p in BASE.items()
    ]
    return F.concat(*each)


def proposals(text: Column) -> Column:
    """What the generators propose, each with its generator; spans may overlap and occur twice."""

    def made(g: int, kind: str, pattern: str) -> Column:
        spans = _labelled(kind, find(text, pattern))
        return F.transform(spans, lambda s: s.withField("generator", F.lit(g)))

    return F.concat(*[made(g, *c) for g, c in enumerate(CANDIDATES)])


def digest(spans: Column) -> Column:
    """kind:start:end of spans in their order, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def with_features(rows: DataFrame) -> DataFrame:
    """Format and context of proposals (kind, match, before, after) as numbers."""
    match = F.col("match")
    own = digits(match)
    made = {
        "n_chars": F.char_length(match),
        "n_digits": F.char_length(own),
        "n_separators": F.char_length(match) - F.char_length(F.translate(match, " -.()", "")),
        "n_dots": F.char_length(match) - F.char_length(F.translate(match, ".", "")),
        "n_at": F.char_length(match) - F.char_length(F.translate(match, "@", "")),
        "has_plus": F.contains(match, F.lit("+")),
        "has_parenthesis": F.contains(match, F.lit("(")),
        "luhn": luhn(own) & F.char_length(own).between(16, 19),
        "octets": octets(match),
        "after_letter": F.rlike("before", F.lit(r"\p{L}$")),
        "before_letter": F.rlike("after", F.lit(r"^\p{L}")),
        "after_space": F.rlike("before", F.lit(r"(^|\s)$")),
        "keyword": F.rlike("before", F.lit(_KEYWORDS)),
    }
    made["evidence"] = evidence(F.col("kind"), match, made["keyword"])
    made |= {f"is_{k}": F.col("kind") == F.lit(i) for i, k in enumerate(KINDS)}
    return rows.withColumns({k: v.cast("double") for k, v in made.items()})


def _threshold(counts: list) -> dict[int, float]:
    """Per generator the rating from which on its unseen proposals (generator, step, n, right) are precise.

    It is at least a half, and above the highest step where the precision falls short.
    """
    out = {g: 0.5 for g in range(len(CANDIDATES))}
    for g in out:
        n, right = 0, 0.0
        for row in sorted((r for r in counts if r["generator"] == g), key=lambda r: -r["step"]):
            n, right = n + row["n"], right + row["right"]
            if right < PRECISION * n:
                out[g] = max(0.5, (row["step"] + 1) / 100)
                break
    return out


def _rated(rows: DataFrame, max_sample: int, scratch: Scratch) -> DataFrame:
    """The proposals that the base has not, with a rating over the threshold of their generator."""
    featured = with_features(rows).withColumn("label", F.greatest("equal", "evidence"))
    featured = scratch.write(featured, "features")
    new = featured.where("equal = 0 and not met")
    # What overlaps a base span without equalling it is neither right nor wrong. Copies count once,
    # and stay on one side.
    own = ("generator", "match", "before", "after")
    known = featured.where("equal = 1 or not met").select(*own, "label", *FEATURES).distinct()
    known = scratch.write(
        known.withColumn("part", F.pmod(F.xxhash64(F.lit(3), *own), F.lit(4))).withColumn("place", F.xxhash64(*own)),
        "known",
    )
    seen = known.where("part > 0").orderBy("place", *own, "label").limit(max_sample)
    seen = scratch.write(seen, "sample")
    last = seen.agg(F.max("place")).first()[0]
    # The trees have not seen a quarter of all, nor what the sample has no room for.
    unseen = known.where((F.col("part") == 0) | (F.col("place") > F.lit(last)))
    classes = {r["label"] for r in seen.select("label").distinct().collect()}
    if classes != {0.0, 1.0}:  # nothing to tell apart: the evidence alone decides
        return new.where("label = 1").withColumn("rating", F.col("label"))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x")
    trees = GBTClassifier(featuresCol="x", labelCol="label", maxIter=8, maxDepth=4, seed=1)
    model = trees.fit(vectors.transform(seen).select("x", "label").coalesce(4))

    def rate(df: DataFrame) -> DataFrame:
        out = model.transform(vectors.transform(df))
        return out.withColumn("rating", vector_to_array("probability")[1])

    steps = rate(unseen).groupBy("generator", F.floor(F.col("rating") * 100).cast("int").alias("step"))
    # 101 rows per generator at most.
    counts = steps.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("right")).collect()
    least = F.array(*[F.lit(t) for t in _threshold(counts).values()])
    return rate(new).where(F.col("rating") >= F.get(least, F.col("generator")))


def personal_data(docs: DataFrame, max_sample: int = MAX_SAMPLE, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, text_hash, base and added: the spans of every row of ``docs`` (doc_id, text).

    ``base`` holds the base spans, ``added`` those that the trees select; a span has kind (place in
    KINDS), start, end (code points, end exclusive) and match. Added spans overlap no base span and
    not each other. A null text is empty and has no spans; equal rows stay and get equal spans;
    other columns are ignored. Where no proposal is right or none wrong, the evidence alone selects.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    may = F.rlike(text, F.lit("[0-9@]|[(\\[{]at[)\\]}]"))
    own = docs.select(
        F.col("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.when(may, text).alias("_text"),
    )
    none = F.array().cast(_SPANS)
    rows = scratch.write(
        own.withColumn("base", F.coalesce(F.when(F.col("_text").isNotNull(), base_spans(F.col("_text"))), none))
        .withColumn("proposed", F.when(F.col("_text").isNotNull(), proposals(F.col("_text"))))
        .withColumn(
            "proposed",
            F.transform(
                "proposed",
                lambda s: F.struct(
                    s["generator"].alias("generator"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"),
                    F.substring(F.col("_text"), F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT))).alias("before"),
                    F.substring(F.col("_text"), s["end"] + 1, F.lit(CONTEXT)).alias("after"),
                    F.exists("base", lambda b: (b["kind"] == s["kind"]) & (b["start"] == s["start"]) & (b["end"] == s["end"])).cast("double").alias("equal"),
                    F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])).alias("met"),
                ),
            ),
        )
        .drop("_text"),
        "spans",
    )
    each = rows.where(F.size("proposed") > 0).select("doc_id", "text_hash", F.explode("proposed").alias("s"))
    rated = _rated(each.distinct().select("doc_id", "text_hash", "s.*"), max_sample, scratch)
    chosen = rated.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.sort_array(F.collect_list(F.struct(-F.col("rating"), "kind", "start", "end", "match"))).alias("all")
    )
    # The best rated first; a span that meets a chosen one is left out.
    picked = F.aggregate(
        "all",
        none,
        lambda acc, s: F.when(
            F.exists(acc, lambda a: (a["start"] < s["end"]) & (a["end"] > s["start"])), acc
        ).otherwise(
            F.concat(acc, F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"))))
        ),
    )
    added = chosen.select("_id", "_hash", F.sort_array(picked).alias("added"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return rows.join(added, same, "left").select(
        "doc_id", "text_hash", "base", F.coalesce("added", none).alias("added")
    )


def summary(found: DataFrame) -> DataFrame:
    """Counts by kind and the digests of the base spans and of all spans."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(digest(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        digest(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by <kind>; of overlapping spans the first counts."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        ordered,
        none,
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"])).alias("out"),
            )
        ),
    )
    return let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.char_length(text))))
