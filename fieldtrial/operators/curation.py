"""Preparing and checking tables extracted from papers.

The pipeline stops at the service that answers questions: request tables go out, answer tables
come back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import join_small
from .exact import blocked_row_number, running

# Columns of the extraction table.
PAPER_COLUMNS = (
    "Author/Year of Publication", "Paper Title", "Species Origin", "Production Organism",
)
VARIANT_COLUMN = "TM Variant"
DEPENDENT_COLUMNS = (
    "Growth Factor", "Amino Acid Sequence", "Methods",
    "Experimental Conditions/Methods Description", "pH", "Buffer", "Protein concentration", "Tm",
)
ENGINEERED_COLUMN = "Engineered variant?"
FILE_COLUMN = "PDF File Name"

# Question texts; {column} and {variant} are filled in.
_PLAIN = "Extract the {column} related to this paper. Provide only the {column} as plain text."
_ORGANISM = (
    "extract the production organism. Do not provide any extra information. "
    "e.g. “E.coli”, “Escherichia coli”, “P. pastoris”, “Pichia pastoris”, "
    "“S. cerevisiae”, “Saccharomyces cerevisiae”, “T. reesei”, “Trichoderma reesei”, "
    "“A. niger”, “Aspergillus niger”, “N. crassa”, “Neurospora crassa”, "
    "“bacteria”, “filamentous fungi”, “yeast”. At the end, tell where you got your information"
)
_FACTOR = (
    "For variant “{variant}”, extract only the “{column}”. Provide only the “{column}” as one or "
    "two words. Possible choices: EGF, HGF, IGF-1, IGF-1-LR3, Insulin, Transferrin, Albumin, Shh, "
    "Wnt3A, BMP-4, FGF-2, IGF-2, IL4, IL6, TGFB1, TGFB2, TGFB3, FGF-6, Activin A, BMP-1, BMP-2, "
    "BMP-9, FGF-1, FGF-4, FGF2-STAB, FGF21, HGF NK1, PDGF-AA, PDGF-BB, TGFa, VEGF-A. Do not "
    "provide any extra information."
)
_SEQUENCE = (
    'I am interested in the variant "{variant}".\nPlease do the following:\n'
    "1. Extract the UniProt accession ID of the wild-type protein (e.g. P12345).\n"
    "2. List all mutations for this variant, giving the one-letter code change plus residue "
    "number, and—if mentioned—a brief location note.\n\n"
    "Output **only** plain text in this exact format:\nUniProt ID: <ID or “not found”>\n"
    "Mutations:\n- <Mutation1> (<location note if any>)\n- <Mutation2> (<location note if any>)\n\n"
    "Variant context: {variant}\n"
)
_METHODS = (
    "Extract the {column}. Provide only the name of the method used for measuring thermal "
    "stability of the variant “{variant}” as plain text. e.g. “Differential Scanning Calorimetry "
    "(DSC)”; “Circular Dichroism (CD)”."
)
_DEPENDENT = (
    "For variant “{variant}”, extract only the {column}. Do not provide any extra information. "
    "At the end, tell where you got your information"
)
_ENGINEERED = "For variant “{variant}”, is it engineered? Answer Yes or No."
TEMPLATES = {
    "Author/Year of Publication": _PLAIN,
    "Paper Title": _PLAIN,
    "Species Origin": _PLAIN + " Cite section or figure.",
    "Production Organism": _ORGANISM,
    **{c: _DEPENDENT for c in DEPENDENT_COLUMNS},
    "Growth Factor": _FACTOR,
    "Amino Acid Sequence": _SEQUENCE,
    "Methods": _METHODS,
    ENGINEERED_COLUMN: _ENGINEERED,
}

# Text of a consistency request.
JUDGE_TEMPLATE = """We have one paper’s data in four columns:
1) Experimental Conditions/Methods Description (a free-text blob),
2) Buffer,
3) pH,
4) Protein concentration.

For **each** of the three structured values (Buffer, pH, Protein concentration):
- If the free-text **mentions** that exact value, respond whether it’s **correct** (YES) or **incorrect** (NO).
- If the free-text does **not mention** that value at all, respond **null**.  

Here are the values:

Experimental Conditions/Methods Description:
\"\"\"{description}\"\"\"

Structured values:
- Buffer: "{buffer}"
- pH: "{ph}"
- Protein concentration: "{concentration}"

**Output valid JSON** with exactly these keys mapping to `true` / `false` / `null`:

For each value, answer YES if the description clearly supports it, NO otherwise.
Output valid JSON with keys "buffer", "pH", "concentration" mapping to true/false.
Example:
{"buffer": true, "pH": false, "concentration": null}"""
JUDGE_CHARS = 2000
CONTEXT_CHARS = 200_000

# The role text that goes with a consistency request.
JUDGE_SYSTEM = (
    "You are an expert data auditor. "
    "You compare free-text method descriptions against extracted values."
)


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(list(templates.items()), "column string, template string")


def build_prompts(questions: DataFrame, templates: DataFrame) -> DataFrame:
    """Question text for each (key, variant, column) row; ``variant`` may be null."""
    filled = F.replace(F.col("template"), F.lit("{column}"), F.col("column"))
    filled = F.replace(filled, F.lit("{variant}"), F.coalesce("variant", F.lit("")))
    return join_small(questions, templates, "column").withColumn(
        "prompt", filled
    ).drop("template")


def fan_out(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every row once per question column."""
    return rows.withColumn("column", F.explode(F.array(*[F.lit(c) for c in columns])))


def join_variants(papers: DataFrame, variants: DataFrame) -> DataFrame:
    """Papers with their reviewed variants; a paper without any is dropped."""
    return join_small(variants, papers, "key")


def paper_questions(
    papers: DataFrame,
    variants: DataFrame,
    paper_columns: Sequence[str] = PAPER_COLUMNS,
    variant_columns: Sequence[str] = (*DEPENDENT_COLUMNS, ENGINEERED_COLUMN),
) -> DataFrame:
    """One question per paper column, and one per variant and dependent column."""
    whole = fan_out(papers.select("key"), paper_columns).select(
        "key", F.lit(None).cast("string").alias("variant"), "column"
    )
    pairs = join_variants(papers.select("key"), variants.select("key", "variant"))
    each = fan_out(pairs, variant_columns)
    return whole.unionByName(each.select("key", "variant", "column"))


def assemble_answers(
    answers: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("key", "variant")
) -> DataFrame:
    """One wide row per key and variant from long (column, answer) rows."""
    return answers.groupBy(*keys).pivot("column", list(columns)).agg(F.min("answer"))


def combine_texts(
    files: DataFrame,
    key: str,
    order: str,
    text: str,
    name: str,
    chunk_chars: int | None = None,
    block_size: int = 100_000,
) -> DataFrame:
    """Texts of a key joined in file order, a line break after each, and the file names.

    Without ``chunk_chars`` a key has one row, chunk 0. With it the text is cut into rows of about
    that many characters, at the end of a file. ``order`` is an integer; files with the same one
    follow by name. A key with nothing but white space is dropped.
    """
    files = files.select(
        F.col(key).alias("key"),
        F.col(order).alias("_o"),
        F.coalesce(F.col(text), F.lit("")).alias("_t"),
        F.col(name).alias("_f"),
    )
    if chunk_chars is None:
        listed = F.array_sort(F.collect_list(F.struct("_o", "_f", "_t")))
        whole = files.groupBy("key").agg(listed.alias("_p"), F.max(_filled("_t")).alias("_some"))
        return whole.where("_some").select(
            "key",
            F.lit(0).alias("chunk"),
            F.concat(F.array_join(F.col("_p._t"), "\n"), F.lit("\n")).alias("text"),
            F.array_join(F.col("_p._f"), "; ").alias("file_names"),
        )
    tied = F.array_sort(F.collect_list(F.struct("_f", "_t")))
    sized = (
        files.groupBy("key", "_o")
        .agg(tied.alias("_p"))
        .select(
            "key", "_o", F.array_join("_p._t", "\n").alias("_t"), F.array_join("_p._f", "; ").alias("_f")
        )
    )
    # The running size needs no texts, so only lengths are sorted.
    lengths = sized.select("key", "_o", (F.length("_t") + 1).alias("_len"), _filled("_t"))
    placed = running(lengths, ["key"], "_o", {"_upto": ("sum", "_len")}, block_size)
    chunk = F.floor((F.col("_upto") - F.col("_len")) / chunk_chars).cast("int")
    some = lengths.groupBy("key").agg(F.max("_filled").alias("_some")).where("_some").select("key")
    at = placed.select("key", "_o", chunk.alias("chunk")).join(some, "key", "left_semi")
    parts = F.array_sort(F.collect_list(F.struct("_o", "_t", "_f")))
    return (
        sized.join(at, ["key", "_o"])
        .groupBy("key", "chunk")
        .agg(parts.alias("_p"))
        .select(
            "key",
            "chunk",
            F.concat(F.array_join(F.col("_p._t"), "\n"), F.lit("\n")).alias("text"),
            F.array_join(F.col("_p._f"), "; ").alias("file_names"),
        )
    )


def _filled(col: str):
    return (tx.strip(F.col(col)) != "").alias("_filled")


def reviewed_variants(review: DataFrame) -> DataFrame:
    """Rows of a review table that keep a variant, under its reviewed name."""
    chosen = tx.choose_variant(
        F.col("`Correct or not?`"), F.col("TM Variant"), F.col("`Revised or Not.`")
    )
    return review.withColumn("variant", chosen).where(F.col("variant").isNotNull())


def variants_by_key(review: DataFrame, row: str, block_size: int = 100_000) -> DataFrame:
    """Reviewed variants numbered per key in table order, one row each."""
    kept = reviewed_variants(review).select(F.col("Key").alias("key"), row, "variant")
    block = F.floor(F.col(row) / block_size)
    return blocked_row_number(kept, ["key"], block, [row], "position").select(
        "key", "position", "variant"
    )


def tm_mismatches(df: DataFrame, first: str = "TM Variant", second: str = "Tm") -> DataFrame:
    """Rows in which both columns name a temperature and the two differ."""
    return (
        df.withColumn("Tm_extracted", tx.extract_tm(F.col(first)))
        .withColumn("Tm_dep_extracted", tx.extract_tm(F.col(second)))
        .where(
            F.col("Tm_extracted").isNotNull()
            & F.col("Tm_dep_extracted").isNotNull()
            & (F.col("Tm_extracted") != F.col("Tm_dep_extracted"))
        )
    )


def build_judge_request(df: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Consistency request from a description and three extracted values.

    Adds ``system``, the role text, and ``request``. The whole description is sent unless
    ``max_chars`` says how much of it.
    """
    description = F.col("Experimental Conditions/Methods Description")
    filled = {
        "{description}": description if max_chars is None else tx.truncate(description, max_chars),
        "{buffer}": F.col("Buffer"),
        "{ph}": F.col("pH"),
        "{concentration}": F.col("Protein concentration"),
    }
    # Pieces between the marks are joined, so a value that contains a mark is left alone.
    pieces, rest = [], JUDGE_TEMPLATE
    for mark, value in filled.items():
        before, rest = rest.split(mark, 1)
        pieces += [F.lit(before), F.coalesce(value, F.lit(""))]
    request = F.concat(*pieces, F.lit(rest))
    return df.withColumn("system", F.lit(JUDGE_SYSTEM)).withColumn("request", request)


def summarize_flags(df: DataFrame) -> DataFrame:
    """Names of the fields that are not confirmed, and whether there is any."""
    return df.withColumn("inconsistent_fields", tx.inconsistent_fields()).withColumn(
        "any_inconsistent", F.col("inconsistent_fields") != ""
    )
