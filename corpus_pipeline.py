"""The corpus pipeline: documents become packed training sequences in five stages.

Every stage is a function of (spark, docs, sf_dir). All but the last return the columns of
``documents``; what a stage returns is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrial.llm.common import Scratch, pack, read_table, unpack
from fieldtrial.llm.decontaminate import decontaminate
from fieldtrial.llm.jaccard_join import one_of_each
from fieldtrial.llm.line_dedup import line_dedup
from fieldtrial.llm.packing import pack_documents
from fieldtrial.llm.toxicity import toxicity

_KEEP = ("doc_id", "text")
_held: list[Scratch] = []


def _tables(spark: SparkSession, docs: DataFrame) -> Scratch:
    """Scratch tables for a stage.

    Those of the stages before are dropped, as their results have been written, unless ``docs``
    still reads them.
    """
    read = docs.inputFiles()
    for old in list(_held):
        if old.spark is not spark:
            _held.remove(old)
        elif not any(path.rsplit("/", 1)[-1] in name for name in read for path in old.paths.values()):
            old.drop()
            _held.remove(old)
    _held.append(Scratch(spark))
    return _held[-1]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject."""
    labels = read_table(spark, sf_dir, "labels")
    scored = toxicity(pack(docs, *_KEEP), labels, scratch=_tables(spark, docs))
    return scored.where("predicted = 0").select(*unpack(scored, docs.columns, *_KEEP))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated line runs; a document with nothing left goes."""
    done = line_dedup(pack(docs, *_KEEP), scratch=_tables(spark, docs)).where("not removed_all")
    columns = dict(zip(docs.columns, unpack(done, docs.columns, *_KEEP)))
    if "n_chars" in columns:
        kind = dict(docs.dtypes)["n_chars"]
        shortened = F.char_length("text").cast(kind)
        columns["n_chars"] = F.when(F.col("n_removed") > 0, shortened).otherwise(columns["n_chars"]).alias("n_chars")
    return done.select(*columns.values())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the smallest doc_id."""
    return one_of_each(docs, scratch=_tables(spark, docs))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"), scratch=_tables(spark, docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    return pack_documents(docs, scratch=_tables(spark, docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack_sequences),
]

# Trained scores and packing plans have no SQL; the tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents under ``sf_dir``."""
    scratch = Scratch(spark)
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
