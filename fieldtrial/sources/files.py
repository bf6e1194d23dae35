"""File listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip


def list_files(spark: SparkSession, path: str, pattern: str = "*.*") -> DataFrame:
    """Paths and sizes of the files of a folder; no content is read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", "length", "modificationTime")
    )


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def group_key(path: Column) -> Column:
    """Part of the file name before the first ``-``, and of that before the first ``_``."""
    return strip(F.split(F.split(base_name(path), "-")[0], "_")[0])


def group_files(df: DataFrame, path_col: str) -> DataFrame:
    """Each file with the key of its group."""
    return df.withColumn("key", group_key(F.col(path_col))).withColumn(
        "file_name", base_name(F.col(path_col))
    )
