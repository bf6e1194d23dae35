"""Words, lines and scratch tables shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# The words of a text are the runs of anything but space, tab, LF, VT, FF and CR.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A text with only A-Z lower-cased."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pack(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, and all others in one struct where no name can clash with an operator's."""
    other = [F.col(f"`{c}`") for c in docs.columns if c not in keep]
    row = F.struct(*other) if other else F.lit(None).cast("struct<none:int>")
    return docs.select(*keep, row.alias("_row"))


def unpack(df: DataFrame, columns: list[str], *keep: str) -> list:
    """Column expressions that undo ``pack`` for a table that had ``columns``."""
    return [F.col(c) if c in keep else F.col("_row").getField(c).alias(c) for c in columns]


class Scratch:
    """Tables written to the shared folder during one run, dropped when they are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: computed once, and safe from lost executors."""
        path = scratch_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables by name; all of them without a name."""
        for name in names or list(self.paths):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def size(self, name: str) -> int:
        """The bytes of a table's files."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[name])
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


# Files of at most this size may be broadcast; in memory they take some times as much.
BROADCAST_BYTES = 16 << 20


def join_sized(
    df: DataFrame, side: DataFrame, keys: list[str], how: str, scratch: Scratch, name: str
) -> DataFrame:
    """Join with a written table: broadcast if its files are small, else left to Spark."""
    return df.join(F.broadcast(side) if scratch.size(name) <= BROADCAST_BYTES else side, keys, how)
