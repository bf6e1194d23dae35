"""Session settings, the shared scratch folder and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A side with at most this many rows, in files of at most this size, may be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
# A key with more rows than this is not left to one task.
HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000
# Parts into which the rows of a hot key are dealt where its values are too large to broadcast.
SALTS = 64
# A side that Spark itself rates at no more than this is broadcast without being computed first.
SMALL_BYTES = 256 << 10

_local_dirs: dict[str, str] = {}


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fieldtrial")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; a cluster without the setting
    is an error, because a machine-local folder is lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="fieldtrial-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The table is computed once, survives executor loss and keeps later plans short.
    """
    path = scratch_path(df.sparkSession, name)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    # Rows counted while they were written, so that nobody has to count them again.
    table._rows_written = seen.get.get("rows", 0)
    return table


def table_rows(df: DataFrame) -> int:
    """The rows of a written table; only one from elsewhere is counted."""
    known = getattr(df, "_rows_written", None)
    return df.count() if known is None else known


def plan_bytes(df: DataFrame) -> int:
    """The size at which Spark rates the rows of a plan: that of the files it reads, or more."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def table_bytes(df: DataFrame) -> int:
    """The size of the files that a written table reads."""
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(name) for name in df.inputFiles()]
    return sum(path.getFileSystem(conf).getFileStatus(path).getLen() for path in paths)


def join_small(
    df: DataFrame,
    small: DataFrame,
    keys,
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
    computed: bool = False,
) -> DataFrame:
    """Join rows with per-key values, without ever sending a hot key to one task.

    A side that comes from little input is broadcast as it is. Otherwise ``small`` is computed once
    into the shared folder (``computed`` says it already is) and counted there; up to ``max_rows``
    rows and ``BROADCAST_BYTES`` of files it is broadcast. A larger side is joined by shuffle, except
    for the keys that hold more than ``hot_rows`` rows and a ten-thousandth of ``df``: there are at
    most ``MAX_HOT_KEYS`` of them, and their values are broadcast where they are small enough, else
    their rows are dealt by their content over ``SALTS`` copies of the values.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if max_rows == BROADCAST_ROWS and plan_bytes(small) <= SMALL_BYTES:
        return df.join(F.broadcast(small), keys, how)
    side = small if computed else cut_lineage(small, "side")
    if table_bytes(side) <= BROADCAST_BYTES and table_rows(side) <= max_rows:
        return df.join(F.broadcast(side), keys, how)
    limit = max(hot_rows, df.count() // MAX_HOT_KEYS)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = cut_lineage(sizes.where(F.col("_n") > limit).select(*keys), "hot")
    if hot.isEmpty():
        return df.join(side, keys, how)
    hot = F.broadcast(hot)
    few = cut_lineage(side.join(hot, keys, "left_semi"), "few")
    crowded = df.join(hot, keys, "left_semi")
    if table_bytes(few) <= BROADCAST_BYTES:
        crowded = crowded.join(F.broadcast(few), keys, how)
    else:
        hashable = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
        dealt = crowded.withColumn("_salt", F.pmod(F.xxhash64(*hashable), F.lit(SALTS)).cast("int"))
        copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        crowded = dealt.join(copies, [*keys, "_salt"], how).drop("_salt")
    rest = df.join(hot, keys, "left_anti").join(side, keys, how)
    return crowded.unionByName(rest)
