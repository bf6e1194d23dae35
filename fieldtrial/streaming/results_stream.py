"""Result files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.results import parse_results, strip_junk


def stream_results(
    spark: SparkSession, path: str, lines: bool = False, max_files: int | None = None
) -> DataFrame:
    """Long results frame of a folder as a stream, one document per file or per line."""
    reader = spark.readStream.option("wholetext", not lines)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.text(path).select(
        F.col("_metadata.file_path").alias("path"), strip_junk(F.col("value")).alias("text")
    )
    return parse_results(files)


def running_totals(results: DataFrame) -> DataFrame:
    """Running statistics per optimizer; the state is a few numbers for each."""
    return results.groupBy("optimizer").agg(
        F.count(F.lit(1)).alias("n_competitions"),
        F.avg("steps_to_target").alias("mean_steps"),
        F.stddev_pop("steps_to_target").alias("std_steps"),
        F.min("steps_to_target").alias("min_steps"),
        F.max("steps_to_target").alias("max_steps"),
        F.avg(F.col("found_target").cast("double")).alias("success_rate"),
        F.avg("final_best").alias("mean_final_best"),
    )


def append_once(stream: DataFrame, path: str, checkpoint: str, partition: str = "arrival") -> None:
    """Append what has arrived to the Parquet table ``path``, exactly once, and return.

    A batch is one folder, named by its number. A batch that is run again after a failure replaces its
    folder, so the table holds every row once however often the stream is stopped, killed or restarted.
    The rows are written before the checkpoint knows the batch, never the other way round.
    """

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/{partition}={number}")

    run = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()


def totals_snapshot(results: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what has arrived and return the totals, one row per optimizer.

    Every batch adds its own partial sums per optimizer to the table ``path``, once; the totals add
    those up. Results that came before are not read again.
    """
    sums = [
        F.count(F.lit(1)).alias("n_competitions"),
        *[f(c).alias(f"{n}_{c}") for c in ("steps_to_target", "found", "final_best") for n, f in (("n", F.count), ("sum", F.sum))],
        F.avg("steps_to_target").alias("avg_steps"),
        F.var_pop("steps_to_target").alias("var_steps"),
        F.min("steps_to_target").alias("min_steps"),
        F.max("steps_to_target").alias("max_steps"),
    ]

    def write(rows: DataFrame, number: int) -> None:
        part = rows.withColumn("found", F.col("found_target").cast("double")).groupBy("optimizer").agg(*sums)
        part.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run = (
        results.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    parts = results.sparkSession.read.parquet(path)
    n = F.sum("n_steps_to_target")
    mean = F.try_divide(F.sum("sum_steps_to_target"), n)
    # Spread within the batches, and of their means around the common one.
    within = F.sum(F.col("n_steps_to_target") * F.col("var_steps"))
    squares = F.sum(F.col("n_steps_to_target") * F.col("avg_steps") * F.col("avg_steps"))
    return parts.groupBy("optimizer").agg(
        F.sum("n_competitions").alias("n_competitions"),
        mean.alias("mean_steps"),
        F.when(n > 0, F.sqrt(F.greatest(F.try_divide(within + squares, n) - mean * mean, F.lit(0.0)))).alias("std_steps"),
        F.min("min_steps").alias("min_steps"),
        F.max("max_steps").alias("max_steps"),
        F.try_divide(F.sum("sum_found"), F.sum("n_found")).alias("success_rate"),
        F.try_divide(F.sum("sum_final_best"), F.sum("n_final_best")).alias("mean_final_best"),
    )
