"""Result files: JSON in several layouts to one long frame, and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prep import final_best, instance_key, parse_result_name

_RESULT = (
    "struct<steps_to_target:double,found_target:boolean,final_best:double,best_value:double,"
    "best_value_so_far:string,max_steps_capped:boolean,"
    "optimization_history:array<struct<step:int,best_value_so_far:double,current_best:double>>>"
)
_COMPETITIONS = f"array<struct<optimizer_results:map<string,{_RESULT}>>>"
_TOURNAMENTS = f"array<struct<competitions:{_COMPETITIONS}>>"
_ROOT = (
    "struct<tournament_results:string,all_tournament_results:string,competitions:string,"
    "results:string,files:array<struct<data:string>>>"
)


def read_json_text(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Documents as (path, text), cleaned of a byte order mark or junk before the document.

    A document is a whole file, or one line of a file with ``lines``.
    """
    return spark.read.text(path, wholetext=not lines).select(
        F.col("_metadata.file_path").alias("path"), strip_junk(F.col("value")).alias("text")
    )


def strip_junk(text: Column) -> Column:
    """Text from the first ``{`` or ``[`` on; unchanged when there is none."""
    brace, bracket = F.instr(text, "{"), F.instr(text, "[")
    start = F.least(F.when(brace > 0, brace), F.when(bracket > 0, bracket))
    return F.when(start > 1, F.substr(text, start)).otherwise(text)


def read_dirty_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_json_text(spark, path).select(
        "path", F.from_json("text", schema).alias("data")
    )


def _tournaments(root: Column) -> Column:
    """Tournaments of one document; an object is read as a list of one."""
    listed = [
        F.from_json(root["tournament_results"], _TOURNAMENTS),
        F.from_json(root["all_tournament_results"], _TOURNAMENTS),
    ]
    inner = F.from_json(root["results"], _ROOT)
    listed += [
        F.from_json(inner["all_tournament_results"], _TOURNAMENTS),
        F.from_json(inner["tournament_results"], _TOURNAMENTS),
    ]
    bare = F.from_json(root["competitions"], _COMPETITIONS)
    listed.append(F.when(bare.isNotNull(), F.array(F.struct(bare.alias("competitions")))))
    # A layout that is there but empty is passed over. Each is parsed once, and only if those before
    # it are not there.
    return F.coalesce(*[F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, f))[0] for found in listed])


def parse_results(files: DataFrame) -> DataFrame:
    """Long results frame from (path, text) rows.

    Layouts: ``tournament_results`` as object or list, ``all_tournament_results``, a ``results``
    wrapper, ``competitions`` at the root, and a ``files[].data`` wrapper around any of them.
    Documents, tournaments or competitions without the expected node give no rows.
    """
    dataset, batch = parse_result_name(F.element_at(F.split("path", "/"), -1))
    roots = files.select(
        "path",
        dataset.alias("dataset"),
        batch.alias("batch"),
        F.from_json("text", _ROOT).alias("root"),
    )
    # Only a wrapped document is parsed a second time.
    wrapped = F.when(F.size("root.files") > 0, F.col("root.files.data"))
    bare = F.array(F.lit(None).cast("string"))
    documents = roots.select(
        "path", "dataset", "batch", "root", F.explode(F.coalesce(wrapped, bare)).alias("inner")
    ).withColumn("root", F.coalesce(F.from_json("inner", _ROOT), F.col("root")))
    competitions = (
        documents.select("path", "dataset", "batch", F.explode(_tournaments(F.col("root"))).alias("t"))
        .select("path", "dataset", "batch", F.posexplode("t.competitions").alias("i", "c"))
    )
    rows = competitions.select(
        "path", "dataset", "batch", F.col("i").alias("competition_idx"),
        F.explode("c.optimizer_results").alias("optimizer", "r"),
    )
    stored = F.col("r.best_value_so_far")
    values = F.when(stored.startswith("["), F.from_json(stored, "array<double>"))
    return rows.select(
        "path",
        "dataset",
        "batch",
        "competition_idx",
        "optimizer",
        instance_key(F.col("dataset"), F.col("batch"), F.col("competition_idx")).alias("instance"),
        F.col("r.steps_to_target").alias("steps_to_target"),
        F.col("r.found_target").alias("found_target"),
        F.coalesce(
            final_best(values, F.col("r.optimization_history"), stored.try_cast("double")),
            F.col("r.final_best"),
            F.col("r.best_value"),
        ).alias("final_best"),
        F.col("r.optimization_history").alias("history"),
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return parse_results(read_json_text(spark, path))


def valid_results(df: DataFrame, metric: str) -> DataFrame:
    """Rows that carry the metric."""
    return df.where(F.col(metric).isNotNull())


def histories(results: DataFrame) -> DataFrame:
    """One row per recorded step; ``best_value_so_far`` falls back to ``current_best``."""
    return (
        results.select("path", "instance", "optimizer", F.explode("history").alias("h"))
        .select(
            "path",
            "instance",
            "optimizer",
            F.col("h.step").alias("step"),
            F.coalesce("h.best_value_so_far", "h.current_best").alias("value"),
        )
        .where(F.col("step").isNotNull() & F.col("value").isNotNull())
    )


_STATS = "map<string,struct<mean_steps:double,std_steps:double,n_competitions:double,count:double>>"


def parse_optimizer_stats(files: DataFrame) -> DataFrame:
    """Stored summaries: optimizer, mean, deviation and count; a missing mean is dropped."""
    root = F.from_json("text", f"struct<optimizer_stats:{_STATS},mean_steps:{_STATS}>")
    n = F.coalesce(
        F.when(F.col("s.n_competitions") != 0, F.col("s.n_competitions")), F.col("s.count"),
        F.lit(0.0),
    )
    return (
        files.select("path", root.alias("root"))
        .select(
            "path",
            F.explode(F.coalesce("root.optimizer_stats", "root.mean_steps")).alias("optimizer", "s"),
        )
        .select(
            "path",
            "optimizer",
            F.col("s.mean_steps").alias("mean_steps"),
            F.col("s.std_steps").alias("std_steps"),
            n.cast("bigint").alias("n"),
        )
        .where(F.col("mean_steps").isNotNull())
    )


def read_optimizer_stats(spark: SparkSession, path: str) -> DataFrame:
    return parse_optimizer_stats(read_json_text(spark, path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quoteAll=False, escape='"')


def write_cells(df: DataFrame, path: str) -> None:
    """One JSON folder per sweep cell; finished cells are found again by their folder.

    A cell that is written again replaces what it had.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("combo", "dataset").json(path)


def read_text_table(spark: SparkSession, path: str, fill: str | None = "") -> DataFrame:
    """CSV with every column a string; nulls become ``fill`` unless it is None."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return df if fill is None else df.fillna(fill)
