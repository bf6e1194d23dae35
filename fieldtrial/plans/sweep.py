"""Sweep grids, difficulty presets and resuming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Surrogate and mode combinations of the published sweep.
SURROGATES = ("GP", "RF", "NN", "BNN")
MODES = ("Regular", "Hard")

# Difficulty settings; missing entries take the default.
DEFAULTS = {
    "noise_level": 0.1,
    "heteroscedastic": False,
    "n_modes": 1,
    "mode_separation": 2.0,
    "n_discontinuities": 0,
    "discontinuity_strength": 2.0,
}
PRESETS = {
    "regular": {"noise_level": 0.0, "heteroscedastic": False, "n_modes": 1, "mode_separation": 2.0},
    "noise": {"noise_level": 0.1, "heteroscedastic": False, "n_modes": 1, "mode_separation": 2.0},
    "bimodal": {"noise_level": 0.2, "heteroscedastic": True, "n_modes": 2, "mode_separation": 2.0},
}
HARD_PRESET = {
    "DBO_dataset_rat_myocyte": "noise",
    "MOBO_dataset_rat_myocyte": "noise",
    "df_Human_Hela_regular_mode": "noise",
    "df_Human_Hela_timesaving_mode": "noise",
    "df_Human_T_Cell_Expanded": "bimodal",
    "df_Human_TF_Cell_Expanded": "bimodal",
}

_PRESET_SCHEMA = (
    "preset string, noise_level double, heteroscedastic boolean, n_modes int, "
    "mode_separation double, n_discontinuities int, discontinuity_strength double"
)


def presets(spark: SparkSession, settings: dict[str, dict] = PRESETS) -> DataFrame:
    rows = [(name, *[s.get(k) for k in DEFAULTS]) for name, s in settings.items()]
    return with_defaults(spark.createDataFrame(rows, _PRESET_SCHEMA))


def with_defaults(df: DataFrame) -> DataFrame:
    for name, value in DEFAULTS.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return df


def hard_presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(HARD_PRESET.items()), "dataset string, hard_preset string")


def sweep_grid(
    datasets: DataFrame,
    surrogates: Sequence[str] = SURROGATES,
    modes: Sequence[str] = MODES,
) -> DataFrame:
    """One row per surrogate, mode and dataset, with the difficulty of that cell.

    ``datasets`` has ``dataset`` and ``hard_preset``.
    """
    combos = F.array(*[F.struct(F.lit(s).alias("surrogate"), F.lit(m).alias("mode")) for s in surrogates for m in modes])
    cells = datasets.withColumn("_c", F.explode(combos)).select(
        F.concat_ws("_", "_c.surrogate", "_c.mode").alias("combo"),
        "dataset",
        "_c.surrogate",
        "_c.mode",
        F.when(F.col("_c.mode") == "Regular", F.lit("regular"))
        .otherwise(F.col("hard_preset"))
        .alias("preset"),
    )
    return cells.join(F.broadcast(presets(datasets.sparkSession)), "preset").drop("preset")


def pending_cells(cells: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells that are not finished yet."""
    return cells.join(done.select(*keys).distinct(), list(keys), "left_anti")
