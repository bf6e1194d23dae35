"""Dataset registry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class DatasetSpec:
    """How a measured dataset is stored and which columns mean what."""

    name: str
    target: str = "Label"
    variance: str | None = "Label_var"
    features: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    transform: str | None = None
    control: str | None = None
    variance_kind: str = "variance"


@dataclass(frozen=True)
class SyntheticSpec:
    name: str
    n_features: int
    n_samples: int = 200
    noise: float = 0.1


# Column names of the measured datasets.
_ADMIN = "Unnamed: 0"
_T_CELL = (
    "bME", "LS1000", "PY", "ITS", "ALB", "MEMAA", "ARG", "GLU", "CB6", "IL-2", "IL-12", "IL-18",
    "IL-21", "VS",
)
_TF_CELL = (
    "CHIR99021", "SP600125", "Dexameth", "rhGM-CSF", "rhSCF", "rhIGF-1", "AA", "Y27632", "ALB",
    "FN", "GL", "CH", "ITS", "bME", "PY",
)
_PLATE = dict(
    target="mean A450", variance="sd A450", drop=(_ADMIN, "Round"), variance_kind="deviation"
)

_SPECS = [
    DatasetSpec("MOBO_dataset_rat_myocyte", drop=(_ADMIN, "Fidelity")),
    DatasetSpec("DBO_dataset_rat_myocyte"),
    DatasetSpec("df_Human_Hela_regular_mode", **_PLATE),
    DatasetSpec("df_Human_Hela_timesaving_mode", **_PLATE),
    DatasetSpec(
        "df_Human_T_Cell_Expanded", target="Cell count", variance=None, features=_T_CELL,
        transform="log_ratio", control="PosCont FC", variance_kind="zero",
    ),
    DatasetSpec(
        "df_Human_TF_Cell_Expanded", target="normalized cell count", variance=None,
        features=_TF_CELL, transform="log1p", variance_kind="zero",
    ),
    SyntheticSpec("synthetic_2d", 2),
    SyntheticSpec("synthetic_5d", 5),
    SyntheticSpec("synthetic_10d", 10),
]
_BY_NAME = {s.name: s for s in _SPECS}


def names() -> list[str]:
    return list(_BY_NAME)


def get(name: str) -> DatasetSpec | SyntheticSpec:
    if name not in _BY_NAME:
        raise ValueError(f"unknown dataset {name!r}; available: {names()}")
    return _BY_NAME[name]


def register(df: DataFrame, spec: DatasetSpec | SyntheticSpec) -> None:
    """Expose a loaded dataset as a temporary view under its registry name."""
    df.createOrReplaceTempView(spec.name)


def read_dataset(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Numeric CSV with a header; ``columns`` gives every column's type, nothing is inferred."""
    schema = T.StructType(
        [T.StructField(c, T._parse_datatype_string(t)) for c, t in columns.items()]
    )
    return spark.read.csv(path, header=True, schema=schema)


def csv_columns(spark: SparkSession, path: str) -> dict[str, str]:
    """Column types of a numeric CSV taken from its header line alone: all are doubles."""
    first = spark.read.csv(path, header=True, inferSchema=False)
    return {c if c != "_c0" else _ADMIN: "double" for c in first.columns}
