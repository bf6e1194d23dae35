"""Query registry and the SQL fragments that mirror the hash functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def s_hash(*parts: str) -> str:
    """SQL for hash_int; parts are SQL expressions."""
    return (
        "CAST(('0x' || substr(md5(concat_ws('|', "
        + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
        + ")), 1, 8))::UBIGINT AS BIGINT)"
    )


def s_u(*parts: str) -> str:
    return f"({s_hash(*parts)} / 4294967296.0::DOUBLE)"


def s_u_open(*parts: str) -> str:
    return f"(({s_hash(*parts)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def s_normal(*parts: str) -> str:
    r = s_u_open(*parts, "'r'")
    a = s_u_open(*parts, "'a'")
    return f"(sqrt(-2.0::DOUBLE * ln({r})) * cos(2.0::DOUBLE * pi() * {a}))"


def s_erf(x: str) -> str:
    return (
        f"(CASE WHEN {x} > 0 THEN 1.0 WHEN {x} < 0 THEN -1.0 ELSE 0.0 END::DOUBLE * (1.0::DOUBLE - "
        "(((((1.061405429::DOUBLE * t_ + -1.453152027::DOUBLE) * t_ + 1.421413741::DOUBLE) * t_ "
        "+ -0.284496736::DOUBLE) * t_ + 0.254829592::DOUBLE) * t_) "
        f"* exp(-({x}) * ({x}))))"
    ).replace("t_", f"(1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * abs({x})))")


def s_cdf(z: str) -> str:
    return f"(0.5::DOUBLE * (1.0::DOUBLE + {s_erf(f'(({z}) / sqrt(2.0::DOUBLE))')}))"


def s_pdf(z: str) -> str:
    return f"(exp(-0.5::DOUBLE * ({z}) * ({z})) / sqrt(2.0::DOUBLE * pi()))"
