"""The full comparison of one experimental setting."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.compare import analysis_parts

# Metric and direction of the two protocols.
PROTOCOLS = {
    "Hide_The_Label": ("steps_to_target", True),
    "Open_Race": ("final_best", False),
}


def analyze(results: DataFrame, protocol: str) -> dict[str, DataFrame]:
    """Friedman tests, rankings, summary and adjusted pairwise rows of a results frame."""
    metric, ascending = PROTOCOLS[protocol]
    return analysis_parts(results, metric, ascending)
