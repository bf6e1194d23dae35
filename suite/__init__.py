"""Registered queries: each runs an operator over the driver's tables, next to its SQL."""

from __future__ import annotations

import importlib

MODULES = (
    "stat_queries",
    "prep_queries",
    "generation_queries",
    "scoring_queries",
    "curation_queries",
    "protocol_queries",
    "round_queries",
)


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")


def all_queries():
    from .registry import QUERIES

    _load()
    return dict(QUERIES)


def all_sql():
    from .registry import SQL

    _load()
    return dict(SQL)
