"""Query registry: a name, a function of (spark, folder) and, where SQL can say it, the equivalent DuckDB text."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gatewise.sources.standins import oracle_prefix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ["labels", "relational", "expressions", "rules", "evaluation", "encoding", "weighting", "statistics", "decisions", "modelling", "streams"]


def query(name: str, uses: tuple[str, ...] | list[str] = (), sql: str | None = None):
    """Register a query. ``uses`` names the fixtures its SQL reads; ``sql`` may start with further CTEs (``x AS (..) SELECT ..``)."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            body = sql.strip()
            starts_with_select = body[:6].upper() == "SELECT"
            if uses:
                ORACLES[name] = oracle_prefix(uses) + ("\n" if starts_with_select else ",\n") + body
            else:
                ORACLES[name] = body if starts_with_select else "WITH " + body
        return fn
    return register


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"gatewise.plans.{module}")
