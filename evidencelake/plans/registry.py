"""Registry of runnable queries and, where SQL can state them, their oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

MODULES = ("retrieval", "measurement", "calibration", "catalogs", "governance", "documents", "understanding", "graphs", "answering", "records", "ingestion", "applications", "payloads")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a key together with its SQL statement."""

    def register(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = function
        if sql is not None:
            _ORACLES[name] = sql
        return function

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every plan module once and return queries and oracles."""
    for module in MODULES:
        importlib.import_module(f"evidencelake.plans.{module}")
    return dict(_QUERIES), dict(_ORACLES)
