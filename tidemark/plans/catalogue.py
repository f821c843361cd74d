"""Every query of the engine with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator: puts a query and, where SQL can say the same, its oracle in the catalogue."""

    def add(fn: Query) -> Query:
        assert name not in _QUERIES, name
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# The modules register their queries when they are imported.
from . import queries_checks, queries_docs, queries_events, queries_joins, queries_models, queries_stats  # noqa: E402, F401
