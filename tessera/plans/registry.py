"""All queries over the reference's operators, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with DuckDB SQL that returns the same rows."""

    def register(function: Query) -> Query:
        key = name or function.__name__
        if key in _queries:
            raise ValueError(f"query {key} is registered twice")
        _queries[key] = function
        if oracle:
            _oracles[key] = oracle
        return function

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
