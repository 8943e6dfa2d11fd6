"""The catalogue of runnable queries and their independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the same result for another engine."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def R(expr: str, digits: int = 6) -> str:
    """SQL twin of ``functions.numeric.rounded``."""
    return f"(round(CAST({expr} AS DOUBLE) + 1e-10, {digits}) + 0e0)"


def RA(*columns: str, digits: int = 6) -> str:
    """Rounded columns under their own names."""
    return ", ".join(f"{R(c, digits)} AS {c}" for c in columns)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
