"""The queries of the library itself; ``QUERIES`` and ``ORACLES`` are filled by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where SQL can say the same, that SQL."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def load() -> None:
    """Imports the modules that register queries."""
    from spanveil.plans import credentials, decisions, detection, identifier_runs, lexicon, names, oversight, persons, rule_cases  # noqa: F401
