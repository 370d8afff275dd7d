"""Registered queries of the library (the ``llm`` subpackage keeps its own list)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class _Register:
    """``@query(name, sql)`` registers a query and SQL with the same rows."""

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            QUERIES[name] = f
            if sql:
                self.sql(name, sql)
            return f

        return add

    @staticmethod
    def sql(name: str, text: str) -> None:
        ORACLES[name] = text


query = _Register()


def load() -> None:
    """Import the modules that register queries."""
    from corpusloom.plans import data_queries, model_queries  # noqa: F401
