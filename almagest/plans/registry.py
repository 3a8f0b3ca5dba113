"""The named queries of the core and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL of the same result where
    SQL can express it."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries of the core, and their SQL."""
    import importlib

    for m in ("problems", "corpus", "papers", "relations", "requests", "views", "numeric", "stream"):
        try:
            importlib.import_module(f"almagest.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"almagest.plans.{m}":
                raise
    return QUERIES, SQL
