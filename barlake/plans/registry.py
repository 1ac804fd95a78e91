"""Query registry: every public operator as (spark, sf_dir) -> DataFrame, with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ("daily", "health", "scoring", "sessions", "ledgers", "models", "streams")

#: Named subqueries of the DuckDB side: name -> (names it stands on, SQL).
SUBQUERIES: dict[str, tuple[list[str], str]] = {}


def subquery(name: str, uses: list[str], sql: str) -> None:
    SUBQUERIES[name] = (uses, sql)


def with_subqueries(uses: list[str], sql: str) -> str:
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            below, text = SUBQUERIES[name]
            for x in below:
                add(x)
            done[name] = text

    for name in uses:
        add(name)
    return (f"WITH {', '.join(f'{n} AS ({t})' for n, t in done.items())} " if done else "") + sql


def query(name: str, uses: list[str] | None = None, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_subqueries(uses or [], sql)
        return f

    return register


def load() -> None:
    for module in MODULES:
        import_module(f"barlake.plans.{module}")


def queries() -> dict[str, Query]:
    load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    load()
    return ORACLES
