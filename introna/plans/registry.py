"""Registry of queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from introna.plans.bindings import Tables
from introna.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AREA: dict[str, str] = {}  # module of each query, for partial runs


def query(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under ``name``."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(configure(spark), folder))

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        AREA[name] = build.__module__.rsplit(".", 1)[-1].removesuffix("_queries")
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
