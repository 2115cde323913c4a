"""Query registry: a Spark callable and, where possible, the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from cobblestone.session import settle
from workload import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query; ``uses`` names the fixture views its SQL reads."""

    def register(fn: Query) -> Query:
        @wraps(fn)
        def settled(spark, sf_dir):
            return fn(settle(spark), sf_dir)

        QUERIES[name] = settled
        if sql is not None:
            ORACLES[name] = fixtures.duckdb_sql(sql, uses)
        return fn

    return register
