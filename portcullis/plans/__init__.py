"""Registered queries and their DuckDB counterparts, a module for each area."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Add a query ``(spark, sf_dir) -> DataFrame`` under ``name``, with its SQL if there is any."""

    def add(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


# The modules register their queries here.
from portcullis.plans import access, console, detection, engine, gateway, governed, logs, metrics, personal, policies, recorded, windows  # noqa: E402, F401
