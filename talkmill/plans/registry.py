"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of Views under a name, with its SQL; {views} in the SQL takes the shared view definitions."""

    def register(f):
        from .views import SQL_VIEWS, Views

        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql.replace("{views}", SQL_VIEWS)
        return f

    return register
