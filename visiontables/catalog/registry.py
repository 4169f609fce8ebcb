"""Named queries over the derived tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from visiontables.fixtures import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str = "", sql: str | None = None, recursive: bool = False):
    """Register ``fn(Tables) -> DataFrame`` under ``name``.

    ``tables`` lists the derived tables the DuckDB text ``sql`` reads.
    """

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_tables(tables, sql, recursive) if tables else sql
        return fn

    return wrap
