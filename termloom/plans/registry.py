"""The queries that are registered, each over whole tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(f: Callable) -> Callable:
    """Register a query of the tables it names as parameters."""
    names = f.__code__.co_varnames[: f.__code__.co_argcount]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(*[spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names])

    QUERIES[f.__name__] = run
    return f


def twin(sql: str) -> Callable:
    """Give the query below a DuckDB twin."""

    def give(f: Callable) -> Callable:
        TWINS[f.__name__] = sql
        return f

    return give
