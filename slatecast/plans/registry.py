"""How a module of plans lists its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def registry():
    """The two dictionaries of a module, and the decorator that fills them."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    sql: dict[str, str] = {}

    def query(oracle: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if oracle:
                sql[f.__name__] = oracle
            return f

        return add

    return queries, sql, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
