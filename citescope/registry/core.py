"""Registered queries: a name, the Spark query and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test pages are one row group, which one task would read: dealt out by key. Crawls are read as they are."""
    return table(spark, sf_dir, "pages").repartition("page_id")


def dealt(rows: DataFrame, key: str, per_task: int) -> DataFrame:
    """Rows dealt out by key, `per_task` to a task: the test tables are so small in bytes that one task would read all."""
    return rows.repartition(max(1, -(-rows.count() // per_task)), key)
