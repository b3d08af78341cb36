"""Queries over the tables of a folder, with equivalent SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from garimpo.plans.materialize import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for work that is heavy on each row: a scan of too few splits is spread over the cores."""
    return spread(table(spark, folder, name))


def load() -> None:
    """Import all modules that register queries."""
    from garimpo.plans import log_queries, packing_queries, relational_queries, source_queries, text_queries, tokenizer_queries, vocabulary_queries  # noqa: F401


