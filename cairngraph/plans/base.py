"""What the modules of queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def registrar() -> tuple[dict, dict, Callable]:
    """Queries and SQL twins by name, and the decorator that fills them."""
    queries: dict = {}
    oracles: dict = {}

    def query(oracle: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if oracle:
                oracles[f.__name__] = oracle
            return f

        return add

    return queries, oracles, query


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")
