"""A book of queries: each is entered under its name with its SQL, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def enter(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql is not None:
                self.sql[query.__name__] = sql
            return query

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(column: Column, places: int) -> Column:
    """Rounded as the product with a power of ten is, which is how SQL engines round doubles: Spark rounds the shortest decimal
    that reads back as the number, which stands on a half where the double lies just below one."""
    scale = float(10**places)
    return F.round(column * scale) / scale


def r6(column: Column) -> Column:
    """Rounded for comparison; sums of doubles depend on their order."""
    return rounded(column, 6)
