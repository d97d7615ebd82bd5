"""Registry of runnable queries: name -> function of the market tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.sources.market_tables import MarketTables

QUERIES: dict[str, Callable[[MarketTables], DataFrame]] = {}


def query(name: str):
    def register(build: Callable[[MarketTables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        return build

    return register


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name](MarketTables(spark, folder))


def rounded(column: str | Column, digits: int = 4) -> Column:
    """Rounded double; compared results must not depend on the order of floating-point sums."""
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def round_columns(df: DataFrame, names: list[str], digits: int = 4) -> DataFrame:
    return df.withColumns({name: rounded(name, digits) for name in names})
