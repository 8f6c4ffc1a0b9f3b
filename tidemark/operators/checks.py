"""Integrity checks: each is the rows that break a rule; a check passes if there are none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def positive_prices(prices: DataFrame, column: str = "close_price") -> DataFrame:
    return prices.filter(F.col(column) <= 0)


def drawdown_bounds(rolling: DataFrame, column: str = "drawdown") -> DataFrame:
    return rolling.filter((F.col(column) > 0.001) | (F.col(column) < -1.0))


def unique(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).count().filter("count > 1")


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(~F.col(column).isin(values))


def relationships(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose value has no parent; nulls are left to not_null."""
    keys = parent.select(F.col(parent_column).alias(column)).distinct()
    return df.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


def count(name: str, broken: DataFrame) -> DataFrame:
    return broken.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations")


def results(checks: dict[str, DataFrame]) -> DataFrame:
    """name, violations, status of all checks."""
    rows = reduce(DataFrame.unionByName, [count(name, broken) for name, broken in checks.items()])
    return rows.withColumn("status", F.when(F.col("violations") == 0, "PASSED").otherwise(F.concat(F.lit("FAILED ("), F.col("violations"), F.lit(" violations)"))))
