"""The star schema: dimensions of assets and dates, and the daily fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut
from tidemark.operators import checks

METRICS = ["daily_return", "volatility_20d", "volatility_60d", "sma_20", "sma_50", "sma_200", "volume_ratio", "drawdown", "cumulative_return"]


def dim_asset(bars: DataFrame) -> DataFrame:
    """Distinct symbols in order, numbered from 1. The window sees one row for each asset."""
    sector = F.col("sector") if "sector" in bars.columns else F.lit("Diversified")
    assets = bars.select("symbol", sector.alias("sector")).distinct()
    return assets.select(
        F.row_number().over(Window.orderBy("symbol")).alias("asset_key"), "symbol", F.initcap("symbol").alias("asset_name"), F.lit("equity").alias("asset_type"), "sector",
        F.lit("Trade").alias("industry"), F.lit("USD").alias("currency"), F.lit("XTPC").alias("exchange"),
    )


def dim_date(bars: DataFrame) -> DataFrame:
    d = F.col("date")
    month_end = d == F.last_day(d)
    return bars.select(F.to_date("date").alias("date")).filter("date IS NOT NULL").distinct().select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), F.date_format(d, "yyyy-MM-dd").alias("calendar_date"), F.year(d).alias("calendar_year"), F.quarter(d).alias("calendar_quarter"),
        F.month(d).alias("calendar_month"), F.floor((F.dayofyear(d) - 1 + 7 - F.weekday(d)) / 7).cast("int").alias("calendar_week"), (F.weekday(d) + 1).alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"), F.lit(1).alias("is_trading_day"), month_end.cast("int").alias("is_month_end"), (month_end & (F.month(d) % 3 == 0)).cast("int").alias("is_quarter_end"),
    )


def fact_market_daily(gold: DataFrame, assets: DataFrame) -> DataFrame:
    """One row for each date and asset; a symbol without an asset has a null key, which the checks find."""
    return gold.join(F.broadcast(assets.select("symbol", "asset_key")), "symbol", "left").select(
        F.date_format(F.to_date("date"), "yyyyMMdd").cast("int").alias("market_date_key"), "asset_key", "open", "high", "low", "close", "adjusted_close", "volume", *METRICS, "is_abnormal_volume"
    )


#: Declared tables of the catalog: columns, those that must not be null, the key, and for each foreign key the parent and its key.
TABLES = {
    "dim_asset": ("asset_key INT NOT NULL, symbol STRING NOT NULL, asset_name STRING, asset_type STRING, sector STRING, industry STRING, currency STRING, exchange STRING", ("asset_key",), {}),
    "dim_date": (
        "date_key INT NOT NULL, calendar_date STRING NOT NULL, calendar_year INT, calendar_quarter INT, calendar_month INT, calendar_week INT, day_of_week INT, day_name STRING, is_trading_day INT, is_month_end INT, is_quarter_end INT",
        ("date_key",), {},
    ),
    "fact_market_daily": (
        "market_date_key INT NOT NULL, asset_key INT NOT NULL, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, adjusted_close DOUBLE, volume BIGINT, " + ", ".join(f"{c} DOUBLE" for c in METRICS) + ", is_abnormal_volume INT",
        ("market_date_key", "asset_key"), {"market_date_key": ("dim_date", "date_key"), "asset_key": ("dim_asset", "asset_key")},
    ),
}


def create_tables(spark: SparkSession, database: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, (columns, *_) in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def load_table(df: DataFrame, database: str, name: str) -> None:
    """Appends rows to a declared table. Spark's file tables enforce no keys, so rows with null keys, repeated keys (of the rows and of the table) or without a parent are refused."""
    spark, (columns, key, parents) = df.sparkSession, TABLES[name]
    # Stored, since the checks and the insert read the rows.
    rows = cut(df.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in columns.split(", ")]))
    required = [c.split()[0] for c in columns.split(", ") if "NOT NULL" in c]
    stored = spark.table(f"{database}.{name}").select(*key)
    broken = {"null": checks.not_null(rows, *required), "repeated key": checks.unique(rows.select(*key).unionByName(stored), *key)}
    broken |= {f"no {parent}": checks.relationships(rows, c, spark.table(f"{database}.{parent}"), own) for c, (parent, own) in parents.items()}
    found = [r.name for r in checks.results(broken).filter("violations > 0").collect()]  # a row for each rule
    if found:
        raise ValueError(f"{name}: {', '.join(sorted(found))}")
    rows.write.insertInto(f"{database}.{name}")
