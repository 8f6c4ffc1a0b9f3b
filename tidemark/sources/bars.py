"""Daily (or hourly) bars of trades and events, aggregated in one pass: first and last prices are min_by and max_by of a total order.

The order of trades is packed into one decimal(38,0). Sums over such keys have buffers of a fixed width, so bars are hash aggregates; a struct as the key would
make Spark sort every trade on both sides of the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Numbers that an order key has room for: orders, lines, parts, suppliers, and prices in cents; their product is 10**38.
ROOM = {"l_orderkey": 10**12, "l_linenumber": 8, "l_partkey": 10**10, "l_suppkey": 10**8, "cents": 12_500_000}


def to_bars(trades: DataFrame, keys: list[str]) -> DataFrame:
    """trades: keys, price, quantity and `at`, a number that orders the trades of a bar totally (up to trades of equal prices)."""
    first, last = F.min_by("price", "at"), F.max_by("price", "at")
    return trades.groupBy(*keys).agg(
        first.alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), last.alias("close"), last.alias("adjusted_close"),
        F.sum("quantity").cast("long").alias("volume"),
    )


def order_key(room: dict[str, int] = ROOM) -> Column:
    """Order, line, part, supplier and price (of whole cents) of a trade as one decimal(38,0), ordered like them. A field beyond its room is an error: nothing is ordered wrongly in silence."""
    fields = {"cents": F.round(F.col("l_extendedprice") * 100).cast("long")}
    key, fits = F.lit(0).cast("decimal(38,0)"), F.lit(True)
    for name, most in room.items():
        x = fields.get(name, F.col(name).cast("long"))
        fits &= (x >= 0) & (x < most)
        key = (key * F.lit(most).cast("decimal(13,0)")).cast("decimal(38,0)") + x.cast("decimal(13,0)")
    key = key.cast("decimal(38,0)")
    return F.when(~fits, F.raise_error(F.lit(f"a trade doesn't fit the order key's room: {room}")).cast("decimal(38,0)")).otherwise(key)


def bars_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol for each type of part."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("symbol"))
    trades = table(spark, sf_dir, "lineitem").join(parts, "l_partkey")
    return to_bars(trades.select("symbol", F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), order_key().alias("at")), ["symbol", "date"])


def bars_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol for each nation of suppliers, and its region as sector."""
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = table(spark, sf_dir, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("symbol"), F.col("r_name").alias("sector")
    )
    trades = table(spark, sf_dir, "lineitem").join(suppliers, "l_suppkey")
    return to_bars(
        trades.select("symbol", "sector", F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), order_key().alias("at")),
        ["symbol", "sector", "date"],
    )


def bars_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars: a symbol for each type of event; volume counts events."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("date"), F.col("value").alias("price"), F.lit(1).alias("quantity"), F.col("event_id").alias("at")
    )
    return to_bars(events, ["symbol", "date"])


def bronze(bars: DataFrame, source: str, batch_id: str, stamp: str) -> DataFrame:
    """Standardised bars with the batch's marks: dates as text, prices to 4 digits, an adjusted close for every row."""
    price = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 4).alias(c)
    return bars.na.drop(how="all", subset=["open", "high", "low", "close"]).select(
        "symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), price("open"), price("high"), price("low"), price("close"),
        F.round(F.coalesce("adjusted_close", "close", F.lit(0.0)), 4).alias("adjusted_close"), F.coalesce(F.col("volume").cast("long"), F.lit(0)).cast("long").alias("volume"),
        F.lit(stamp).alias("ingestion_timestamp"), F.lit(source).alias("source"), F.lit(batch_id).alias("batch_id"),
    )
