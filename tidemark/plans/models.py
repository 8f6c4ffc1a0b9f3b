"""Layered models over the star schema: each declares what it reads, and is built after it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import RISK_FREE, TRADING_DAYS, YEAR, change, drawdown, ratio, rounded, trailing
from tidemark.operators import checks
from tidemark.plans.analytics import Star


@dataclass
class Model:
    build: Callable[..., DataFrame]
    reads: tuple[str, ...]
    materialized: str = "view"


@dataclass
class Registry:
    models: dict[str, Model] = field(default_factory=dict)

    def model(self, *reads: str, materialized: str = "view"):
        def add(build):
            self.models[build.__name__] = Model(build, reads, materialized)
            return build

        return add

    def order(self, *wanted: str) -> list[str]:
        """The wanted models (all if none) and what they read, each after what it reads."""
        done: list[str] = []

        def visit(name: str, path: tuple[str, ...] = ()) -> None:
            if name in path:
                raise ValueError(f"models read each other: {' > '.join((*path, name))}")
            if name in self.models and name not in done:
                for x in self.models[name].reads:
                    visit(x, (*path, name))
                done.append(name)

        for name in wanted or tuple(self.models):
            visit(name)
        return done

    def run(self, sources: dict[str, DataFrame], *wanted: str, digits: int | None = None, save: Callable[[str, DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
        """Frames by name. save(name, frame) stores a model that is to be a table and returns what others read."""
        frames = dict(sources)
        for name in self.order(*wanted):
            m = self.models[name]
            df = m.build(*[frames[x] for x in m.reads], digits=digits)
            frames[name] = save(name, df) if save and m.materialized == "table" else df
        return frames


registry = Registry()


def _d(digits: int | None, default: int) -> int:
    return default if digits is None else digits


@registry.model("dim_asset")
def stg_assets(assets: DataFrame, digits: int | None = None) -> DataFrame:
    text = lambda c: F.trim(c).alias(c)
    return assets.select("asset_key", F.upper(F.trim("symbol")).alias("symbol"), text("asset_name"), F.lower(F.trim("asset_type")).alias("asset_type"), text("sector"), text("industry"), "currency", "exchange")


@registry.model("fact_market_daily")
def stg_market_prices(fact: DataFrame, digits: int | None = None) -> DataFrame:
    price = lambda c: F.col(c).cast("double").alias(f"{c}_price")
    return fact.select(F.col("market_date_key").alias("date_key"), "asset_key", *map(price, ["open", "high", "low", "close", "adjusted_close"]), F.col("volume").cast("long").alias("volume"), "daily_return")


@registry.model("stg_market_prices")
def int_daily_returns(prices: DataFrame, digits: int | None = None) -> DataFrame:
    n = _d(digits, 6)
    back = lambda k: rounded(change("close_price", k, "asset_key", "date_key"), n).alias(f"return_{k}d")
    return prices.select("date_key", "asset_key", "close_price", "volume", "daily_return", back(5), back(20))


@registry.model("int_daily_returns")
def int_rolling_metrics(rows: DataFrame, digits: int | None = None) -> DataFrame:
    n = _d(digits, 4)
    mean = lambda c, k: F.avg(c).over(trailing(k, "asset_key", "date_key"))
    averages = {k: mean("close_price", k) for k in (20, 50, 200)}
    return rows.select(
        "date_key", "asset_key", "close_price", "volume", "daily_return", "return_5d", "return_20d", *[rounded(x, n).alias(f"sma_{k}") for k, x in averages.items()],
        *[rounded(ratio("close_price", x), n).alias(f"sma_{k}_ratio") for k, x in averages.items()], rounded(ratio("volume", mean("volume", 20)), _d(digits, 2)).alias("volume_ratio"),
        rounded(drawdown("close_price", "asset_key", "date_key"), _d(digits, 6)).alias("drawdown"),
    )


@registry.model("int_daily_returns")
def int_risk_metrics(rows: DataFrame, digits: int | None = None) -> DataFrame:
    r = F.col("daily_return")
    stats = rows.filter(r.isNotNull()).groupBy("asset_key").agg(
        F.count(r).alias("trading_days"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("spread"), F.sqrt(F.avg(F.when(r < 0, r * r).otherwise(0.0))).alias("down")
    )
    excess = F.col("mean") * float(TRADING_DAYS) - RISK_FREE
    year = lambda c: F.col(c) * YEAR
    return stats.select(
        "asset_key", "trading_days", rounded(F.col("mean") * float(TRADING_DAYS), _d(digits, 6)).alias("annualized_return"), rounded(year("spread"), _d(digits, 6)).alias("annualized_volatility"),
        rounded(year("down"), _d(digits, 6)).alias("annualized_downside_deviation"), rounded(ratio(excess, year("spread")), _d(digits, 4)).alias("sharpe_ratio"), rounded(ratio(excess, year("down")), _d(digits, 4)).alias("sortino_ratio"),
    )


@registry.model("stg_assets", "int_risk_metrics", "int_rolling_metrics", materialized="table")
def mart_asset_performance(assets: DataFrame, risk: DataFrame, rolling: DataFrame, digits: int | None = None) -> DataFrame:
    latest = rolling.groupBy("asset_key").agg(*[F.max_by(c, "date_key").alias(c) for c in ("close_price", "drawdown", "sma_200_ratio")])
    pct = lambda c: rounded(F.col(c) * 100.0, _d(digits, 2))
    return assets.join(risk, "asset_key").join(latest, "asset_key").select(
        "symbol", "asset_name", "asset_type", "sector", "industry", F.col("close_price").alias("latest_price"), pct("annualized_return").alias("annualized_return_pct"), pct("annualized_volatility").alias("annualized_volatility_pct"),
        "sharpe_ratio", "sortino_ratio", pct("drawdown").alias("current_drawdown_pct"), "sma_200_ratio",
    )


@registry.model("fact_market_daily", "dim_asset", "dim_date", materialized="table")
def mart_monthly_performance(fact: DataFrame, assets: DataFrame, dates: DataFrame, digits: int | None = None) -> DataFrame:
    n = _d(digits, 2)
    rows = fact.join(F.broadcast(assets.select("asset_key", "symbol")), "asset_key").join(dates.select(F.col("date_key").alias("market_date_key"), "calendar_year", "calendar_month"), "market_date_key")
    months = rows.groupBy("symbol", "calendar_year", "calendar_month").agg(F.min_by("adjusted_close", "market_date_key").alias("first"), F.max_by("adjusted_close", "market_date_key").alias("last"))
    return months.select(
        "symbol", "calendar_year", "calendar_month", rounded("first", n).alias("start_price"), rounded("last", n).alias("end_price"), rounded((F.col("last") - F.col("first")) / F.nullif("first", F.lit(0.0)) * 100.0, n).alias("monthly_return_pct"),
    )


@registry.model("stg_assets", "int_risk_metrics", "int_rolling_metrics", materialized="table")
def mart_risk_dashboard(assets: DataFrame, risk: DataFrame, rolling: DataFrame, digits: int | None = None) -> DataFrame:
    """Ranks are over the rounded ratios, so ties are possible; there is a row for each asset."""
    deepest = rolling.groupBy("asset_key").agg(F.min("drawdown").alias("deepest"))
    pct = lambda c: rounded(F.col(c) * 100.0, _d(digits, 2))
    return assets.join(risk, "asset_key").join(deepest, "asset_key").select(
        "symbol", "asset_name", "sector", "sharpe_ratio", "sortino_ratio", pct("annualized_volatility").alias("annualized_volatility_pct"), pct("annualized_downside_deviation").alias("downside_deviation_pct"), pct("deepest").alias("max_drawdown_pct"),
        F.dense_rank().over(Window.orderBy(F.desc("sharpe_ratio"))).alias("sharpe_rank"), F.dense_rank().over(Window.orderBy("annualized_volatility")).alias("defensive_rank"),
    )


def sources(s: Star) -> dict[str, DataFrame]:
    return {"dim_asset": s.assets, "dim_date": s.dates, "fact_market_daily": s.fact}


def tests(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows that break each declared check."""
    return {
        "check_positive_prices": checks.positive_prices(frames["stg_market_prices"]),
        "check_drawdown_bounds": checks.drawdown_bounds(frames["int_rolling_metrics"]),
        "check_unique_asset_key": checks.unique(frames["stg_assets"], "asset_key"),
        "check_unique_fact_key": checks.unique(frames["fact_market_daily"], "market_date_key", "asset_key"),
        "check_not_null_symbol": checks.not_null(frames["stg_assets"], "symbol"),
        "check_not_null_fact_key": checks.not_null(frames["fact_market_daily"], "market_date_key", "asset_key"),
        "check_accepted_asset_types": checks.accepted_values(frames["stg_assets"], "asset_type", ["equity", "etf"]),
        "check_fact_asset": checks.relationships(frames["fact_market_daily"], "asset_key", frames["dim_asset"], "asset_key"),
        "check_fact_date": checks.relationships(frames["fact_market_daily"], "market_date_key", frames["dim_date"], "date_key"),
    }
