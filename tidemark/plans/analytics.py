"""Eight named analytics over the star schema. Prices and ratios are rounded to `digits`; dispersion is that of a population."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import RISK_FREE, TRADING_DAYS, YEAR, rounded, trailing
from tidemark.functions.quantiles import at_ranks
from tidemark.operators import gold as gold_features
from tidemark.operators import star


@dataclass
class Star:
    """Assets are one row each and broadcast; dates carry the calendar."""

    assets: DataFrame
    dates: DataFrame
    fact: DataFrame

    @classmethod
    def of(cls, bars: DataFrame) -> Star:
        """Bars are read three times, so they should be stored ones (see functions.lineage.cut)."""
        assets = star.dim_asset(bars)
        return cls(assets, star.dim_date(bars), star.fact_market_daily(gold_features.features(bars), assets))

    def daily(self, *asset_columns: str) -> DataFrame:
        """Fact rows with their asset's columns and calendar day."""
        rows = self.fact.join(F.broadcast(self.assets.select("asset_key", *asset_columns)), "asset_key")
        return rows.withColumn("calendar_date", _calendar_date("market_date_key"))


def _calendar_date(key: str) -> Column:
    """yyyy-MM-dd of a date key."""
    return F.concat_ws("-", *[F.substring(F.col(key).cast("string"), a, n) for a, n in ((1, 4), (5, 2), (7, 2))])


def _spread(x: str) -> Column:
    """Population deviation from moments, clamped at 0."""
    return F.sqrt(F.greatest(F.avg(F.col(x) * F.col(x)) - F.avg(x) * F.avg(x), F.lit(0.0)))


def _sharpe(mean: Column, deviation: Column) -> Column:
    return (mean * float(TRADING_DAYS) - RISK_FREE) / F.nullif(deviation * YEAR, F.lit(0.0))


def _ladder(x: Column, steps: list[tuple[float, str]], above: bool, rest: str) -> Column:
    """The first step that x passes (above: x > step, else x >= step); rest also for nulls."""
    out = F.lit(rest)
    for limit, name in reversed(steps):
        out = F.when(x > limit if above else x >= limit, name).otherwise(out)
    return out


def asset_performance(s: Star, digits: int = 2) -> DataFrame:
    keys = ["symbol", "asset_name", "asset_type", "sector"]
    rows = s.daily(*keys).groupBy(*keys).agg(
        F.count("market_date_key").alias("total_trading_days"), F.min_by("adjusted_close", "market_date_key").alias("first"), F.max_by("adjusted_close", "market_date_key").alias("last"),
        F.avg("daily_return").alias("mean"), _spread("daily_return").alias("spread"),
    )
    total = (F.col("last") - F.col("first")) / F.nullif("first", F.lit(0.0))
    return rows.select(
        *keys, "total_trading_days", rounded("first", digits).alias("initial_price"), rounded("last", digits).alias("latest_price"), rounded(total * 100.0, digits).alias("total_return_pct"),
        rounded(total / (F.col("total_trading_days") / float(TRADING_DAYS)) * 100.0, digits).alias("annualized_return_pct"), rounded(F.col("spread") * YEAR * 100.0, digits).alias("annualized_volatility_pct"),
        rounded(_sharpe(F.col("mean"), F.col("spread")), digits).alias("sharpe_ratio"),
    ).orderBy(F.desc("total_return_pct"), "symbol")


def monthly_returns(s: Star, digits: int = 2) -> DataFrame:
    """By asset and month, from the first close of the month to the last."""
    year, month = F.floor(F.col("market_date_key") / 10000).cast("int"), (F.floor(F.col("market_date_key") / 100) % 100).cast("int")
    rows = s.daily("symbol").groupBy("symbol", year.alias("calendar_year"), month.alias("calendar_month")).agg(
        F.min_by("close", "market_date_key").alias("first"), F.max_by("close", "market_date_key").alias("last")
    )
    return rows.select(
        "symbol", "calendar_year", "calendar_month", F.concat_ws("-", F.col("calendar_year").cast("string"), F.lpad(F.col("calendar_month").cast("string"), 2, "0")).alias("year_month"),
        rounded("first", digits).alias("month_open_price"), rounded("last", digits).alias("month_close_price"),
        rounded((F.col("last") - F.col("first")) / F.nullif("first", F.lit(0.0)) * 100.0, digits).alias("monthly_return_pct"),
    )


def volatility_ranking(s: Star, digits: int = 2) -> DataFrame:
    keys = ["symbol", "asset_name", "asset_type", "sector"]
    rows = s.daily(*keys).filter("volatility_20d IS NOT NULL").groupBy(*keys)
    latest = rows.agg(*[F.max_by(c, "market_date_key").alias(c) for c in ("volatility_20d", "volatility_60d")], F.max("market_date_key").alias("day")).withColumn("calendar_date", _calendar_date("day"))
    v = F.col("volatility_20d")
    return latest.select(
        F.dense_rank().over(Window.orderBy(v.desc())).alias("rank_20d"), *keys, rounded(v * 100.0, digits).alias("annualized_volatility_20d_pct"), rounded(F.col("volatility_60d") * 100.0, digits).alias("annualized_volatility_60d_pct"),
        F.col("calendar_date").alias("as_of_date"), _ladder(v, [(0.35, "High Risk / Hyper-Volatile"), (0.20, "Moderate Risk / Core Equity")], True, "Defensive / Low Volatility").alias("volatility_regime_classification"),
    )


def drawdown_analysis(s: Star, digits: int = 2) -> DataFrame:
    """The trough is the first day of the deepest drawdown."""
    keys = ["symbol", "asset_name", "sector"]
    earlier = Window.partitionBy("asset_key").orderBy("market_date_key").rowsBetween(Window.unboundedPreceding, -1)
    lowest = F.min("drawdown").over(earlier)
    new_low = F.col("drawdown").isNotNull() & (lowest.isNull() | (F.col("drawdown") < lowest))
    # The last day that is lower than all before it is the first day of the deepest drawdown.
    rows = s.daily(*keys).withColumn("low_day", F.when(new_low, F.col("market_date_key"))).groupBy(*keys).agg(
        F.min("drawdown").alias("deepest"), F.avg("drawdown").alias("mean"), F.max_by("drawdown", "market_date_key").alias("now"), F.max("low_day").alias("low_day"),
    ).withColumn("max_drawdown_trough_date", _calendar_date("low_day"))
    steps = [(-0.02, "At or Near All-Time High"), (-0.10, "Minor Pullback (2% - 10%)"), (-0.20, "Correction (10% - 20%)")]
    pct = lambda c: rounded(F.col(c) * 100.0, digits)
    return rows.select(
        *keys, pct("deepest").alias("max_drawdown_pct"), "max_drawdown_trough_date", pct("mean").alias("average_drawdown_pct"), pct("now").alias("current_drawdown_pct"),
        _ladder(F.col("now"), steps, False, "Bear Market State (> 20% drawdown)").alias("technical_status"),
    )


def volume_anomalies(s: Star, digits: int = 2, top: int = 50) -> DataFrame:
    """The `top` rows by their volume against its 20-row mean (without warm-up); ties by day and symbol."""
    w = trailing(20, "asset_key", "market_date_key")
    rows = s.daily("symbol", "asset_name").withColumn("mean", F.avg("volume").over(w)).withColumn("times", F.col("volume") / F.nullif("mean", F.lit(0.0))).filter("times > 2.0")
    signal = F.when(F.col("daily_return") > 0.03, "Institutional Accumulation (Surge Up)").when(F.col("daily_return") < -0.03, "Institutional Capitulation (Heavy Selloff)").otherwise("High Volume Consolidation")
    return rows.select(
        "calendar_date", "symbol", "asset_name", "volume", rounded("mean", 0).alias("avg_volume_20d"), rounded("times", digits).alias("volume_ratio"), rounded(F.col("daily_return") * 100.0, digits).alias("daily_return_pct"), signal.alias("anomaly_signal"),
    ).orderBy(F.desc("volume_ratio"), "calendar_date", "symbol").limit(top)


def sector_performance(s: Star, digits: int = 2) -> DataFrame:
    """Equal weights within a sector's day, then statistics over days."""
    days = s.daily("symbol", "sector").groupBy("sector", "calendar_date").agg(F.countDistinct("symbol").alias("assets"), F.avg("daily_return").alias("r"), F.sum("volume").alias("volume"))
    rows = days.groupBy("sector").agg(F.max("assets").alias("asset_count"), F.avg("r").alias("mean"), _spread("r").alias("spread"), F.avg("volume").alias("volume"))
    return rows.select(
        "sector", "asset_count", rounded(F.col("mean") * float(TRADING_DAYS) * 100.0, digits).alias("annualized_return_pct"), rounded(F.col("spread") * YEAR * 100.0, digits).alias("annualized_volatility_pct"),
        rounded(_sharpe(F.col("mean"), F.col("spread")), digits).alias("sector_sharpe_ratio"), rounded(F.col("volume") / 1e6, digits).alias("avg_daily_volume_millions"),
    )


def correlation_summary(s: Star, benchmark: str, digits: int = 2) -> DataFrame:
    """Beta and correlation with the benchmark over common days, from population moments."""
    keys = ["symbol", "asset_name", "sector"]
    base = s.daily("symbol").filter((F.col("symbol") == benchmark) & F.col("daily_return").isNotNull()).select("market_date_key", F.col("daily_return").alias("m"))
    rows = s.daily(*keys).filter("daily_return IS NOT NULL").select("market_date_key", *keys, F.col("daily_return").alias("r")).join(base, "market_date_key")
    stats = rows.groupBy(*keys).agg(F.covar_pop("r", "m").alias("cov"), F.var_pop("m").alias("var_m"), F.stddev_pop("r").alias("sd_r"), F.stddev_pop("m").alias("sd_m"))
    stats = stats.withColumn("beta", F.col("cov") / F.nullif("var_m", F.lit(0.0)))
    b = F.col("beta")
    profile = F.when(F.col("symbol") == benchmark, "Market Benchmark (Beta = 1.0)").when(b > 1.2, "Aggressive High Beta (> 1.2)").when(b.between(0.8, 1.2), "Core Market Correlated").when((b < 0.8) & (b >= 0), "Low Beta Defensive").otherwise("Negative / Inverse Correlated")
    return stats.select(*keys, rounded("beta", digits).alias("market_beta"), rounded(F.col("cov") / F.nullif(F.col("sd_r") * F.col("sd_m"), F.lit(0.0)), digits).alias("correlation_with_spy"), profile.alias("beta_profile"))


def risk_metrics(s: Star, digits: int = 2) -> DataFrame:
    """VaR is the return of rank round(5 % of the days); an asset with fewer than 10 returns has none and is left out."""
    keys = ["symbol", "asset_name", "sector"]
    rows = s.daily(*keys).filter("daily_return IS NOT NULL")
    down = F.sqrt(F.sum(F.when(F.col("daily_return") < 0, F.col("daily_return") * F.col("daily_return")).otherwise(0.0)) / F.nullif(F.count("daily_return").cast("double"), F.lit(0.0)))
    stats = rows.groupBy(*keys).agg(F.avg("daily_return").alias("mean"), F.min("daily_return").alias("worst"), down.alias("down"))
    wanted = rows.groupBy("symbol").agg(F.round(F.count("*") * 0.05).cast("int").alias("rank"))
    var = at_ranks(rows, "daily_return", wanted).select("symbol", F.abs("daily_return").alias("var"))
    pct = lambda x: rounded(x * 100.0, digits)
    return stats.join(var, "symbol").select(
        *keys, pct(F.col("var")).alias("var_95_daily_pct"), pct(F.col("worst")).alias("worst_single_day_pct"), pct(F.col("down") * YEAR).alias("annualized_downside_deviation_pct"),
        rounded(_sharpe(F.col("mean"), F.col("down")), digits).alias("sortino_ratio"),
        _ladder(F.col("var"), [(0.025, "High Tail Risk (> 2.5% daily VaR)"), (0.015, "Moderate Tail Risk (1.5% - 2.5%)")], True, "Low Tail Risk (< 1.5% daily VaR)").alias("tail_risk_classification"),
    )
