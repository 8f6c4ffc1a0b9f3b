"""Risk and performance of return series, grouped by symbol: aggregates and windows, no driver loops.

Inputs are long frames with symbol, date, close and (where returns are asked for) daily_return. Dispersion is that of a
sample here; the SQL models use that of a population.
"""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import RISK_FREE, TRADING_DAYS, YEAR, change, ordered, ratio, so_far, trailing
from tidemark.functions.quantiles import quantile

R = "daily_return"


def with_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn(R, change("close"))


def log_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("log_return", F.ln(ratio("close", F.lag("close").over(ordered()))))


def cumulative_returns(returns: DataFrame) -> DataFrame:
    """Product of 1 + return so far, less 1; a missing return counts as 0."""
    growth = F.product(1 + F.coalesce(F.col(R), F.lit(0.0))).over(so_far())
    return returns.withColumn("cumulative_return", growth - 1)


# --- aggregates of one series: columns for groupBy("symbol").agg(...) ---


def cagr() -> Column:
    """From the first and last price over the number of prices; 0 with fewer than two prices or a first price of 0 or less."""
    n, first, last = F.count("close"), F.min_by("close", "date"), F.max_by("close", "date")
    return F.when((n < 2) | (first <= 0), 0.0).otherwise(F.pow(last / F.nullif(first, F.lit(0.0)), TRADING_DAYS / F.nullif(n, F.lit(0))) - 1)


def _least(n: int, what: Column) -> Column:
    return F.when(F.count(R) < n, 0.0).otherwise(F.coalesce(what, F.lit(0.0)))


def annualized_volatility() -> Column:
    return _least(2, F.stddev_samp(R) * YEAR)


def sharpe(risk_free: float = RISK_FREE) -> Column:
    std = F.stddev_samp(R)
    return _least(2, F.when(std > 0, YEAR * (F.avg(R) - risk_free / TRADING_DAYS) / F.nullif(std, F.lit(0.0))))


def downside_deviation(least: float = 0.0) -> Column:
    below = F.when(F.col(R).isNotNull(), F.least(F.col(R) - least, F.lit(0.0)))
    return _least(2, F.sqrt(F.avg(F.pow(below, F.lit(2.0))) * TRADING_DAYS))


def sortino(risk_free: float = RISK_FREE) -> Column:
    down = downside_deviation(risk_free / TRADING_DAYS)
    return _least(2, F.when(down > 0, (F.avg(R) * TRADING_DAYS - risk_free) / F.nullif(down, F.lit(0.0))))


def var_historical(level: float = 0.95) -> Column:
    return _least(10, F.abs(F.percentile(R, F.lit(round(1 - level, 10)))))


def var_parametric(level: float = 0.95) -> Column:
    return _least(10, F.abs(F.avg(R) - NormalDist().inv_cdf(level) * F.stddev_samp(R)))


def moments() -> list[Column]:
    """Count, skewness, excess kurtosis (of a population), and the Jarque-Bera statistic with its p-value."""
    n, s, k = F.count(R), F.skewness(R), F.kurtosis(R)
    jb = n / 6.0 * (s * s + k * k / 4.0)
    return [n.alias("n"), s.alias("skewness"), k.alias("excess_kurtosis"), jb.alias("jarque_bera"), F.exp(-jb / 2.0).alias("p_value")]


def value_at_risk(returns: DataFrame, level: float = 0.95) -> DataFrame:
    """symbol, var_hist: as var_historical, for series of any length: no task holds all returns of a symbol. 0 with fewer than 10 returns."""
    cut = quantile(returns, R, round(1 - level, 10), name="cut")
    return _all_symbols(returns, cut.select("symbol", F.when(F.col("n") < 10, 0.0).otherwise(F.abs("cut")).alias("var_hist")))


def cvar(returns: DataFrame, level: float = 0.95) -> DataFrame:
    """symbol, cvar: the mean of returns at or below the quantile; 0 with fewer than 10 returns. The tail is an aggregate, and the quantile one of refined counts."""
    cut = quantile(returns, R, round(1 - level, 10), name="cut")
    tail = returns.join(cut, "symbol").filter(F.col(R) <= F.col("cut")).groupBy("symbol").agg(F.when(F.max("n") < 10, 0.0).otherwise(F.abs(F.avg(R))).alias("cvar"))
    return _all_symbols(returns, tail)


def _all_symbols(returns: DataFrame, found: DataFrame) -> DataFrame:
    """Symbols without returns too, with 0."""
    own = next(c for c in found.columns if c != "symbol")
    return returns.select("symbol").distinct().join(found, "symbol", "left").select("symbol", F.coalesce(own, F.lit(0.0)).alias(own))


def parkinson(bars: DataFrame, n: int = 20) -> DataFrame:
    """Annualised volatility of the range of prices over n rows, of which max(5, n // 2) need a value."""
    x = F.pow(F.ln(ratio("high", "low")), F.lit(2.0))
    log4 = 4 * 0.6931471805599453
    mean = F.when(F.count("_x").over(trailing(n)) >= max(5, n // 2), F.avg("_x").over(trailing(n)))
    return bars.withColumn("_x", x).withColumn("parkinson_vol", F.sqrt(mean * (TRADING_DAYS / log4))).drop("_x")


def rolling_volatility(returns: DataFrame, n: int = 20) -> DataFrame:
    enough = F.count(R).over(trailing(n)) >= max(5, n // 2)
    return returns.withColumn("rolling_vol", F.when(enough, F.stddev_samp(R).over(trailing(n)) * YEAR))


def periodic_returns(bars: DataFrame, period: str) -> DataFrame:
    """symbol, period_end, period_return of the last prices of weeks (to Sunday), months or years: 'week', 'month', 'year'.

    A period without prices stays null, so the next one has no return; a spine of all periods between the first and the last holds the places.
    """
    ends = {"week": lambda d: F.date_add(F.date_trunc("week", d), 6), "month": lambda d: F.last_day(d), "year": lambda d: F.make_date(F.year(d), F.lit(12), F.lit(31))}
    steps = {"week": "interval 1 week", "month": "interval 1 month", "year": "interval 1 year"}
    start = lambda d: F.to_date(F.date_trunc(period, d))
    last = bars.groupBy("symbol", start(F.col("date")).alias("start")).agg(F.max_by("close", "date").alias("price"))
    spine = last.groupBy("symbol").agg(F.sequence(F.min("start"), F.max("start"), F.expr(steps[period])).alias("starts")).select("symbol", F.explode("starts").alias("start"))
    w = Window.partitionBy("symbol").orderBy("start")
    before = F.lag("price").over(w)
    return spine.join(last, ["symbol", "start"], "left").select(
        "symbol", F.to_date(ends[period](F.col("start"))).alias("period_end"), ((F.col("price") - before) / F.nullif(before, F.lit(0.0))).alias("period_return")
    ).filter("period_return IS NOT NULL")


def max_drawdown_path(bars: DataFrame) -> DataFrame:
    """Deepest drawdown of each symbol with its peak, trough, recovery (or 'Unrecovered') and rows from the peak on. Ties go to the first day.

    One sort of the series carries all that is known so far: the peak and where it was first reached, and the place of the last row below all rows before it,
    which at the end is the trough. Rows are then grouped by that place, so the recovery is the first row at the peak within the last group. Nothing is read again,
    and groups and symbols lie where the windows have put them. A symbol without a drawdown (no prices, peaks of 0) is left out.
    """
    before = ordered().rowsBetween(Window.unboundedPreceding, -1)
    highest, lowest = F.max("close").over(before), F.min("dd").over(before)
    rows = bars.select("symbol", "date", "close", F.max("close").over(so_far()).alias("peak"), F.row_number().over(ordered()).alias("n"), (F.col("close").isNotNull() & (highest.isNull() | (F.col("close") > highest))).alias("new_peak"))
    rows = rows.withColumns({"dd": (F.col("close") - F.col("peak")) / F.nullif("peak", F.lit(0.0)), "peak_n": F.max(F.when(F.col("new_peak"), F.col("n"))).over(so_far()), "peak_date": F.max(F.when(F.col("new_peak"), F.col("date"))).over(so_far())})
    rows = rows.withColumn("new_low", F.col("dd").isNotNull() & (lowest.isNull() | (F.col("dd") < lowest))).withColumn("low_n", F.max(F.when(F.col("new_low"), F.col("n"))).over(so_far()))
    low, high = F.col("n") == F.col("low_n"), F.col("close") >= F.col("peak")
    at_low = {c: F.max(F.when(low, F.col(x))) for c, x in (("max_drawdown", "dd"), ("trough", "date"), ("peak", "peak_date"), ("from_n", "peak_n"))}
    lows = rows.filter("low_n IS NOT NULL").groupBy("symbol", "low_n").agg(
        *[x.alias(c) for c, x in at_low.items()], F.min(F.when(high, F.col("date"))).alias("recovery"), F.min(F.when(high, F.col("n"))).alias("to_n"), F.max("n").alias("last_n")
    )
    # A missing recovery must not give way to that of an earlier low, so that the last low's values are picked with their nulls.
    last = lows.groupBy("symbol").agg(*[F.max_by(c, "low_n").alias(c) for c in (*at_low, "recovery", "to_n")], F.max("last_n").alias("last_n"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return last.select(
        "symbol", F.round("max_drawdown", 4).alias("max_drawdown"), text("peak").alias("peak_date"), text("trough").alias("trough_date"), F.coalesce(text("recovery"), F.lit("Unrecovered")).alias("recovery_date"),
        (F.coalesce("to_n", "last_n") - F.col("from_n") + 1).cast("long").alias("duration_rows"),
    )


def momentum_ranking(bars: DataFrame, horizons: dict[str, int] | None = None) -> DataFrame:
    """Momenta of the last row of each symbol in per cent; null where the series is too short."""
    horizons = horizons or {"momentum_1m": 21, "momentum_3m": 63, "momentum_6m": 126, "momentum_12m": 252}
    rows = bars.select("symbol", "date", *[(change("close", n) * 100.0).alias(name) for name, n in horizons.items()])
    return rows.groupBy("symbol").agg(*[F.max_by(name, "date").alias(name) for name in horizons])


def momentum(bars: DataFrame, symbol: str, lookback: int) -> DataFrame:
    """One row: the change of one asset's last price against that `lookback` rows before; 0.0 with too few rows or a first price of 0."""
    own = bars.filter(F.col("symbol") == symbol).select("symbol", "date", change("close", lookback).alias("m"))
    return own.agg(F.coalesce(F.max_by("m", "date"), F.lit(0.0)).alias("momentum"))


#: Symbols of a block of the correlation matrix, and days that a task holds of two blocks: 2 * 64 * 1,024 numbers.
BLOCK_SYMBOLS, BLOCK_DAYS = 64, 1_024
_MOMENTS = ["n", "x", "y", "xx", "yy", "xy"]


def _co_moments(values: DataFrame, symbols: int, days: int) -> DataFrame:
    """symbol_a <= symbol_b and sums over the days that both have: n, x, y, xx, yy, xy.

    The matrix is made in blocks: a value goes to the pairs of blocks that its symbol's block is in (one of them, up to `symbols` symbols), cut by time. A task turns
    what it gets into two dense matrices and multiplies them; sums of the cuts are added. No value meets another in a join.
    """
    index = values.groupBy("symbol").agg(F.avg("v").alias("mean")).withColumn("s", F.row_number().over(Window.orderBy("symbol")) - 1)  # one row for each symbol
    index = index.withColumn("blocks", F.floor((F.count("*").over(Window.partitionBy(F.lit(0))) + symbols - 1) / symbols).cast("int"))
    own = F.floor(F.col("s") / symbols).cast("int")
    # Values are taken from their symbol's mean: sums of squares keep their digits, and correlations don't see it.
    rows = values.join(index, "symbol").select("s", F.datediff("date", F.lit("1970-01-01")).alias("day"), (F.col("v") - F.col("mean")).alias("v"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("s", "day", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.floor(F.col("day") / days).alias("part"))

    def multiply(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        i, j = key[0].as_py(), key[1].as_py()
        names, s = np.unique(table.column("s").to_numpy(), return_inverse=True)
        dates, d = np.unique(table.column("day").to_numpy(), return_inverse=True)
        x, has = np.zeros((len(dates), len(names))), np.zeros((len(dates), len(names)))
        x[d, s], has[d, s] = table.column("v").to_numpy(), 1.0
        square = x * x
        sums = {"n": has.T @ has, "x": x.T @ has, "y": has.T @ x, "xx": square.T @ has, "yy": has.T @ square, "xy": x.T @ x}
        a, b = np.nonzero((names[:, None] // symbols == i) & (names[None, :] // symbols == j) & (names[:, None] <= names[None, :]) & (sums["n"] > 0))
        return pa.table({"a": names[a].astype(np.int32), "b": names[b].astype(np.int32)} | {c: sums[c][a, b] for c in _MOMENTS})

    parts = rows.groupBy("i", "j", "part").applyInArrow(multiply, "a int, b int, " + ", ".join(f"{c} double" for c in _MOMENTS))
    sums = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in _MOMENTS])
    name = lambda c: index.select(F.col("s").alias(c), F.col("symbol").alias(f"symbol_{c}"))
    return sums.join(name("a"), "a").join(name("b"), "b").select("symbol_a", "symbol_b", *_MOMENTS)


def correlations(returns: DataFrame, method: str = "pearson", symbols: int = BLOCK_SYMBOLS, days: int = BLOCK_DAYS) -> DataFrame:
    """symbol_a, symbol_b, correlation over the days that both have; null with fewer than two, or for a series that doesn't change.

    A day's return of a symbol is one row. Both methods work on pairs a <= b and mirror them. Spearman's is that of mean ranks among the pair's own days, which differ from pair to pair where
    days are missing; so its values do meet by day.
    """
    values = returns.select("date", "symbol", F.col(R).alias("v")).filter("v IS NOT NULL")
    if method == "spearman":
        x, y = values.select("date", F.col("symbol").alias("symbol_a"), F.col("v").alias("a")), values.select("date", F.col("symbol").alias("symbol_b"), F.col("v").alias("b"))
        pairs = x.join(y, "date").filter("symbol_a <= symbol_b")
        mean_rank = lambda c: F.rank().over(Window.partitionBy("symbol_a", "symbol_b").orderBy(c)) + (F.count("*").over(Window.partitionBy("symbol_a", "symbol_b", c)) - 1) / 2.0
        ranked = pairs.select("symbol_a", "symbol_b", mean_rank("a").alias("a"), mean_rank("b").alias("b"))
        half = ranked.groupBy("symbol_a", "symbol_b").agg(F.when(F.count("*") >= 2, F.corr("a", "b")).alias("correlation"))
    else:
        n, x, y, xx, yy, xy = map(F.col, _MOMENTS)
        spread = F.sqrt(F.greatest(n * xx - x * x, F.lit(0.0))) * F.sqrt(F.greatest(n * yy - y * y, F.lit(0.0)))
        half = _co_moments(values, symbols, days).select("symbol_a", "symbol_b", F.when(n >= 2, (n * xy - x * y) / F.nullif(spread, F.lit(0.0))).alias("correlation"))
    twice = F.explode(F.when(F.col("symbol_a") == F.col("symbol_b"), F.array(F.struct("symbol_a", "symbol_b"))).otherwise(F.array(F.struct("symbol_a", "symbol_b"), F.struct(F.col("symbol_b").alias("symbol_a"), F.col("symbol_a").alias("symbol_b")))))
    return half.select(twice.alias("p"), "correlation").select("p.symbol_a", "p.symbol_b", "correlation")


def rolling_correlation(returns: DataFrame, a: str, b: str, n: int = 60, least: int | None = None) -> DataFrame:
    """date, rolling_corr of two symbols over n common days, of which n // 2 (or `least`) are needed."""
    x = returns.filter(F.col("symbol") == a).select("date", F.col(R).alias("a")).filter("a IS NOT NULL")
    y = returns.filter(F.col("symbol") == b).select("date", F.col(R).alias("b")).filter("b IS NOT NULL")
    w = Window.partitionBy("pair").orderBy("date").rowsBetween(-(n - 1), 0)
    joined = x.join(y, "date").withColumn("pair", F.lit(f"{a}/{b}"))
    return joined.select("date", F.when(F.count("*").over(w) >= (n // 2 if least is None else least), F.corr("a", "b").over(w)).alias("rolling_corr"))


# --- portfolios ---


def portfolio_daily(returns: DataFrame, weights: dict[str, float]) -> DataFrame:
    """date, portfolio_return on days when all held symbols have a return; weights of known symbols sum to 1."""
    spark = returns.sparkSession
    known = returns.select("symbol").distinct().join(F.broadcast(spark.createDataFrame(list(weights.items()), "symbol string, weight double")), "symbol")
    total = known.agg(F.sum("weight").alias("total"), F.count("*").alias("held"))
    shares = known.join(F.broadcast(total)).select("symbol", (F.col("weight") / F.nullif("total", F.lit(0.0))).alias("w"), "held")
    rows = returns.filter(f"{R} IS NOT NULL").join(F.broadcast(shares), "symbol")
    return rows.groupBy("date").agg(F.sum(F.col("w") * F.col(R)).alias("portfolio_return"), F.count("*").alias("n"), F.first("held").alias("held")).filter("n = held").select("date", "portfolio_return")


def _wealth(log: str, r: Column, daily: DataFrame) -> DataFrame:
    """Adds the sum of logarithms of 1 + r so far, and whether a day has lost everything by then."""
    w = so_far()
    return daily.withColumn(f"log_{log}", F.sum(F.ln(1 + r)).over(w)).withColumn(f"_lost_{log}", F.coalesce(F.min(1 + r).over(w) <= 0, F.lit(False)))


def portfolio_wealth(daily: DataFrame) -> DataFrame:
    """Adds log_wealth, wealth (product of 1 + return) and drawdown of it. One series: a single ordered window, a row for each day.

    Sums of logarithms hold any horizon. A day that loses everything has no logarithm: from there on wealth is 0 and the drawdown -1.
    """
    one = _wealth("wealth", F.col("portfolio_return"), daily.withColumn("symbol", F.lit("portfolio")))
    lost = F.col("_lost_wealth")
    return one.withColumn("wealth", F.when(lost, 0.0).otherwise(F.exp("log_wealth"))).withColumn(
        "drawdown", F.when(lost, -1.0).otherwise(F.exp(F.col("log_wealth") - F.max("log_wealth").over(so_far())) - 1)
    ).drop("_lost_wealth")


def portfolio_summary(returns: DataFrame, weights: dict[str, float], risk_free: float = RISK_FREE, level: float = 0.95) -> DataFrame:
    """One row: return, volatility, Sharpe, Sortino, drawdown, VaR and CVaR of the portfolio. Its days are a list within one row. Growth a year of a single day is 0."""
    wealth = portfolio_wealth(portfolio_daily(returns, weights)).withColumnRenamed("portfolio_return", R)
    main = wealth.groupBy("symbol").agg(
        F.count("*").alias("days"), F.max_by("log_wealth", "date").alias("log_wealth"), (F.max_by("log_wealth", "date") * TRADING_DAYS / F.count("*")).alias("log_growth"),
        annualized_volatility().alias("annualized_volatility"), sharpe(risk_free).alias("sharpe"), sortino(risk_free).alias("sortino"), F.min("drawdown").alias("max_drawdown"), var_historical(level).alias("var_95"),
        F.percentile(R, F.lit(round(1 - level, 10))).alias("_cut"), F.collect_list(R).alias("_all"), (F.min("wealth") <= 0).alias("_lost"),
    )
    tail = F.filter("_all", lambda x: x <= F.col("_cut"))
    mean = F.abs(F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(tail), F.lit(0)))
    out = main.withColumn("cvar_95", F.when(F.size("_all") < 10, 0.0).otherwise(F.coalesce(mean, F.lit(0.0))))
    grown = lambda c: F.when(F.col("_lost"), -1.0).otherwise(F.exp(c) - 1)
    return out.withColumn("total_return", grown("log_wealth")).withColumn("cagr", F.when(F.col("days") < 2, 0.0).otherwise(grown("log_growth"))).drop("symbol", "_cut", "_all", "_lost")


def risk_decomposition(returns: DataFrame, weights: dict[str, float], scale: float = TRADING_DAYS) -> DataFrame:
    """symbol, weight, marginal and component risk and its share in per cent (Euler's: the covariance with the portfolio), from one scan of the returns.

    A day becomes one row with a column for each held symbol. Days are summed by which of the symbols have a return, as counts, sums and sums of products:
    a row for each such pattern. Only then is it known which symbols occur at all, and the patterns that have all of these make up the covariances.
    """
    names = list(weights)
    places = range(len(names))
    pairs = [(i, j) for i in places for j in places if i <= j]
    own = lambda i, x: F.max(F.when(F.col("symbol") == names[i], x))
    days = returns.filter(F.col("symbol").isin(names)).groupBy("date").agg(*[own(i, F.col(R)).alias(f"r{i}") for i in places], *[own(i, F.lit(1)).alias(f"k{i}") for i in places])
    sums = days.groupBy(*[F.col(f"r{i}").isNotNull().alias(f"has{i}") for i in places]).agg(
        F.count("*").alias("n"), *[F.max(f"k{i}").alias(f"k{i}") for i in places], *[F.sum(F.coalesce(F.col(f"r{i}"), F.lit(0.0))).alias(f"s{i}") for i in places],
        *[F.sum(F.coalesce(F.col(f"r{i}") * F.col(f"r{j}"), F.lit(0.0))).alias(f"m{i}_{j}") for i, j in pairs],
    )
    every = Window.partitionBy(F.lit(0))  # a row for each pattern
    sums = sums.withColumns({f"known{i}": F.max(f"k{i}").over(every).isNotNull() for i in places})
    whole = sums.filter(reduce(lambda x, y: x & y, [F.col(f"has{i}") | ~F.col(f"known{i}") for i in places]))
    one = whole.agg(F.sum("n").alias("n"), *[F.first(f"known{i}").alias(f"known{i}") for i in places], *[F.sum(c).alias(c) for c in [f"s{i}" for i in places] + [f"m{i}_{j}" for i, j in pairs]])
    total = reduce(lambda x, y: x + y, [F.when(F.col(f"known{i}"), float(weights[names[i]])).otherwise(0.0) for i in places])
    one = one.withColumns({f"w{i}": F.when(F.col(f"known{i}"), float(weights[names[i]])).otherwise(0.0) / F.nullif(total, F.lit(0.0)) for i in places})
    n = F.col("n")

    def covariance(i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        return (F.col(f"m{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / n) / F.nullif(n - 1, F.lit(0)) * scale

    one = one.withColumns({f"c{i}": reduce(lambda x, y: x + y, [F.col(f"w{j}") * covariance(i, j) for j in places]) for i in places})
    one = one.withColumn("sigma", F.sqrt(F.greatest(reduce(lambda x, y: x + y, [F.col(f"w{i}") * F.col(f"c{i}") for i in places]), F.lit(0.0))))
    rows = one.select("sigma", F.inline(F.array(*[F.struct(F.lit(s).alias("symbol"), F.col(f"known{i}").alias("known"), F.col(f"w{i}").alias("weight"), F.col(f"c{i}").alias("cov")) for i, s in enumerate(names)])))
    out = rows.filter("known").withColumn("marginal_risk", F.col("cov") / F.nullif("sigma", F.lit(0.0))).withColumn("component_risk", F.col("weight") * F.col("marginal_risk"))
    return out.select("symbol", "weight", "marginal_risk", "component_risk", (F.col("component_risk") / F.nullif("sigma", F.lit(0.0)) * 100.0).alias("share_pct"))


# --- boards ---


def performance_scorecard(gold: DataFrame) -> DataFrame:
    first, last = F.min_by("close", "date"), F.max_by("close", "date")
    return gold.groupBy("symbol").agg(
        ((last - first) / F.nullif(first, F.lit(0.0)) * 100.0).alias("total_return_pct"), (cagr() * 100.0).alias("cagr_pct"), (annualized_volatility() * 100.0).alias("annualized_vol_pct"),
        sharpe().alias("sharpe_ratio"), (F.min("drawdown") * 100.0).alias("max_drawdown_pct"),
    )


def risk_scorecard(gold: DataFrame) -> DataFrame:
    main = gold.groupBy("symbol").agg(
        (annualized_volatility() * 100.0).alias("annualized_vol_pct"), sharpe().alias("sharpe_ratio"), sortino().alias("sortino_ratio"), (F.min("drawdown") * 100.0).alias("max_drawdown_pct"),
        (var_historical() * 100.0).alias("var_95_pct"), (F.min(R) * 100.0).alias("worst_day_pct"),
    )
    return main.join(cvar(gold), "symbol").withColumn("cvar_95_pct", F.col("cvar") * 100.0).drop("cvar")


def leaders(scorecard: DataFrame, by: str = "total_return_pct", k: int = 4) -> DataFrame:
    """The k best and the k worst (a report's top rows)."""
    best = scorecard.orderBy(F.desc(by), "symbol").limit(k).withColumn("side", F.lit("top"))
    return best.unionByName(scorecard.orderBy(F.asc(by), F.desc("symbol")).limit(k).withColumn("side", F.lit("bottom")))


def market_kpis(gold: DataFrame, benchmark: str) -> DataFrame:
    own = gold.filter(F.col("symbol") == benchmark)
    first, last = F.min_by("close", "date"), F.max_by("close", "date")
    kpis = own.agg(last.alias("latest_close"), (F.max_by("volatility_20d", "date") * 100.0).alias("latest_vol_pct"), ((last - first) / F.nullif(first, F.lit(0.0)) * 100.0).alias("return_pct"), F.count("*").alias("sessions"))
    return kpis.join(F.broadcast(gold.agg(F.countDistinct("symbol").alias("assets"), F.count("*").alias("rows_total"))))


def benchmark_wealth(returns: DataFrame, weights: dict[str, float], benchmark: str) -> DataFrame:
    """Wealth of a portfolio and of the benchmark over the portfolio's days."""
    daily = portfolio_daily(returns, weights)
    both = daily.join(returns.filter(F.col("symbol") == benchmark).select("date", F.col(R).alias("b")), "date").withColumn("symbol", F.lit("all"))
    logs = _wealth("benchmark", F.coalesce("b", F.lit(0.0)), _wealth("portfolio", F.col("portfolio_return"), both))
    wealth = lambda c: F.when(F.col(f"_lost_{c}"), 0.0).otherwise(F.exp(f"log_{c}")).alias(f"{c}_wealth")
    return logs.select("date", "log_portfolio", "log_benchmark", wealth("portfolio"), wealth("benchmark"))


def returns_pivot(returns: DataFrame, symbols: list[str]) -> DataFrame:
    return returns.groupBy("date").pivot("symbol", symbols).agg(F.first(R))
