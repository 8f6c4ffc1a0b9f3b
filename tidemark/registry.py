"""All queries of the market engine, by name, with the SQL that checks them. Each reads the given tables whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import oracle
from tidemark.functions import series
from tidemark.functions.columns import rounded
from tidemark.functions.lineage import cut
from tidemark.operators import checks, gold, regimes, risk, silver
from tidemark.plans import analytics, models
from tidemark.sources import bars, files

#: Held types of parts, the benchmarks of both kinds of bars, and the ends of the splits.
WEIGHTS = {"STANDARD": 0.35, "ECONOMY": 0.25, "PROMO": 0.20, "SMALL": 0.20}
BENCHMARK, NATION_BENCHMARK = "STANDARD", "NATION_0"
PAIR = ("STANDARD", "ECONOMY")
SPLIT = ("1998-12-31", "2000-06-30", "2001-12-31")
#: Digits at which both engines agree.
DIGITS = 6

Query = Callable[[SparkSession, str], DataFrame]


def _text_dates(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c, t in df.dtypes if t == "date"} | {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c, t in df.dtypes if t.startswith("timestamp")})


def _out(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS, dates as text, whole numbers as long: the same in any engine."""
    df = _text_dates(df)
    return df.select(*[rounded(F.col(f"`{c}`"), DIGITS).alias(c) if t == "double" else F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes])


def _silver_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of types with faults at days that a fixed arithmetic picks, and the order in which they came."""
    b = bars.bars_type(spark, sf_dir)
    n = F.datediff("date", F.lit("1995-01-01"))
    b = b.withColumn("n", n)
    hit = lambda m: F.col("n") % m == 0
    faulty = b.select(
        F.when(hit(101), F.lit(None)).when(hit(41), F.concat(F.lit("  "), F.lower("symbol"), F.lit(" "))).otherwise(F.col("symbol")).alias("symbol"), F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.when(hit(97), -F.col("open")).otherwise(F.col("open")).alias("open"), F.when(hit(79), F.col("low") * 0.5).otherwise(F.col("high")).alias("high"), "low",
        F.when(hit(83), F.lit(None)).otherwise(F.col("close")).alias("close"), "adjusted_close", F.when(hit(89), -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
        F.lit("2026-01-01 00:00:00 UTC").alias("ingestion_timestamp"), F.lit("trades").alias("source"), F.lit("batch-1").alias("batch_id"), (F.col("n") * 100 + F.ascii("symbol")).cast("long").alias("ingest_seq"), "n",
    )
    twice = faulty.filter(hit(53)).withColumn("ingest_seq", F.col("ingest_seq") + 1_000_000).withColumn("volume", F.col("volume") + 7)
    return faulty.unionByName(twice).drop("n")


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes as a feed has them, a column for each symbol and field, and back to a row for each symbol and day."""
    daily, fields = bars.bars_type(spark, sf_dir), ["open", "high", "low", "close", "adjusted_close", "volume"]
    symbols = sorted(r.symbol for r in bars.table(spark, sf_dir, "part").select(F.col("p_type").alias("symbol")).distinct().collect())  # the feed's columns: a few names
    wide = daily.groupBy("date").pivot("symbol", symbols).agg(*[F.max(f).alias(f) for f in fields])
    return files.wide_to_long(wide, symbols, fields)


def _type_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.with_returns(bars.bars_type(spark, sf_dir))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.features(bars.bars_type(spark, sf_dir))


def _stored_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns for results that read them more than once: trades are read for them once."""
    return cut(_type_returns(spark, sf_dir))


def _stored_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(_gold(spark, sf_dir))


def _star(spark: SparkSession, sf_dir: str) -> analytics.Star:
    """Assets, dates and facts all come from the bars, which are made of the trades once."""
    return analytics.Star.of(cut(bars.bars_nation(spark, sf_dir)))


def _frames(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return models.registry.run(models.sources(_star(spark, sf_dir)), *names, digits=DIGITS)


def _gold_query(*columns: str) -> Query:
    return lambda s, d: _out(_gold(s, d).select("symbol", "date", *columns))


def _aggregate(name: str, column) -> Query:
    return lambda s, d: _out(_type_returns(s, d).groupBy("symbol").agg(column().alias(name)))


def _model(name: str) -> Query:
    return lambda s, d: _out(_frames(s, d, name)[name])


def _check(name: str) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        frames = _frames(s, d, "stg_assets", "int_rolling_metrics")
        return checks.count(name, models.tests(frames)[name])

    return query


def _faulty_checks(s: SparkSession, d: str) -> DataFrame:
    """All checks over tables with faults at keys that a fixed arithmetic picks: every one of them finds something."""
    frames = _frames(s, d, "stg_assets", "int_rolling_metrics")
    day, asset = F.col("market_date_key"), F.col("asset_key")
    fact = frames["fact_market_daily"]
    fact = fact.unionByName(fact.filter(day % 29 == 0)).select(
        F.when(day % 19 == 0, F.lit(None)).when(day % 31 == 0, day - 10_000_000).otherwise(day).alias("market_date_key"), F.when(day % 23 == 0, asset + 1_000).otherwise(asset).alias("asset_key")
    )
    assets = frames["stg_assets"]
    assets = assets.unionByName(assets.filter(asset % 5 == 0)).withColumns({"symbol": F.when(asset % 7 != 0, F.col("symbol")), "asset_type": F.when(asset % 6 == 0, "bond").otherwise(F.col("asset_type"))})
    day = F.col("date_key")
    prices = frames["stg_market_prices"].withColumn("close_price", F.when(day % 13 == 0, -F.col("close_price")).otherwise(F.col("close_price")))
    rolling = frames["int_rolling_metrics"].withColumn("drawdown", F.when(day % 17 == 0, 0.5).when(day % 37 == 0, -1.5).otherwise(F.col("drawdown")))
    found = models.tests(frames | {"fact_market_daily": fact, "stg_assets": assets, "stg_market_prices": prices, "int_rolling_metrics": rolling})
    return checks.results(found)


def _monthly_returns(s: SparkSession, d: str) -> DataFrame:
    """Returns of monthly mean prices: they are mild, so that wealth itself can be compared over the whole span."""
    months = bars.bars_type(s, d).groupBy("symbol", F.to_date(F.date_trunc("month", "date")).alias("date")).agg(F.avg("close").alias("close"))
    return cut(risk.with_returns(months))


def _labels(s: SparkSession, d: str) -> DataFrame:
    return regimes.labelled(_gold(s, d), BENCHMARK)


def _split(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return regimes.split(_labels(s, d), *SPLIT)


def _split_counts(s: SparkSession, d: str) -> DataFrame:
    day = F.date_format("date", "yyyy-MM-dd")
    part = F.when(day <= SPLIT[0], "train").when(day <= SPLIT[1], "val").when(day <= SPLIT[2], "test")
    return _out(_labels(s, d).withColumn("part", part).filter("part IS NOT NULL").groupBy("part").agg(F.count("*").alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day")))


def _predictions(s: SparkSession, d: str) -> DataFrame:
    parts = _split(s, d)
    model = regimes.fit(regimes.weighted(parts["train"]), regimes.estimators(1000)["logistic"])
    return model.transform(parts["test"])


def _champion(s: SparkSession, d: str) -> DataFrame:
    """Scores of all three models on the validation part, with a mark for the champion. A row for each model."""
    best, _, scores = regimes.train({name: part.persist() for name, part in _split(s, d).items()})
    return _out(s.createDataFrame([(name, float(x["accuracy"] or 0), float(x["macro_f1"] or 0), name == best) for name, x in sorted(scores.items())], "model string, accuracy double, macro_f1 double, is_champion boolean"))


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "bars_type": lambda s, d: _out(bars.bars_type(s, d)),
        "bars_nation": lambda s, d: _out(bars.bars_nation(s, d)),
        "bars_event": lambda s, d: _out(bars.bars_event(s, d)),
        "quotes_wide_to_long": lambda s, d: _out(_quotes(s, d)),
        "bronze_enrich": lambda s, d: bars.bronze(bars.bars_type(s, d), "trades", "batch-1", "2026-01-01 00:00:00 UTC"),
        "silver_dedup": lambda s, d: _out(silver.first_of_each(_silver_input(s, d))),
        "silver_clean": lambda s, d: _out(silver.Silver(_silver_input(s, d)).clean_and_metrics(cut)[0]),
        "silver_ohlc_reconcile": lambda s, d: _out(silver.Silver(_silver_input(s, d)).clean().select("symbol", "date", "high", "low")),
        "silver_observed_metrics": lambda s, d: _out(silver.Silver(_silver_input(s, d)).clean_and_metrics(cut)[1]),
        "silver_metrics": lambda s, d: _out(silver.Silver(_silver_input(s, d)).metrics()),
        "gold_returns": _gold_query(*gold.RETURNS),
        "gold_volatility": _gold_query(*gold.VOLATILITIES),
        "gold_sma": _gold_query(*gold.AVERAGES, *(f"{x}_ratio" for x in gold.AVERAGES)),
        "gold_volume": _gold_query("avg_volume_20d", "volume_ratio", "is_abnormal_volume"),
        "gold_drawdown": _gold_query("running_max", "drawdown"),
        "gold_momentum": _gold_query(*gold.MOMENTA),
        "gold_cumulative": _gold_query("cumulative_return"),
        "gold_features": lambda s, d: _out(_gold(s, d)),
        "gold_features_ungated": lambda s, d: _out(gold.features(bars.bars_type(s, d), gate=False).select("symbol", "date", *gold.VOLATILITIES, "sma_20", "sma_50")),
        "gold_features_hourly": lambda s, d: _out(gold.features(bars.bars_event(s, d)).select("symbol", "date", "daily_return", "volatility_20d", "sma_50", "volume_ratio", "drawdown")),
        "gold_features_blocks": lambda s, d: _out(gold.features_in_blocks(bars.bars_type(s, d), rows=500)),
        "gold_features_hourly_blocks": lambda s, d: _out(gold.features_in_blocks(bars.bars_event(s, d), rows=300, cell=series.by_days(days=30)).select("symbol", "date", "daily_return", "volatility_20d", "sma_50", "volume_ratio", "drawdown")),
        "dim_asset": lambda s, d: _out(_star(s, d).assets),
        "dim_date": lambda s, d: _out(_star(s, d).dates),
        "fact_market_daily": lambda s, d: _out(_star(s, d).fact),
        "q01_asset_performance": lambda s, d: _out(analytics.asset_performance(_star(s, d), DIGITS)),
        "q02_monthly_returns": lambda s, d: _out(analytics.monthly_returns(_star(s, d), DIGITS)),
        "q03_volatility_ranking": lambda s, d: _out(analytics.volatility_ranking(_star(s, d), DIGITS)),
        "q04_drawdown_analysis": lambda s, d: _out(analytics.drawdown_analysis(_star(s, d), DIGITS)),
        "q05_volume_anomalies": lambda s, d: _out(analytics.volume_anomalies(_star(s, d), DIGITS)),
        "q06_sector_performance": lambda s, d: _out(analytics.sector_performance(_star(s, d), DIGITS)),
        "q07_correlation_summary": lambda s, d: _out(analytics.correlation_summary(_star(s, d), NATION_BENCHMARK, DIGITS)),
        "q08_risk_metrics": lambda s, d: _out(analytics.risk_metrics(_star(s, d), DIGITS)),
        **{name: _model(name) for name in models.registry.models},
        **{name: _check(name) for name in (
            "check_positive_prices", "check_drawdown_bounds", "check_unique_asset_key", "check_unique_fact_key", "check_not_null_symbol", "check_not_null_fact_key", "check_accepted_asset_types", "check_fact_asset", "check_fact_date",
        )},
        "checks_of_faulty_tables": _faulty_checks,
        "q01_two_digits": lambda s, d: _out(analytics.asset_performance(_star(s, d))),
        "q02_two_digits": lambda s, d: _out(analytics.monthly_returns(_star(s, d))),
        "q03_two_digits": lambda s, d: _out(analytics.volatility_ranking(_star(s, d))),
        "q04_two_digits": lambda s, d: _out(analytics.drawdown_analysis(_star(s, d))),
        "q06_two_digits": lambda s, d: _out(analytics.sector_performance(_star(s, d))),
        "q07_two_digits": lambda s, d: _out(analytics.correlation_summary(_star(s, d), NATION_BENCHMARK)),
        "q08_two_digits": lambda s, d: _out(analytics.risk_metrics(_star(s, d))),
        "portfolio_monthly": lambda s, d: _out(risk.portfolio_wealth(risk.portfolio_daily(_monthly_returns(s, d), WEIGHTS)).drop("symbol")),
        "portfolio_monthly_summary": lambda s, d: _out(risk.portfolio_summary(_monthly_returns(s, d), WEIGHTS)),
        "benchmark_wealth_monthly": lambda s, d: _out(risk.benchmark_wealth(_monthly_returns(s, d), WEIGHTS, BENCHMARK)),
        "cagr": _aggregate("cagr", risk.cagr),
        "annualized_vol": _aggregate("annualized_vol", risk.annualized_volatility),
        "sharpe": _aggregate("sharpe", risk.sharpe),
        "sortino": _aggregate("sortino", risk.sortino),
        "downside_dev": _aggregate("downside_dev", risk.downside_deviation),
        "var_hist": lambda s, d: _out(risk.value_at_risk(_stored_returns(s, d))),
        "var_param": _aggregate("var_param", risk.var_parametric),
        "cvar": lambda s, d: _out(risk.cvar(_stored_returns(s, d))),
        "return_moments": lambda s, d: _out(_type_returns(s, d).groupBy("symbol").agg(*risk.moments())),
        "log_returns": lambda s, d: _out(risk.log_returns(bars.bars_type(s, d)).select("symbol", "date", "log_return")),
        "cumulative_returns": lambda s, d: _out(risk.cumulative_returns(_type_returns(s, d)).select("symbol", "date", "cumulative_return")),
        "parkinson_vol": lambda s, d: _out(risk.parkinson(bars.bars_type(s, d)).select("symbol", "date", "parkinson_vol")),
        "rolling_vol": lambda s, d: _out(risk.rolling_volatility(_type_returns(s, d)).select("symbol", "date", "rolling_vol")),
        **{f"periodic_returns_{p[0]}": (lambda s, d, p=p: _out(risk.periodic_returns(bars.bars_type(s, d), p))) for p in ("week", "month", "year")},
        "max_drawdown_path": lambda s, d: _out(risk.max_drawdown_path(bars.bars_type(s, d))),
        "momentum_rank": lambda s, d: _out(risk.momentum_ranking(bars.bars_type(s, d))),
        "corr_pearson": lambda s, d: _out(risk.correlations(_stored_returns(s, d))),
        "corr_spearman": lambda s, d: _out(risk.correlations(_stored_returns(s, d), "spearman")),
        "rolling_corr": lambda s, d: _out(risk.rolling_correlation(_type_returns(s, d), *PAIR)),
        "rolling_corr_full_window": lambda s, d: _out(risk.rolling_correlation(_type_returns(s, d), *PAIR, least=60)),
        "portfolio_daily": lambda s, d: _out(risk.portfolio_wealth(risk.portfolio_daily(_stored_returns(s, d), WEIGHTS)).drop("symbol", "wealth")),
        "portfolio_summary": lambda s, d: _out(risk.portfolio_summary(_stored_returns(s, d), WEIGHTS).drop("total_return", "cagr")),
        "portfolio_risk_decomposition": lambda s, d: _out(risk.risk_decomposition(_type_returns(s, d), WEIGHTS)),
        "performance_scorecard": lambda s, d: _out(risk.performance_scorecard(_gold(s, d))),
        "risk_scorecard": lambda s, d: _out(risk.risk_scorecard(_gold(s, d))),
        "top_bottom_leaders": lambda s, d: _out(risk.leaders(risk.performance_scorecard(_stored_gold(s, d)), k=2)),
        "market_kpis": lambda s, d: _out(risk.market_kpis(_stored_gold(s, d), BENCHMARK)),
        "benchmark_wealth": lambda s, d: _out(risk.benchmark_wealth(_stored_returns(s, d), WEIGHTS, BENCHMARK).drop("portfolio_wealth", "benchmark_wealth")),
        "returns_pivot": lambda s, d: _out(risk.returns_pivot(_type_returns(s, d), sorted(WEIGHTS))),
        "data_profile": lambda s, d: _out(bars.bars_type(s, d).groupBy("symbol").agg(F.count("*").alias("n"), F.min("close").alias("min_close"), F.max("close").alias("max_close"), F.avg("close").alias("mean_close"))),
        "regime_labels": lambda s, d: _out(_labels(s, d).select("date", "regime_target", "regime_label")),
        "regime_split_counts": _split_counts,
        "regime_distribution": lambda s, d: _out(_labels(s, d).groupBy("regime_target", "regime_label").agg(F.count("*").alias("n"))),
        "majority_baseline": lambda s, d: _out(regimes.majority(_split(s, d)["train"]).select("regime_target", F.col("count").alias("n"))),
        "regime_predictions": lambda s, d: _out(_predictions(s, d).select("date", "regime_target", F.col("prediction").cast("int").alias("prediction"))),
        "confusion_matrix": lambda s, d: _out(regimes.confusion(_predictions(s, d))),
        "regime_champion": _champion,
        "momentum_of_one": lambda s, d: _out(risk.momentum(bars.bars_type(s, d), BENCHMARK, 63)),
        "regime_scores": lambda s, d: _out(regimes.macro_scores(regimes.confusion(_predictions(s, d)))),
    }
    return q


def oracle_sql() -> dict[str, str]:
    return oracle.statements(WEIGHTS, BENCHMARK, NATION_BENCHMARK, PAIR, SPLIT)
