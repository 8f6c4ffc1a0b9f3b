"""Known values of the market engine, and edge cases of its operators."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import percentage_change, rounded
from tidemark.operators import checks, gold, regimes, risk, silver, star
from tidemark.plans import analytics, models, pipeline
from tidemark.sources import bars, files, publication
from tidemark.streaming.bars import hourly_bars

BARS = "symbol string, date string, open double, high double, low double, close double, adjusted_close double, volume long"
BRONZE = BARS + ", ingestion_timestamp string, source string, batch_id string, ingest_seq long"


def bronze(spark, rows):
    return spark.createDataFrame([(*r, "t", "s", "b", i) for i, r in enumerate(rows)], BRONZE)


def series(spark, prices, symbol="A", start="2024-01-01"):
    first = datetime.date.fromisoformat(start)
    rows = [(symbol, str(first + datetime.timedelta(days=i)), p, p, p, p, p, 100) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, BARS).withColumn("date", F.to_date("date"))


def one(df):
    return df.first().asDict()


# --- cleaning ---


def test_duplicates_go_and_the_first_stays(spark):
    rows = [
        ("AAPL", "2024-01-02", 185.0, 187.0, 184.0, 186.5, 186.0, 50000000), ("AAPL", "2024-01-02", 185.0, 187.0, 184.0, 186.5, 186.0, 50000000), ("AAPL", "2024-01-03", 186.0, 188.0, 185.0, 187.5, 187.0, 48000000),
        ("MSFT", "2024-01-02", 370.0, 374.0, 368.0, 372.5, 372.0, 25000000), ("MSFT", "2024-01-03", 375.0, 378.0, 372.0, 377.0, 376.5, 26000000),
    ]
    s = silver.Silver(bronze(spark, rows))
    m = one(s.metrics())
    assert m["duplicate_records_removed"] == 1 and s.clean().count() == 4 and m["quality_pass_rate_pct"] == 80.0
    assert s.clean().groupBy("symbol", "date").count().filter("count > 1").count() == 0 and s.clean().columns == files.SILVER_COLUMNS


def test_faulty_prices_volumes_and_ranges(spark):
    s = silver.Silver(bronze(spark, [("A", f"2024-01-0{i}", o, h, lo, c, c, 1000) for i, (o, h, lo, c) in enumerate([(180.0, 185.0, 179.0, 183.0), (-10.0, 185.0, 175.0, 182.0), (182.0, 0.0, 180.0, 181.0)], 1)]))
    assert one(s.metrics())["non_positive_price_records"] == 2 and s.clean().count() == 1
    s = silver.Silver(bronze(spark, [("A", "2024-01-01", 1.0, 1.0, 1.0, 1.0, 1.0, -5000)]))
    assert one(s.metrics())["negative_volume_records"] == 1 and s.clean().first().volume == 0
    s = silver.Silver(bronze(spark, [("A", "2024-01-01", 100.0, 95.0, 105.0, 102.0, 102.0, 1)]))
    row = s.clean().first()
    assert one(s.metrics())["invalid_ohlc_relationships_reconciled"] == 1 and row.high >= 102 and row.low <= 100


def test_small_range_faults_are_mended_only_beside_a_real_one(spark):
    small = ("A", "2024-01-01", 100.0, 99.9995, 99.0, 99.0, 99.0, 1)
    assert silver.Silver(bronze(spark, [small])).clean().first().high == 99.9995
    both = silver.Silver(bronze(spark, [small, ("B", "2024-01-01", 100.0, 95.0, 105.0, 102.0, 102.0, 1)])).clean()
    assert both.filter("symbol = 'A'").first().high == 100.0


def test_missing_values_and_names(spark):
    rows = [("A", "2024-01-01", 1.0, 1.0, 1.0, None, 1.0, 1), (None, "2024-01-01", 1.0, 1.0, 1.0, 1.0, 1.0, 1), (" aapl \t", "2024-01-02", 1.0, 1.0, 1.0, 1.0, None, None), ("AAPL", "2024-01-02", 2.0, 2.0, 2.0, 2.0, 2.0, 1)]
    s = silver.Silver(bronze(spark, rows))
    out = s.clean().collect()
    assert [r.symbol for r in out] == ["AAPL", "AAPL"] and {r.volume for r in out} == {None, 1}
    m = one(s.metrics())
    assert m["missing_close_prices"] == 1 and m["missing_volumes"] == 1 and m["duplicate_records_removed"] == 0
    assert "FOUND" in silver.report(m)


def test_empty_input(spark):
    s = silver.Silver(bronze(spark, []))
    m = one(s.metrics())
    assert s.clean().count() == 0 and m["total_rows_ingested"] == 0 and m["quality_pass_rate_pct"] is None
    assert gold.features(spark.createDataFrame([], BARS)).count() == 0


# --- features ---


def test_features_start_where_windows_have_enough(spark):
    draw = random.Random(42)
    price, prices = 100.0, []
    for _ in range(300):
        price *= 1 + draw.gauss(0, 0.02)
        prices.append(price)
    df = gold.features(series(spark, prices)).orderBy("date")
    assert len(gold.FEATURES) == 22 and set(gold.FEATURES) <= set(df.columns) and df.count() == 300
    rows = df.collect()
    first = lambda c: next(i for i, r in enumerate(rows, 1) if r[c] is not None)
    assert {c: first(c) for c in ("daily_return", "volatility_20d", "volatility_60d", "sma_20", "sma_50", "sma_200", "momentum_6m", "momentum_12m")} == {
        "daily_return": 2, "volatility_20d": 11, "volatility_60d": 31, "sma_20": 10, "sma_50": 25, "sma_200": 100, "momentum_6m": 127, "momentum_12m": 253,
    }
    assert all(-1 <= r.drawdown <= 1e-5 for r in rows)
    assert all(abs(r.sma_20_ratio - r.close / r.sma_20) < 1e-9 for r in rows if r.sma_20)
    assert abs(rows[-1].cumulative_return - (prices[-1] / prices[0] - 1)) < 1e-12


def test_windows_share_one_shuffle(spark):
    plan = gold.features(series(spark, [1.0, 2.0]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_volume_ratio_is_one_without_a_mean(spark):
    rows = gold.features(series(spark, [1.0] * 12)).orderBy("date").collect()
    assert rows[0].volume_ratio == 1.0 and rows[0].is_abnormal_volume == 0 and rows[11].volume_ratio == 1.0


# --- risk ---


def test_returns_and_growth(spark):
    r = risk.with_returns(series(spark, [100.0, 110.0, 99.0, 108.9]))
    rows = r.orderBy("date").collect()
    assert rows[0].daily_return is None and [round(x.daily_return, 10) for x in rows[1:]] == [0.1, -0.1, 0.1]
    assert round(risk.cumulative_returns(r).orderBy(F.desc("date")).first().cumulative_return, 10) == 0.089
    grown = series(spark, [100.0] + [150.0] * 250 + [200.0]).groupBy("symbol").agg(risk.cagr().alias("x")).first().x
    assert abs(grown - 1.0) < 0.01
    assert series(spark, [5.0]).groupBy("symbol").agg(risk.cagr().alias("x")).first().x == 0.0


def test_drawdown_path(spark):
    got = one(risk.max_drawdown_path(series(spark, [100.0, 120.0, 90.0, 110.0, 80.0])))
    assert (got["max_drawdown"], got["peak_date"], got["trough_date"], got["recovery_date"], got["duration_rows"]) == (-0.3333, "2024-01-02", "2024-01-05", "Unrecovered", 4)
    got = one(risk.max_drawdown_path(series(spark, [100.0, 50.0, 100.0, 120.0])))
    assert (got["peak_date"], got["recovery_date"], got["duration_rows"]) == ("2024-01-01", "2024-01-03", 3)


def test_ratios_of_series(spark):
    flat = spark.createDataFrame([("A", 0.005)] * 252, "symbol string, daily_return double")
    assert flat.groupBy("symbol").agg(risk.sharpe().alias("x")).first().x == 0.0
    draw = random.Random(42)
    rows = [("A", str(datetime.date(2020, 1, 1) + datetime.timedelta(days=i)), draw.gauss(0.0005, 0.015)) for i in range(1000)]
    df = spark.createDataFrame(rows, "symbol string, date string, daily_return double")
    v95, v99 = (df.groupBy("symbol").agg(risk.var_historical(x).alias("x")).first().x for x in (0.95, 0.99))
    assert v99 > v95 and risk.cvar(df).first().cvar >= v95
    vol = df.groupBy("symbol").agg(risk.annualized_volatility().alias("x")).first().x
    assert abs(vol - 0.015 * math.sqrt(252)) < 0.02
    few = df.limit(5)
    assert few.groupBy("symbol").agg(risk.var_historical().alias("x")).first().x == 0.0 and risk.cvar(few).first().cvar == 0.0


def test_portfolio_shares_sum_to_all(spark):
    draw = random.Random(1)
    rows = [(s, str(datetime.date(2020, 1, 1) + datetime.timedelta(days=i)), draw.gauss(0, 0.01)) for i in range(100) for s in "AB"] + [("A", "2021-01-01", 0.5)]
    df = spark.createDataFrame(rows, "symbol string, date string, daily_return double")
    weights = {"A": 3.0, "B": 2.0, "missing": 5.0}
    shares = risk.risk_decomposition(df, weights).collect()
    assert abs(sum(r.share_pct for r in shares) - 100) < 1e-6 and {round(r.weight, 6) for r in shares} == {0.6, 0.4}
    assert risk.portfolio_daily(df, weights).count() == 100
    assert {"total_return", "cagr", "sharpe", "cvar_95"} <= set(risk.portfolio_summary(df, weights).columns)


def test_empty_periods_break_returns(spark):
    df = spark.createDataFrame([("A", "2024-01-15", 1.0), ("A", "2024-02-15", 2.0), ("A", "2024-04-15", 4.0), ("A", "2024-05-15", 8.0)], "symbol string, date string, close double").withColumn("date", F.to_date("date"))
    assert [(str(r.period_end), r.period_return) for r in risk.periodic_returns(df, "month").orderBy("period_end").collect()] == [("2024-02-29", 1.0), ("2024-05-31", 1.0)]


def test_spearman_uses_mean_ranks(spark):
    rows = [("A", i, float(x)) for i, x in enumerate([1, 2, 2, 3])] + [("B", i, float(x)) for i, x in enumerate([1, 8, 8, 27])]
    df = spark.createDataFrame([(s, str(datetime.date(2024, 1, 1) + datetime.timedelta(days=i)), x) for s, i, x in rows], "symbol string, date string, daily_return double")
    assert abs(risk.correlations(df, "spearman").filter("symbol_a = 'A' AND symbol_b = 'B'").first().correlation - 1.0) < 1e-12


# --- star, models, checks ---


def test_rounding_is_half_away_from_zero(spark):
    row = spark.range(1).select(rounded(F.lit(2.675), 2).alias("a"), rounded(F.lit(-2.675), 2).alias("b"), rounded(F.lit(-1e-12), 6).alias("c"), percentage_change(F.lit(3.0), F.lit(0.0)).alias("d")).first()
    assert (row.a, row.b, row.d) == (2.68, -2.68, None) and str(row.c) == "0.0"


def test_calendar(spark):
    df = star.dim_date(spark.createDataFrame([("2024-03-31",), ("2024-01-01",), ("2023-01-01",), (None,), ("2024-01-01",)], "date string"))
    rows = {r.calendar_date: r for r in df.collect()}
    assert len(rows) == 3 and rows["2024-03-31"].is_quarter_end == 1 and rows["2024-01-01"].is_month_end == 0 and rows["2024-01-01"].day_of_week == 1
    for day, r in rows.items():
        assert r.calendar_week == int(datetime.date.fromisoformat(day).strftime("%W")) and r.day_name == datetime.date.fromisoformat(day).strftime("%A")


def test_checks_find_what_is_broken(spark):
    facts = spark.createDataFrame([(20240102, 1), (20240102, 1), (20240102, 999999), (20240103, None)], "market_date_key int, asset_key int")
    assets = spark.createDataFrame([(1, "equity"), (2, "fund")], "asset_key int, asset_type string")
    counts = {r.name: r.violations for r in checks.results({
        "unique": checks.unique(facts, "market_date_key", "asset_key"), "null": checks.not_null(facts, "asset_key"), "parent": checks.relationships(facts, "asset_key", assets, "asset_key"), "values": checks.accepted_values(assets, "asset_type", ["equity", "etf"]),
    }).collect()}
    assert counts == {"unique": 1, "null": 1, "parent": 1, "values": 1}


def test_models_are_built_after_what_they_read():
    order = models.registry.order("mart_risk_dashboard")
    assert order.index("stg_market_prices") < order.index("int_daily_returns") < order.index("int_risk_metrics") < order.index("mart_risk_dashboard") and "mart_monthly_performance" not in order
    loop = models.Registry()
    loop.models = {"a": models.Model(None, ("b",)), "b": models.Model(None, ("a",))}
    with pytest.raises(ValueError):
        loop.order()


def test_pipeline_end_to_end(spark, tmp_path):
    draw, rows = random.Random(3), []
    for s in ("SPY", "QQQ"):
        price = 100.0
        for i in range(120):
            price *= 1 + draw.gauss(0, 0.01)
            rows.append((s, str(datetime.date(2024, 1, 1) + datetime.timedelta(days=i)), price, price * 1.01, price * 0.99, price, price, 1000 + i))
    for _ in range(2):  # a second batch replaces the first
        out = pipeline.run(spark, bronze(spark, rows), str(tmp_path), database="batch_test")
        assert spark.table("batch_test.dim_asset").count() == 2 and spark.table("batch_test.fact_market_daily").count() == spark.table("batch_test.dim_date").count() * 2
    assert set(out["checks"].values()) == {"PASSED"} and out["metrics"]["silver_clean_rows"] == 240 and "gold" in out["seconds"]
    assert publication.published(spark, f"{tmp_path}/mart_asset_performance").count() == 2


def test_files(spark, tmp_path):
    config = tmp_path / "assets.json"
    config.write_text('{"assets": [{"symbol": "SPY", "asset_name": "S", "asset_type": "etf"}, {"symbol": "QQQ"}]}')
    rows = files.instruments(spark, str(config)).collect()
    assert [(r.asset_key, r.symbol, r.currency) for r in rows] == [(1, "SPY", "USD"), (2, "QQQ", "USD")]
    df = bars.bronze(series(spark, [1.23456, 2.0]), "x", "b", "t")
    files.write_layer(df, f"{tmp_path}/layer", f"{tmp_path}/csv")
    files.write_raw(df, str(tmp_path), "20240101")
    back = files.read_layer(spark, f"{tmp_path}/layer", files.BRONZE)
    assert back.count() == 2 and back.orderBy("date").first().open == 1.2346 and files.read_csv(spark, f"{tmp_path}/csv", files.BRONZE).count() == 2
    wide = spark.createDataFrame([("2024-01-01", 1.0, None), ("2024-01-02", None, 2.0)], "date string, A_close double, B_close double")
    assert files.wide_to_long(wide, ["A", "B"], ["close"]).count() == 2
    assert files.run_sql(spark, "SELECT count(*) AS n FROM v", v=df).first().n == 2


# --- regimes ---


@pytest.fixture(scope="module")
def market(spark):
    draw, price, rows = random.Random(5), 100.0, []
    for i in range(700):
        price *= 1 + draw.gauss(0.0005, 0.02 if i // 80 % 2 else 0.008)
        rows.append(price)
    return gold.features(series(spark, rows, "SPY", "2021-01-01")).cache()


def test_regimes(spark, market):
    rows = regimes.labelled(market, "SPY")
    assert {r.regime_target for r in rows.select("regime_target").distinct().collect()} <= {0, 1, 2, 3} and rows.filter("regime_label IS NULL").count() == 0
    parts = regimes.split(rows, "2022-03-31", "2022-07-31", "2022-12-31")
    assert all(p.count() > 0 for p in parts.values()) and regimes.split_is_ordered(parts)
    name, model, scores = regimes.train(parts, ("logistic", "random_forest"))
    assert name in scores and 0 <= scores[name]["macro_f1"] <= 1
    payload = regimes.latest(model, rows)
    assert abs(sum(payload["probabilities"].values()) - 1) < 1e-3 and payload["label"] == regimes.LABELS[payload["regime"]]


def test_macro_scores(spark):
    c = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (1, 1, 2), (2, 1, 2)], "regime_target int, prediction int, count long")
    got = one(regimes.macro_scores(c))
    assert got["accuracy"] == 5 / 8 and abs(got["macro_recall"] - (0.75 + 1 + 0) / 3) < 1e-12 and abs(got["macro_precision"] - (1 + 0.4 + 0) / 3) < 1e-12


# --- bars and streams ---


def test_bars_take_first_and_last_trades(spark):
    trades = spark.createDataFrame([("A", 1, 5.0, 1.0, 2), ("A", 1, 7.0, 2.0, 3), ("A", 1, 6.0, 1.0, 1)], "symbol string, date int, price double, quantity double, k int").withColumn("at", F.struct("k"))
    r = bars.to_bars(trades, ["symbol", "date"]).first()
    assert (r.open, r.high, r.low, r.close, r.volume) == (6.0, 7.0, 5.0, 7.0, 4)


def test_hourly_bars_of_a_stream(spark, tmp_path):
    rows = [(i, datetime.datetime(2024, 1, 1, i // 4, 10 * (i % 4)), "x", float(i + 1)) for i in range(16)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(f"{tmp_path}/events")
    query = hourly_bars(stream, "0 seconds").writeStream.format("memory").queryName("hourly").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("hourly").orderBy("date").collect()
    assert len(got) == 3 and (got[0].open, got[0].close, got[0].volume) == (1.0, 4.0, 4)
    batch = hourly_bars(spark.read.parquet(f"{tmp_path}/events")).count()
    assert batch == 4


def test_analytics_have_their_columns(spark):
    draw, frames = random.Random(9), None
    for s in ("NATION_0", "NATION_1"):
        price, prices = 100.0, []
        for _ in range(60):
            price *= 1 + draw.gauss(0, 0.02)
            prices.append(price)
        df = series(spark, prices, s).withColumn("sector", F.lit("R"))
        frames = df if frames is None else frames.unionByName(df)
    s = analytics.Star.of(frames)
    assert {"symbol", "annualized_return_pct", "annualized_volatility_pct", "sharpe_ratio"} <= set(analytics.asset_performance(s).columns) and analytics.asset_performance(s).count() == 2
    assert analytics.correlation_summary(s, "NATION_0").filter("symbol = 'NATION_0'").first().market_beta == 1.0
    assert analytics.risk_metrics(s).count() == 2 and analytics.volatility_ranking(s).count() == 2


def test_wealth_is_lost_for_good(spark):
    rows = [(f"2024-01-0{i + 1}", r) for i, r in enumerate((0.1, -1.0, 0.5))]
    daily = spark.createDataFrame(rows, "date string, portfolio_return double")
    found = risk.portfolio_wealth(daily).orderBy("date").collect()
    assert [round(r.wealth, 9) for r in found] == [1.1, 0.0, 0.0] and [r.drawdown for r in found] == [0.0, -1.0, -1.0]
    returns = daily.selectExpr("'A' AS symbol", "date", "portfolio_return AS daily_return")
    one = risk.portfolio_summary(returns, {"A": 2.0}).first()
    assert (one.days, one.total_return, one.cagr, one.max_drawdown, one.cvar_95) == (3, -1.0, -1.0, -1.0, 0.0)
    both = risk.benchmark_wealth(returns, {"A": 1.0}, "A").orderBy("date").collect()
    assert [round(r.benchmark_wealth, 9) for r in both] == [round(r.portfolio_wealth, 9) for r in both] == [1.1, 0.0, 0.0]
    assert "CartesianProduct" not in risk.portfolio_summary(returns, {"A": 2.0})._jdf.queryExecution().toString()


def test_momentum_of_one_asset(spark):
    bars_ = spark.createDataFrame([("A", f"2024-01-0{i + 1}", float(p)) for i, p in enumerate((10, 11, 15))], "symbol string, date string, close double")
    assert [risk.momentum(bars_, "A", n).first().momentum for n in (2, 3)] == [0.5, 0.0] and risk.momentum(bars_, "B", 1).first().momentum == 0.0


def test_star_tables_refuse_broken_keys(spark):
    from tidemark.operators import star

    star.create_tables(spark, "market_test")
    assets = spark.createDataFrame([(1, "A")], "asset_key int, symbol string").selectExpr("*", *[f"'x' AS {c}" for c in ("asset_name", "asset_type", "sector", "industry", "currency", "exchange")])
    dates = star.dim_date(spark.createDataFrame([("2024-01-02",)], "date string"))
    star.load_table(assets, "market_test", "dim_asset")
    star.load_table(dates, "market_test", "dim_date")
    fact = lambda day, asset: spark.range(1).selectExpr(f"cast({day} AS int) AS market_date_key", f"cast({asset} AS int) AS asset_key", *[f"1.0 AS {c}" for c in ("open", "high", "low", "close", "adjusted_close", *star.METRICS)], "1L AS volume", "0 AS is_abnormal_volume")
    star.load_table(fact(20240102, 1), "market_test", "fact_market_daily")
    for rows, why in ((fact(20240102, 1), "repeated key"), (fact(20240103, 1), "no dim_date"), (fact(20240102, 2), "no dim_asset"), (fact(20240102, "NULL"), "null")):
        with pytest.raises(ValueError, match=why):
            star.load_table(rows, "market_test", "fact_market_daily")
    assert spark.table("market_test.fact_market_daily").count() == 1
    with pytest.raises(ValueError, match="repeated key"):
        star.load_table(assets, "market_test", "dim_asset")


def test_append_and_sql_views(spark, tmp_path):
    from tidemark.sources import files

    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    for df in (rows, rows.select("v", "k")):
        files.append(df, "append_test")
    assert [tuple(r) for r in spark.table("append_test").collect()] == [(1, "a")] * 2
    spark.range(3).createOrReplaceTempView("kept")
    (tmp_path / "q.sql").write_text("SELECT count(*) AS n FROM kept JOIN other ON kept.k = other.k")
    assert files.run_sql_file(spark, str(tmp_path / "q.sql"), kept=rows, other=rows).first().n == 1
    assert spark.table("kept").count() == 3 and not spark.catalog.tableExists("other")


def test_champion_is_stored_and_read_back(spark, market, tmp_path):
    from pyspark.sql import functions as F

    rows = market if "regime_target" in getattr(market, "columns", []) else None
    if rows is None:
        rows = spark.range(90).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (F.col("id") % 4).cast("int").alias("regime_target"), *[(F.col("id") % 4 + F.rand(i) / 9).alias(c) for i, c in enumerate(regimes.COLUMNS)])
    best, model, scores = regimes.train({"train": rows, "val": rows})
    assert set(scores) == {"logistic", "random_forest", "boosted"} and scores[best]["macro_f1"] == max(x["macro_f1"] for x in scores.values())
    regimes.save(str(tmp_path), best, model, scores, spark)
    again, metrics = regimes.load(spark, str(tmp_path))
    assert metrics["champion"] == best and regimes.latest(again, rows)["regime"] == regimes.latest(model, rows)["regime"]


def test_publications_are_whole_or_not_there(spark, tmp_path):
    folder = f"{tmp_path}/table"
    with pytest.raises(ValueError, match="nothing is published"):
        publication.published(spark, folder)
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        runs.add(1)
        yield from batches

    first = files.write_raw(spark.range(3).coalesce(1).mapInArrow(counted, "id long"), folder, "20240101")
    assert runs.value == 1  # one run of the plan for both names
    before = publication.published(spark, folder)
    with pytest.raises(Exception, match="broken"):
        publication.publish(spark.range(5).selectExpr("CASE WHEN id < 4 THEN id ELSE raise_error('broken') END AS id"), folder)
    assert publication.current(spark, folder) == first and publication.published(spark, folder).count() == 3
    second = files.write_raw(spark.range(7), folder, "20240102")
    assert before.count() == 3 and publication.published(spark, folder).count() == 7 and publication.published(spark, folder, "raw_20240101").count() == 3
    publication.point(spark, folder, first)
    assert publication.current(spark, folder) == first
    with pytest.raises(ValueError, match="not complete"):
        publication.point(spark, folder, "other")
    third = publication.publish(spark.range(1), folder)
    assert len(publication.prune(spark, folder)) == 1 and {publication.current(spark, folder, x) for x in ("latest", "raw_20240101", "raw_20240102")} == {first, second, third}


def test_correlations_by_blocks(spark):
    draw, rows = random.Random(12), []
    for k, s in enumerate("ABCDEFG"):
        rows += [(s, datetime.date(2024, 1, 1) + datetime.timedelta(days=i), None if draw.random() < 0.2 else 5.0 if s == "G" else 1e6 * (s == "F") + draw.gauss(0, 1) + k * i % 3) for i in range(60)]
    rows.append(("H", datetime.date(2024, 1, 1), 1.0))
    df = spark.createDataFrame(rows, "symbol string, date date, daily_return double").repartition(3)
    got = {(r.symbol_a, r.symbol_b): r.correlation for r in risk.correlations(df, symbols=2, days=7).collect()}
    by = {s: {d: v for x, d, v in rows if x == s and v is not None} for s in "ABCDEFGH"}

    def plain(a, b):
        both = [(by[a][d], by[b][d]) for d in by[a] if d in by[b]]
        mx, my = (sum(x) / len(both) for x in zip(*both, strict=True))
        xx, yy, xy = sum((x - mx) ** 2 for x, _ in both), sum((y - my) ** 2 for _, y in both), sum((x - mx) * (y - my) for x, y in both)
        return xy / math.sqrt(xx * yy) if len(both) > 1 and xx > 0 and yy > 0 else None

    pairs = {(a, b) for a in by for b in by if any(d in by[b] for d in by[a])}
    assert set(got) == pairs
    for p in pairs:
        assert (got[p] is None) == (plain(*p) is None) and (got[p] is None or abs(got[p] - plain(*p)) < 1e-8), p
    assert "CartesianProduct" not in risk.correlations(df)._jdf.queryExecution().toString()


def test_cleaning_and_its_record_are_one_job(spark):
    rows = [("A", "2024-01-01", 100.0, 95.0, 105.0, 102.0, 102.0, -5), ("A", "2024-01-01", 1.0, 1.0, 1.0, 1.0, 1.0, 1), (" b", "2024-01-02", 1.0, 2.0, 0.5, 9.0, None, None), ("b", "2024-01-03", 1.0, 2.0, 0.5, None, None, 3), ("C", "2024-01-04", -1.0, 1.0, 1.0, 1.0, 1.0, 1), (None, None, 1.0, 1.0, 1.0, 1.0, 1.0, 1)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    for some in (rows, rows[1:2], rows[2:3], []):
        source = bronze(spark, some)
        jobs = []
        read.value = 0

        def store(df):
            jobs.append(1)
            df.write.mode("overwrite").saveAsTable("kept_rows")
            return spark.table("kept_rows")

        clean, record = silver.Silver(source.mapInArrow(counted, source.schema)).clean_and_metrics(store)
        assert read.value == len(some) and len(jobs) == 1
        plain = silver.Silver(source)
        assert one(record) == one(plain.metrics())
        assert clean.columns == plain.clean().columns and sorted(map(str, clean.collect())) == sorted(map(str, plain.clean().collect()))
