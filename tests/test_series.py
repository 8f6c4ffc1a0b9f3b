"""Long series: blocks with halos, running medians and quantiles against plain windows and plain Python."""

import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.functions import medians, quantiles, series
from tidemark.operators import gold, risk
from tidemark.sources import bars, files


def _bars(spark, sizes, seed=3):
    draw, rows = random.Random(seed), []
    for symbol, n in sizes.items():
        for i in range(n):
            day = datetime.date(2000, 1, 1) + datetime.timedelta(days=3 * i if symbol == "gaps" else i)
            close = None if i % 41 == 5 else 0.0 if i % 97 == 50 else round(draw.uniform(1, 200), 2)
            rows.append((symbol, day, close, close, close, close, close, draw.randint(0, 1000)))
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, adjusted_close double, volume long")


def test_features_in_blocks_are_those_of_whole_windows(spark):
    df = _bars(spark, {"long": 2600, "gaps": 900, "short": 3}).repartition(5)
    digits = lambda out: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in out.select(*df.columns, *gold.FEATURES).collect())
    assert digits(gold.features_in_blocks(df, rows=300, cell=series.by_days(days=90))) == digits(gold.features(df))
    assert digits(gold.features_in_blocks(df, gate=False, rows=252)) == digits(gold.features(df, gate=False))
    assert gold.features_in_blocks(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="halo"):
        gold.features_in_blocks(df, rows=100)


def test_one_series_is_worked_on_by_many_tasks(spark):
    df = spark.range(60_000).select(F.lit("one").alias("symbol"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (F.col("id") % 977 + 1.0).alias("close"), F.col("id").alias("volume"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = gold.features_in_blocks(df, rows=2_000).withColumn("task", F.spark_partition_id())
        assert out.count() == 60_000 and out.select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    numbers = series.numbered(df, series.by_days()).agg(F.min("_n"), F.max("_n"), F.countDistinct("_n")).first()
    assert tuple(numbers) == (0, 59_999, 60_000)


def test_running_medians(spark):
    draw = random.Random(8)
    rows = [(s, i, None if draw.random() < 0.2 else draw.choice([draw.gauss(0, 1), 1.0])) for s in ("a", "b", None) for i in range(400)]
    got = {(r.symbol, r.date): r.m for r in medians.with_expanding_median(spark.createDataFrame(rows, "symbol string, date int, v double").repartition(4), "v", "m").collect()}
    for s in ("a", "b", None):
        seen = []
        for _, i, v in (r for r in rows if r[0] == s):
            seen += [] if v is None else [v]
            assert got[s, i] == (statistics.median(seen) if seen else None) or abs(got[s, i] - statistics.median(seen)) < 1e-15
    with pytest.raises(ValueError, match="there is a column"):
        medians.with_expanding_median(spark.createDataFrame(rows[:1], "symbol string, date int, v double"), "v", "v")


def test_bars_order_trades_by_all_fields(spark):
    rows = [(5, 1, 2, 3, 10.0), (5, 1, 2, 3, 9.99), (5, 1, 2, 2, 8.0), (5, 2, 1, 1, 7.0), (4, 7, 9, 9, 6.0)]
    trades = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double")
    at = trades.withColumn("at", bars.order_key())
    assert [tuple(r)[:5] for r in at.orderBy("at").collect()] == sorted(rows)
    bar = bars.to_bars(at.select(F.lit("s").alias("symbol"), F.col("l_extendedprice").alias("price"), F.lit(1).alias("quantity"), "at"), ["symbol"])
    assert tuple(bar.select("open", "close").first()) == (6.0, 7.0)
    most = spark.createDataFrame([(10**12 - 1, 7, 10**10 - 1, 10**8 - 1, 124_999.99)], trades.schema)
    assert int(most.select(bars.order_key().alias("k")).first().k) == 10**38 - 1
    with pytest.raises(Exception, match="room"):
        spark.createDataFrame([(10**12, 1, 1, 1, 1.0)], trades.schema).select(bars.order_key()).collect()


def test_market_plans_have_no_aggregate_that_sorts(spark, tmp_path):
    from pathlib import Path

    from tidemark import registry

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("needs the driver's tables")
    for name in ("bars_type", "bars_nation", "bars_event", "silver_metrics", "gold_features", "q03_volatility_ranking", "q04_drawdown_analysis", "mart_asset_performance", "max_drawdown_path", "momentum_rank"):
        plan = registry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan, name
    assert registry.queries()["max_drawdown_path"](spark, folder)._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 2  # trades and parts
    for name in ("portfolio_risk_decomposition", "corr_pearson"):
        plan = registry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") <= (2 if name.startswith("portfolio") else 8), plan
    assert risk.max_drawdown_path(_bars(spark, {"a": 5})).count() == 1


def test_quantiles_by_refined_counts(spark):
    draw = random.Random(4)
    values = {"even": [draw.uniform(-1, 1) for _ in range(700)], "ties": [draw.choice([0.5, 0.5, 0.25, -3.0]) for _ in range(500)], "far": [1e-9 * i for i in range(400)] + [1e12], "one": [7.0], "none": []}
    rows = [(s, v) for s, x in values.items() for v in [*x, None, float("nan")]]
    df = spark.createDataFrame(rows, "symbol string, v double").repartition(4)
    wanted = spark.createDataFrame([(s, r) for s, x in values.items() for r in (0, 1, 2, len(x) // 3, len(x), len(x) + 1)], "symbol string, rank int")
    got = {(r.symbol, r.rank): r.v for r in quantiles.at_ranks(df, "v", wanted, enough=20, buckets=8).collect()}
    assert got == {(s, r): sorted(x)[r - 1] for s, x in values.items() for r in (0, 1, 2, len(x) // 3, len(x), len(x) + 1) if 1 <= r <= len(x)}
    plain = {r.symbol: r.q for r in df.filter("NOT isnan(v)").groupBy("symbol").agg(F.percentile("v", F.lit(0.05)).alias("q")).collect()}
    found = {r.symbol: (r.n, r.quantile) for r in quantiles.quantile(df, "v", 0.05, enough=30, buckets=16).collect()}
    assert {s: n for s, (n, _) in found.items()} == {s: len(x) for s, x in values.items() if x}
    assert all(abs(found[s][1] - plain[s]) <= 1e-12 * max(1, abs(plain[s])) for s in found)


def test_stored_buckets_need_no_exchange(spark):
    df = _bars(spark, {"a": 300, "b": 40, "c": 7})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    files.save_bucketed(df, "gold_bucketed", 4)
    stored = spark.table("gold_bucketed")
    features = gold.features(stored)
    assert "Exchange" not in features._jdf.queryExecution().executedPlan().toString()
    digits = lambda out: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in out.select(*df.columns, *gold.FEATURES).collect())
    assert digits(features) == digits(gold.features(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = stored.join(stored.groupBy("symbol").agg(F.max("close").alias("top")), "symbol")
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString() and both.count() == 347
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    spark.sql("DROP TABLE gold_bucketed")
