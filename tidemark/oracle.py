"""SQL for DuckDB over the same tables, written from definitions and apart from the Spark code."""

from __future__ import annotations

_TYPE = """tr AS (
  SELECT p_type AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS px, l_quantity AS q,
    row_number() OVER (PARTITION BY p_type, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS i,
    count(*) OVER (PARTITION BY p_type, CAST(l_shipdate AS DATE)) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (
  SELECT symbol, date, max(px) FILTER (WHERE i = 1) AS open, max(px) AS high, min(px) AS low, max(px) FILTER (WHERE i = n) AS close, max(px) FILTER (WHERE i = n) AS adjusted_close, CAST(sum(q) AS BIGINT) AS volume
  FROM tr GROUP BY symbol, date)"""
_NATION = """tr AS (
  SELECT n_name AS symbol, r_name AS sector, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS px, l_quantity AS q,
    row_number() OVER (PARTITION BY n_name, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS i,
    count(*) OVER (PARTITION BY n_name, CAST(l_shipdate AS DATE)) AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
bars AS (
  SELECT symbol, sector, date, max(px) FILTER (WHERE i = 1) AS open, max(px) AS high, min(px) AS low, max(px) FILTER (WHERE i = n) AS close, max(px) FILTER (WHERE i = n) AS adjusted_close, CAST(sum(q) AS BIGINT) AS volume
  FROM tr GROUP BY symbol, sector, date)"""
_EVENT = """tr AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS date, value AS px, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type, date_trunc('hour', ts)) AS n FROM events),
bars AS (
  SELECT symbol, date, max(px) FILTER (WHERE i = 1) AS open, max(px) AS high, min(px) AS low, max(px) FILTER (WHERE i = n) AS close, max(px) FILTER (WHERE i = n) AS adjusted_close, count(*) AS volume
  FROM tr GROUP BY symbol, date)"""
_RETURNS = "ret AS (SELECT *, (close - lag(close) OVER (PARTITION BY symbol ORDER BY date)) / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) AS r FROM bars)"


def _win(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _gate(agg: str, x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) OVER {_win(n)} >= {least} THEN {agg}({x}) OVER {_win(n)} END"


def _gold(gate: bool = True) -> str:
    """CTEs g1 and gold over bars."""
    least = lambda k: k if gate else 1
    w = "(PARTITION BY symbol ORDER BY date)"
    lags = {"daily_return": 1, "return_5d": 5, "return_20d": 20, "return_60d": 60, "momentum_1m": 21, "momentum_3m": 63, "momentum_6m": 126, "momentum_12m": 252}
    one = [f"(close - lag(close, {n}) OVER {w}) / nullif(lag(close, {n}) OVER {w}, 0) AS {c}" for c, n in lags.items()]
    one += [f"{_gate('avg', 'close', n, least(k))} AS sma_{n}" for n, k in ((20, 10), (50, 25), (200, 100))]
    one += [f"{_gate('avg', 'volume', 20, least(10))} AS avg_volume_20d", f"max(close) OVER {w} AS running_max", f"first_value(close) OVER {w} AS first_close"]
    two = [f"{_gate('stddev_samp', 'daily_return', n, least(k))} * sqrt(252) AS volatility_{n}d" for n, k in ((20, 10), (60, 30))]
    two += [f"close / nullif(sma_{n}, 0) AS sma_{n}_ratio" for n in (20, 50, 200)]
    two += ["CASE WHEN avg_volume_20d > 0 THEN volume / avg_volume_20d ELSE 1.0 END AS volume_ratio", "(close - running_max) / running_max AS drawdown", "(close - first_close) / first_close AS cumulative_return"]
    return f"g1 AS (SELECT *, {', '.join(one)} FROM bars), gold AS (SELECT *, {', '.join(two)} FROM g1)"


_STAR = f"""{_NATION}, {_gold()},
assets AS (SELECT row_number() OVER (ORDER BY symbol) AS asset_key, symbol, upper(symbol[1]) || lower(symbol[2:]) AS asset_name, 'equity' AS asset_type, sector FROM (SELECT DISTINCT symbol, sector FROM bars)),
fact AS (SELECT CAST(strftime(date, '%Y%m%d') AS BIGINT) AS date_key, strftime(date, '%Y-%m-%d') AS day, a.asset_key, a.asset_name, a.asset_type, g.* FROM gold g JOIN assets a USING (symbol))"""


#: A decimal half, such as that of a mean of prices, may lie a little short in binary; this takes it over on both sides.
_UP = "(1 + pow(2, -43))"


def _round(x: str) -> str:
    return f"round(({x}) * {_UP}, 6)"


def _r(x: str, name: str = "") -> str:
    return f"{_round(x)} + 0.0 AS {name or x}"


def _rounded(*columns: str) -> str:
    return ", ".join(_r(c) for c in columns)


_MONEY = "open", "high", "low", "close", "adjusted_close"
_DAY = "strftime(date, '%Y-%m-%d') AS date"


def _faulty() -> str:
    return f"""{_TYPE},
d AS (SELECT *, date_diff('day', DATE '1995-01-01', date) AS n FROM bars),
f AS (SELECT CASE WHEN n % 101 = 0 THEN NULL WHEN n % 41 = 0 THEN '  ' || lower(symbol) || ' ' ELSE symbol END AS symbol, strftime(date, '%Y-%m-%d') AS date, CASE WHEN n % 97 = 0 THEN -open ELSE open END AS open,
  CASE WHEN n % 79 = 0 THEN low * 0.5 ELSE high END AS high, low, CASE WHEN n % 83 = 0 THEN NULL ELSE close END AS close, adjusted_close, CASE WHEN n % 89 = 0 THEN -volume ELSE volume END AS volume, n * 100 + ascii(symbol) AS ingest_seq, n FROM d),
raw AS (SELECT * EXCLUDE n FROM f UNION ALL SELECT * EXCLUDE n REPLACE (ingest_seq + 1000000 AS ingest_seq, volume + 7 AS volume) FROM f WHERE n % 53 = 0),
uniq AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY ingest_seq) AS k FROM raw) WHERE k = 1),
norm AS (SELECT * REPLACE (upper(trim(symbol)) AS symbol) FROM uniq),
complete AS (SELECT * FROM norm WHERE symbol IS NOT NULL AND date IS NOT NULL AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL),
positive AS (SELECT * REPLACE (CASE WHEN volume < 0 THEN 0 ELSE volume END AS volume), high < greatest(open, close) - 0.001 OR low > least(open, close) + 0.001 OR high < low AS broken FROM complete WHERE open > 0 AND high > 0 AND low > 0 AND close > 0),
clean AS (SELECT symbol, date, open, CASE WHEN any_broken THEN greatest(high, open, close) ELSE high END AS high, CASE WHEN any_broken THEN least(low, open, close) ELSE low END AS low, close, adjusted_close, volume
  FROM positive, (SELECT bool_or(broken) AS any_broken FROM positive))"""


_MARKS = "'2026-01-01 00:00:00 UTC' AS ingestion_timestamp, 'trades' AS source, 'batch-1' AS batch_id"
_POP = "sqrt(greatest(avg(r * r) - avg(r) * avg(r), 0))"


def statements(weights: dict[str, float], benchmark: str, nation: str, pair: tuple[str, str], split: tuple[str, str, str]) -> dict[str, str]:
    q: dict[str, str] = {}
    for name, cte, day, extra in (("bars_type", _TYPE, _DAY, ""), ("bars_nation", _NATION, _DAY, "sector, "), ("bars_event", _EVENT, "strftime(date, '%Y-%m-%d %H:%M:%S') AS date", "")):
        q[name] = f"WITH {cte} SELECT symbol, {extra}{day}, {_rounded(*_MONEY)}, volume FROM bars"
    q["bronze_enrich"] = f"WITH {_TYPE} SELECT symbol, {_DAY}, {', '.join(f'round({c}, 4) AS {c}' for c in _MONEY)}, volume, {_MARKS} FROM bars"
    q["silver_dedup"] = f"WITH {_faulty()} SELECT symbol, date, {_rounded(*_MONEY)}, volume, ingest_seq, {_MARKS} FROM uniq"
    q["silver_clean"] = f"WITH {_faulty()} SELECT symbol, date, {_rounded(*_MONEY)}, volume, {_MARKS} FROM clean"
    q["silver_ohlc_reconcile"] = f"WITH {_faulty()} SELECT symbol, date, {_rounded('high', 'low')} FROM clean"
    q["silver_metrics"] = f"""WITH {_faulty()}, chg AS (SELECT close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS c FROM positive)
SELECT (SELECT count(*) FROM raw) AS total_rows_ingested, (SELECT count(*) FROM raw) - (SELECT count(*) FROM uniq) AS duplicate_records_removed, (SELECT count(*) FROM norm WHERE close IS NULL) AS missing_close_prices,
 (SELECT count(*) - count(open) + count(*) - count(high) + count(*) - count(low) FROM norm) AS missing_open_high_low, (SELECT count(*) - count(volume) FROM norm) AS missing_volumes,
 (SELECT count(*) FROM complete WHERE NOT (open > 0 AND high > 0 AND low > 0 AND close > 0)) AS non_positive_price_records, (SELECT count(*) FROM complete WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume < 0) AS negative_volume_records,
 (SELECT count(*) FROM positive WHERE broken) AS invalid_ohlc_relationships_reconciled, (SELECT count(*) FROM chg WHERE c > 1.5 OR c < -0.85) AS extreme_price_anomalies, count(*) AS silver_clean_rows, count(DISTINCT symbol) AS distinct_symbols,
 min(date) AS start_date, max(date) AS end_date, round(count(*) / (SELECT count(*) FROM raw) * 100.0, 4) AS quality_pass_rate_pct FROM positive"""
    groups = {
        "gold_returns": ("daily_return", "return_5d", "return_20d", "return_60d"), "gold_volatility": ("volatility_20d", "volatility_60d"),
        "gold_sma": ("sma_20", "sma_50", "sma_200", "sma_20_ratio", "sma_50_ratio", "sma_200_ratio"), "gold_drawdown": ("running_max", "drawdown"),
        "gold_momentum": ("momentum_1m", "momentum_3m", "momentum_6m", "momentum_12m"), "gold_cumulative": ("cumulative_return",),
    }
    gold = f"WITH {_TYPE}, {_gold()}"
    for name, columns in groups.items():
        q[name] = f"{gold} SELECT symbol, {_DAY}, {_rounded(*columns)} FROM gold"
    abnormal = "CAST(volume_ratio > 2.0 AS BIGINT) AS is_abnormal_volume"
    q["gold_volume"] = f"{gold} SELECT symbol, {_DAY}, {_rounded('avg_volume_20d', 'volume_ratio')}, {abnormal} FROM gold"
    every = [c for x in groups.values() for c in x] + ["avg_volume_20d", "volume_ratio"]
    q["gold_features"] = f"{gold} SELECT symbol, {_DAY}, {_rounded(*_MONEY)}, volume, {_rounded(*every)}, {abnormal} FROM gold"
    q["gold_features_ungated"] = f"WITH {_TYPE}, {_gold(False)} SELECT symbol, {_DAY}, {_rounded('volatility_20d', 'volatility_60d', 'sma_20', 'sma_50')} FROM gold"
    q["gold_features_hourly"] = f"WITH {_EVENT}, {_gold()} SELECT symbol, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, {_rounded('daily_return', 'volatility_20d', 'sma_50', 'volume_ratio', 'drawdown')} FROM gold"
    q["silver_observed_metrics"] = q["silver_metrics"]
    q["quotes_wide_to_long"] = q["bars_type"]
    q["gold_features_blocks"], q["gold_features_hourly_blocks"] = q["gold_features"], q["gold_features_hourly"]
    star = f"WITH {_STAR}"
    q["dim_asset"] = f"{star} SELECT asset_key, symbol, asset_name, asset_type, sector, 'Trade' AS industry, 'USD' AS currency, 'XTPC' AS exchange FROM assets"
    q["dim_date"] = f"""WITH {_NATION} SELECT DISTINCT CAST(strftime(date, '%Y%m%d') AS BIGINT) AS date_key, strftime(date, '%Y-%m-%d') AS calendar_date, year(date) AS calendar_year, quarter(date) AS calendar_quarter, month(date) AS calendar_month,
 CAST(strftime(date, '%W') AS BIGINT) AS calendar_week, isodow(date) AS day_of_week, dayname(date) AS day_name, 1 AS is_trading_day, CAST(date = last_day(date) AS BIGINT) AS is_month_end, CAST(date = last_day(date) AND month(date) % 3 = 0 AS BIGINT) AS is_quarter_end FROM bars"""
    metrics = _rounded(*_MONEY, "daily_return", "volatility_20d", "volatility_60d", "sma_20", "sma_50", "sma_200", "volume_ratio", "drawdown", "cumulative_return")
    q["fact_market_daily"] = f"{star} SELECT date_key AS market_date_key, asset_key, volume, {metrics}, {abnormal} FROM fact"
    # --- analytics
    ends = "arg_min({0}, date) AS a, arg_max({0}, date) AS b"
    q["q01_asset_performance"] = f"""{star}, s AS (SELECT symbol, asset_name, asset_type, sector, count(*) AS n, {ends.format('adjusted_close')}, avg(daily_return) AS m, stddev_pop(daily_return) AS sd FROM fact GROUP BY ALL)
SELECT symbol, asset_name, asset_type, sector, n AS total_trading_days, {_r('a', 'initial_price')}, {_r('b', 'latest_price')}, {_r('(b - a) / a * 100', 'total_return_pct')}, {_r('(b - a) / a / (n / 252.0) * 100', 'annualized_return_pct')},
 {_r('sd * sqrt(252) * 100', 'annualized_volatility_pct')}, {_r('(m * 252 - 0.035) / nullif(sd * sqrt(252), 0)', 'sharpe_ratio')} FROM s"""
    month = f"SELECT symbol, year(date) AS calendar_year, month(date) AS calendar_month, {ends} FROM fact GROUP BY ALL"
    q["q02_monthly_returns"] = f"""{star}, s AS ({month.format('close')}) SELECT symbol, calendar_year, calendar_month, calendar_year || '-' || lpad(CAST(calendar_month AS VARCHAR), 2, '0') AS year_month,
 {_r('a', 'month_open_price')}, {_r('b', 'month_close_price')}, {_r('(b - a) / a * 100', 'monthly_return_pct')} FROM s"""
    q["mart_monthly_performance"] = f"{star}, s AS ({month.format('adjusted_close')}) SELECT symbol, calendar_year, calendar_month, {_r('a', 'start_price')}, {_r('b', 'end_price')}, {_r('(b - a) / a * 100', 'monthly_return_pct')} FROM s"
    q["q03_volatility_ranking"] = f"""{star}, s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM fact WHERE volatility_20d IS NOT NULL)
SELECT dense_rank() OVER (ORDER BY volatility_20d DESC) AS rank_20d, symbol, asset_name, asset_type, sector, {_r('volatility_20d * 100', 'annualized_volatility_20d_pct')}, {_r('volatility_60d * 100', 'annualized_volatility_60d_pct')}, day AS as_of_date,
 CASE WHEN volatility_20d > 0.35 THEN 'High Risk / Hyper-Volatile' WHEN volatility_20d > 0.2 THEN 'Moderate Risk / Core Equity' ELSE 'Defensive / Low Volatility' END AS volatility_regime_classification FROM s WHERE k = 1"""
    q["q04_drawdown_analysis"] = f"""{star}, t AS (SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY drawdown, date) AS k FROM fact), l AS (SELECT symbol, drawdown AS cur, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM fact),
s AS (SELECT symbol, asset_name, sector, min(drawdown) AS mn, avg(drawdown) AS av FROM fact GROUP BY ALL)
SELECT s.symbol, asset_name, sector, {_r('mn * 100', 'max_drawdown_pct')}, t.day AS max_drawdown_trough_date, {_r('av * 100', 'average_drawdown_pct')}, {_r('cur * 100', 'current_drawdown_pct')},
 CASE WHEN cur >= -0.02 THEN 'At or Near All-Time High' WHEN cur >= -0.1 THEN 'Minor Pullback (2% - 10%)' WHEN cur >= -0.2 THEN 'Correction (10% - 20%)' ELSE 'Bear Market State (> 20% drawdown)' END AS technical_status
FROM s JOIN t ON t.symbol = s.symbol AND t.k = 1 JOIN l ON l.symbol = s.symbol AND l.k = 1"""
    q["q05_volume_anomalies"] = f"""{star}, s AS (SELECT *, avg(volume) OVER {_win(20)} AS av FROM fact)
SELECT day AS calendar_date, symbol, asset_name, volume, round(av, 0) + 0.0 AS avg_volume_20d, {_r('volume / av', 'times')}, {_r('daily_return * 100', 'daily_return_pct')},
 CASE WHEN daily_return > 0.03 THEN 'Institutional Accumulation (Surge Up)' WHEN daily_return < -0.03 THEN 'Institutional Capitulation (Heavy Selloff)' ELSE 'High Volume Consolidation' END AS anomaly_signal
FROM s WHERE volume / nullif(av, 0) > 2 ORDER BY {_round('volume / av')} DESC, day, symbol LIMIT 50""".replace("AS times", "AS volume_ratio")
    q["q06_sector_performance"] = f"""{star}, d AS (SELECT sector, date, count(DISTINCT symbol) AS k, avg(daily_return) AS r, sum(volume) AS v FROM fact GROUP BY ALL), s AS (SELECT sector, max(k) AS k, avg(r) AS m, stddev_pop(r) AS sd, avg(v) AS v FROM d GROUP BY sector)
SELECT sector, k AS asset_count, {_r('m * 252 * 100', 'annualized_return_pct')}, {_r('sd * sqrt(252) * 100', 'annualized_volatility_pct')}, {_r('(m * 252 - 0.035) / nullif(sd * sqrt(252), 0)', 'sector_sharpe_ratio')}, {_r('v / 1000000.0', 'avg_daily_volume_millions')} FROM s"""
    q["q07_correlation_summary"] = f"""{star}, x AS (SELECT f.symbol, f.asset_name, f.sector, f.daily_return AS r, b.daily_return AS m FROM fact f JOIN fact b ON b.date = f.date AND b.symbol = '{nation}' WHERE f.daily_return IS NOT NULL AND b.daily_return IS NOT NULL),
s AS (SELECT symbol, asset_name, sector, covar_pop(r, m) AS c, var_pop(m) AS v, stddev_pop(r) * stddev_pop(m) AS p FROM x GROUP BY ALL)
SELECT symbol, asset_name, sector, {_r('c / nullif(v, 0)', 'market_beta')}, {_r('c / nullif(p, 0)', 'correlation_with_spy')}, CASE WHEN symbol = '{nation}' THEN 'Market Benchmark (Beta = 1.0)' WHEN c / nullif(v, 0) > 1.2 THEN 'Aggressive High Beta (> 1.2)'
 WHEN c / nullif(v, 0) >= 0.8 THEN 'Core Market Correlated' WHEN c / nullif(v, 0) >= 0 THEN 'Low Beta Defensive' ELSE 'Negative / Inverse Correlated' END AS beta_profile FROM s"""
    down = "sqrt(avg(CASE WHEN {0} < 0 THEN {0} * {0} ELSE 0 END))"
    q["q08_risk_metrics"] = f"""{star}, s AS (SELECT symbol, asset_name, sector, avg(daily_return) AS m, min(daily_return) AS w, {down.format('daily_return')} AS dd FROM fact WHERE daily_return IS NOT NULL GROUP BY ALL),
o AS (SELECT symbol, daily_return AS r, row_number() OVER (PARTITION BY symbol ORDER BY daily_return) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM fact WHERE daily_return IS NOT NULL), v AS (SELECT symbol, abs(r) AS v FROM o WHERE k = CAST(round(n * 0.05) AS INTEGER))
SELECT symbol, asset_name, sector, {_r('v * 100', 'var_95_daily_pct')}, {_r('w * 100', 'worst_single_day_pct')}, {_r('dd * sqrt(252) * 100', 'annualized_downside_deviation_pct')}, {_r('(m * 252 - 0.035) / nullif(dd * sqrt(252), 0)', 'sortino_ratio')},
 CASE WHEN v > 0.025 THEN 'High Tail Risk (> 2.5% daily VaR)' WHEN v > 0.015 THEN 'Moderate Tail Risk (1.5% - 2.5%)' ELSE 'Low Tail Risk (< 1.5% daily VaR)' END AS tail_risk_classification FROM s JOIN v USING (symbol)"""
    # --- models
    q["stg_assets"] = q["dim_asset"]
    q["stg_market_prices"] = f"{star} SELECT date_key, asset_key, {', '.join(_r(c, f'{c}_price') for c in _MONEY)}, volume, {_rounded('daily_return')} FROM fact"
    idr = f"idr AS (SELECT *, {_round('return_5d')} AS r5, {_round('return_20d')} AS r20 FROM fact)"
    own = "date_key, asset_key, close + 0.0 AS close_price, volume, " + _r("daily_return") + ", r5 + 0.0 AS return_5d, r20 + 0.0 AS return_20d"
    q["int_daily_returns"] = f"{star}, {idr} SELECT {own} FROM idr"
    roll = "irm AS (SELECT *, " + ", ".join(f"avg(close) OVER {_win(n)} AS m{n}" for n in (20, 50, 200)) + f", avg(volume) OVER {_win(20)} AS mv FROM idr)"
    q["int_rolling_metrics"] = f"{star}, {idr}, {roll} SELECT {own}, {', '.join(_r(f'm{n}', f'sma_{n}') for n in (20, 50, 200))}, {', '.join(_r(f'close / m{n}', f'sma_{n}_ratio') for n in (20, 50, 200))}, {_r('volume / nullif(mv, 0)', 'volume_ratio')}, {_rounded('drawdown')} FROM irm"
    rsk = f"""rk AS (SELECT asset_key, count(daily_return) AS trading_days, {_round('avg(daily_return) * 252')} AS annualized_return, {_round('stddev_pop(daily_return) * sqrt(252)')} AS annualized_volatility, {_round(down.format('daily_return') + ' * sqrt(252)')} AS annualized_downside_deviation,
 {_round('(avg(daily_return) * 252 - 0.035) / nullif(stddev_pop(daily_return) * sqrt(252), 0)')} AS sharpe_ratio, {_round('(avg(daily_return) * 252 - 0.035) / nullif(' + down.format('daily_return') + ' * sqrt(252), 0)')} AS sortino_ratio FROM fact WHERE daily_return IS NOT NULL GROUP BY asset_key)"""
    q["int_risk_metrics"] = f"{star}, {rsk} SELECT * FROM rk"
    q["mart_asset_performance"] = f"""{star}, {rsk}, l AS (SELECT asset_key, close, {_round('drawdown')} AS dd, {_round(f'close / avg(close) OVER {_win(200)}')} AS ratio, row_number() OVER (PARTITION BY asset_key ORDER BY date DESC) AS k FROM fact)
SELECT a.symbol, a.asset_name, a.asset_type, a.sector, 'Trade' AS industry, {_r('l.close', 'latest_price')}, {_r('annualized_return * 100', 'annualized_return_pct')}, {_r('annualized_volatility * 100', 'annualized_volatility_pct')}, sharpe_ratio, sortino_ratio, {_r('dd * 100', 'current_drawdown_pct')}, ratio AS sma_200_ratio
FROM assets a JOIN rk USING (asset_key) JOIN l USING (asset_key) WHERE l.k = 1"""
    q["mart_risk_dashboard"] = f"""{star}, {rsk}, m AS (SELECT asset_key, min({_round('drawdown')}) AS dd FROM fact GROUP BY 1)
SELECT a.symbol, a.asset_name, a.sector, sharpe_ratio, sortino_ratio, {_r('annualized_volatility * 100', 'annualized_volatility_pct')}, {_r('annualized_downside_deviation * 100', 'downside_deviation_pct')}, {_r('dd * 100', 'max_drawdown_pct')},
 dense_rank() OVER (ORDER BY sharpe_ratio DESC NULLS LAST) AS sharpe_rank, dense_rank() OVER (ORDER BY annualized_volatility NULLS FIRST) AS defensive_rank FROM assets a JOIN rk USING (asset_key) JOIN m USING (asset_key)"""
    # --- checks
    broken = {
        "check_positive_prices": "SELECT 1 FROM fact WHERE close <= 0", "check_drawdown_bounds": "SELECT 1 FROM fact WHERE drawdown > 0.001 OR drawdown < -1", "check_unique_asset_key": "SELECT asset_key FROM assets GROUP BY 1 HAVING count(*) > 1",
        "check_unique_fact_key": "SELECT date_key, asset_key FROM fact GROUP BY ALL HAVING count(*) > 1", "check_not_null_symbol": "SELECT 1 FROM assets WHERE symbol IS NULL", "check_not_null_fact_key": "SELECT 1 FROM fact WHERE date_key IS NULL OR asset_key IS NULL",
        "check_accepted_asset_types": "SELECT 1 FROM assets WHERE asset_type NOT IN ('equity', 'etf')", "check_fact_asset": "SELECT 1 FROM fact WHERE asset_key NOT IN (SELECT asset_key FROM assets)", "check_fact_date": "SELECT 1 FROM fact WHERE date NOT IN (SELECT date FROM bars)",
    }
    for name, sql in broken.items():
        q[name] = f"{star} SELECT '{name}' AS name, count(*) AS violations FROM ({sql})"
    # --- risk
    ret = f"WITH {_TYPE}, {_RETURNS}"
    by = lambda name, x: f"{ret} SELECT symbol, {_r(x, name)} FROM ret GROUP BY symbol"
    zero = lambda n, x: f"CASE WHEN count(r) < {n} THEN 0 ELSE coalesce({x}, 0) END"
    semi = lambda mar: f"sqrt(avg(CASE WHEN r IS NOT NULL THEN least(r - {mar}, 0) * least(r - {mar}, 0) END) * 252)"
    sharpe = f"CASE WHEN stddev_samp(r) > 0 THEN sqrt(252) * (avg(r) - 0.035 / 252) / stddev_samp(r) END"
    sortino = f"CASE WHEN {semi('0.035 / 252')} > 0 THEN (avg(r) * 252 - 0.035) / {semi('0.035 / 252')} END"
    cagr = "CASE WHEN count(close) < 2 OR arg_min(close, date) <= 0 THEN 0 ELSE pow(arg_max(close, date) / arg_min(close, date), 252.0 / count(close)) - 1 END"
    var = "abs(quantile_cont(r, 0.05))"
    vol = zero(2, "stddev_samp(r) * sqrt(252)")
    q["cagr"], q["annualized_vol"], q["sharpe"], q["sortino"] = by("cagr", cagr), by("annualized_vol", vol), by("sharpe", zero(2, sharpe)), by("sortino", zero(2, sortino))
    q["downside_dev"], q["var_hist"] = by("downside_dev", zero(2, semi("0"))), by("var_hist", zero(10, var))
    q["var_param"] = by("var_param", zero(10, "abs(avg(r) - 1.6448536269514722 * stddev_samp(r))"))
    tail = "c AS (SELECT symbol, quantile_cont(r, 0.05) AS cut, count(r) AS n FROM ret GROUP BY symbol), cv AS (SELECT c.symbol, CASE WHEN any_value(n) < 10 THEN 0 ELSE coalesce(abs(avg(CASE WHEN r <= cut THEN r END)), 0) END AS cvar FROM c JOIN ret USING (symbol) GROUP BY c.symbol)"
    q["cvar"] = f"{ret}, {tail} SELECT symbol, {_rounded('cvar')} FROM cv"
    q["return_moments"] = f"""{ret}, m AS (SELECT symbol, avg(r) AS mu FROM ret GROUP BY symbol), p AS (SELECT symbol, count(r) AS n, avg(pow(r - mu, 2)) AS m2, avg(pow(r - mu, 3)) AS m3, avg(pow(r - mu, 4)) AS m4 FROM ret JOIN m USING (symbol) GROUP BY symbol),
s AS (SELECT symbol, n, m3 / nullif(pow(m2, 1.5), 0) AS sk, m4 / nullif(m2 * m2, 0) - 3 AS ku FROM p) SELECT symbol, n, {_r('sk', 'skewness')}, {_r('ku', 'excess_kurtosis')}, {_r('n / 6.0 * (sk * sk + ku * ku / 4)', 'jarque_bera')}, {_r('exp(-n / 12.0 * (sk * sk + ku * ku / 4))', 'p_value')} FROM s"""
    q["log_returns"] = f"WITH {_TYPE} SELECT symbol, {_DAY}, {_r('ln(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0))', 'log_return')} FROM bars"
    q["cumulative_returns"] = f"{ret} SELECT symbol, {_DAY}, {_r('product(1 + coalesce(r, 0)) OVER (PARTITION BY symbol ORDER BY date) - 1', 'cumulative_return')} FROM ret"
    q["parkinson_vol"] = f"WITH {_TYPE}, x AS (SELECT *, pow(ln(high / nullif(low, 0)), 2) AS x FROM bars) SELECT symbol, {_DAY}, {_round(f'CASE WHEN count(x) OVER {_win(20)} >= 10 THEN sqrt(avg(x) OVER {_win(20)} * 252 / (4 * ln(2))) END')} + 0.0 AS parkinson_vol FROM x"
    q["rolling_vol"] = f"{ret} SELECT symbol, {_DAY}, {_round('(' + _gate('stddev_samp', 'r', 20, 10) + ') * sqrt(252)')} + 0.0 AS rolling_vol FROM ret"
    for key, unit, end in (("w", "week", "CAST(s + INTERVAL 6 DAY AS DATE)"), ("m", "month", "last_day(s)"), ("y", "year", "make_date(year(s), 12, 31)")):
        q[f"periodic_returns_{key}"] = f"""WITH {_TYPE}, l AS (SELECT symbol, CAST(date_trunc('{unit}', date) AS DATE) AS s, arg_max(close, date) AS p FROM bars GROUP BY ALL),
sp AS (SELECT symbol, CAST(unnest(generate_series(min(s), max(s), INTERVAL 1 {unit})) AS DATE) AS s FROM l GROUP BY symbol), x AS (SELECT sp.symbol, sp.s, p, lag(p) OVER (PARTITION BY sp.symbol ORDER BY sp.s) AS b FROM sp LEFT JOIN l ON l.symbol = sp.symbol AND l.s = sp.s)
SELECT symbol, strftime({end}, '%Y-%m-%d') AS period_end, {_r('(p - b) / nullif(b, 0)', 'period_return')} FROM x WHERE (p - b) / nullif(b, 0) IS NOT NULL"""
    q["max_drawdown_path"] = f"""WITH {_TYPE}, d AS (SELECT symbol, date, close, max(close) OVER (PARTITION BY symbol ORDER BY date) AS pk FROM bars), t AS (SELECT symbol, date AS td, pk, (close - pk) / pk AS dd FROM d QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY (close - pk) / pk, date) = 1),
k AS (SELECT t.symbol, dd, td, (SELECT min(date) FROM d WHERE d.symbol = t.symbol AND close = t.pk AND date <= td) AS pd, (SELECT min(date) FROM d WHERE d.symbol = t.symbol AND close >= t.pk AND date >= td) AS rd FROM t)
SELECT symbol, round(dd, 4) + 0.0 AS max_drawdown, strftime(pd, '%Y-%m-%d') AS peak_date, strftime(td, '%Y-%m-%d') AS trough_date, coalesce(strftime(rd, '%Y-%m-%d'), 'Unrecovered') AS recovery_date,
 (SELECT count(*) FROM d WHERE d.symbol = k.symbol AND d.date >= pd AND (rd IS NULL OR d.date <= rd)) AS duration_rows FROM k"""
    moms = ", ".join(_r(f"100 * (close / lag(close, {n}) OVER (PARTITION BY symbol ORDER BY date) - 1)", f"momentum_{k}") for k, n in (("1m", 21), ("3m", 63), ("6m", 126), ("12m", 252)))
    q["momentum_rank"] = f"WITH {_TYPE}, x AS (SELECT symbol, date, {moms} FROM bars) SELECT * EXCLUDE date FROM x QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1"
    prs = "prs AS (SELECT x.symbol AS symbol_a, y.symbol AS symbol_b, x.r AS a, y.r AS b FROM ret x JOIN ret y ON x.date = y.date WHERE x.r IS NOT NULL AND y.r IS NOT NULL)"
    corr = f"SELECT symbol_a, symbol_b, {_r('CASE WHEN count(*) >= 2 THEN corr(a, b) END', 'correlation')} FROM {{0}} GROUP BY ALL"
    q["corr_pearson"] = f"{ret}, {prs} {corr.format('prs')}"
    rank = lambda c: f"rank() OVER (PARTITION BY symbol_a, symbol_b ORDER BY {c}) + (count(*) OVER (PARTITION BY symbol_a, symbol_b, {c}) - 1) / 2.0 AS {c}"
    q["corr_spearman"] = f"{ret}, {prs}, rk AS (SELECT symbol_a, symbol_b, {rank('a')}, {rank('b')} FROM prs) {corr.format('rk')}"
    w60 = "(ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
    for name, least in (("rolling_corr", 30), ("rolling_corr_full_window", 60)):
        q[name] = f"{ret}, x AS (SELECT a.date, a.r AS a, b.r AS b FROM ret a JOIN ret b ON a.date = b.date WHERE a.symbol = '{pair[0]}' AND b.symbol = '{pair[1]}' AND a.r IS NOT NULL AND b.r IS NOT NULL) SELECT {_DAY}, {_round(f'CASE WHEN count(*) OVER {w60} >= {least} THEN corr(a, b) OVER {w60} END')} + 0.0 AS rolling_corr FROM x"
    # --- portfolios
    held = "held(symbol, weight) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in weights.items()) + ")"
    port = f"{ret}, {held}, known AS (SELECT held.symbol, weight / sum(weight) OVER () AS w, count(*) OVER () AS k FROM held WHERE symbol IN (SELECT symbol FROM ret)), pf AS (SELECT date, sum(w * r) AS r FROM ret JOIN known USING (symbol) WHERE r IS NOT NULL GROUP BY date HAVING count(*) = any_value(k)), pw AS (SELECT date, r, sum(ln(1 + r)) OVER (ORDER BY date) AS lw FROM pf), pd AS (SELECT *, exp(lw - max(lw) OVER (ORDER BY date)) - 1 AS dd FROM pw)"
    q["momentum_of_one"] = f"WITH {_TYPE}, c AS (SELECT date, close / nullif(lag(close, 63) OVER (ORDER BY date), 0) - 1 AS m FROM bars WHERE symbol = '{benchmark}') SELECT {_r('coalesce(arg_max_null(m, date), 0.0)', 'momentum')} FROM c"
    q["portfolio_daily"] = f"{port} SELECT {_DAY}, {_r('r', 'portfolio_return')}, {_r('lw', 'log_wealth')}, {_r('dd', 'drawdown')} FROM pd"
    cv = "(SELECT CASE WHEN count(*) < 10 THEN 0 ELSE abs(avg(CASE WHEN r <= cut THEN r END)) END FROM pf, (SELECT quantile_cont(r, 0.05) AS cut FROM pf))"
    q["portfolio_summary"] = f"""{port} SELECT count(*) AS days, {_r('arg_max(lw, date)', 'log_wealth')}, {_r('arg_max(lw, date) * 252.0 / count(*)', 'log_growth')}, {_r(vol, 'annualized_volatility')}, {_r(zero(2, sharpe), 'sharpe')}, {_r(zero(2, sortino), 'sortino')},
 {_r('min(dd)', 'max_drawdown')}, {_r(zero(10, var), 'var_95')}, {_r(cv, 'cvar_95')} FROM pd"""
    q["portfolio_risk_decomposition"] = f"""{port}, sg AS (SELECT stddev_samp(r) * sqrt(252) AS s FROM pf), c AS (SELECT symbol, any_value(w) AS w, covar_samp(ret.r, pf.r) * 252 AS c FROM ret JOIN known USING (symbol) JOIN pf USING (date) GROUP BY symbol)
SELECT symbol, {_r('w', 'weight')}, {_r('c / s', 'marginal_risk')}, {_r('w * c / s', 'component_risk')}, {_r('w * c / s / s * 100', 'share_pct')} FROM c, sg"""
    q["benchmark_wealth"] = f"{port} SELECT strftime(pf.date, '%Y-%m-%d') AS date, {_r('sum(ln(1 + pf.r)) OVER (ORDER BY pf.date)', 'log_portfolio')}, {_r('sum(ln(1 + coalesce(b.r, 0))) OVER (ORDER BY pf.date)', 'log_benchmark')} FROM pf JOIN ret b ON b.date = pf.date AND b.symbol = '{benchmark}'"
    # Monthly mean prices instead of daily ones: the same statements over other returns, with what would overflow over days.
    monthly = port.replace(_RETURNS, _RETURNS.replace("FROM bars)", "FROM months)")).replace("ret AS (", "months AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS date, avg(close) AS close FROM bars GROUP BY ALL), ret AS (", 1)
    q["portfolio_monthly"] = f"{monthly} SELECT {_DAY}, {_r('r', 'portfolio_return')}, {_r('lw', 'log_wealth')}, {_r('exp(lw)', 'wealth')}, {_r('dd', 'drawdown')} FROM pd"
    q["portfolio_monthly_summary"] = q["portfolio_summary"].replace(port, monthly).replace(" FROM pd", f", {_r('exp(arg_max(lw, date)) - 1', 'total_return')}, {_r('exp(arg_max(lw, date) * 252.0 / count(*)) - 1', 'cagr')} FROM pd")
    q["benchmark_wealth_monthly"] = f"""{monthly} SELECT date, {_rounded('log_portfolio', 'log_benchmark')}, {_r('exp(log_portfolio)', 'portfolio_wealth')}, {_r('exp(log_benchmark)', 'benchmark_wealth')} FROM (
 SELECT strftime(pf.date, '%Y-%m-%d') AS date, sum(ln(1 + pf.r)) OVER (ORDER BY pf.date) AS log_portfolio, sum(ln(1 + coalesce(b.r, 0))) OVER (ORDER BY pf.date) AS log_benchmark FROM pf JOIN ret b ON b.date = pf.date AND b.symbol = '{benchmark}')"""
    for name in ("q01_asset_performance", "q02_monthly_returns", "q03_volatility_ranking", "q04_drawdown_analysis", "q06_sector_performance", "q07_correlation_summary", "q08_risk_metrics"):
        q[f"{name[:3]}_two_digits"] = q[name].replace(", 6) + 0.0", ", 2) + 0.0")
    faulty = f"""{star}, two AS (SELECT date_key AS k, asset_key AS a FROM fact UNION ALL SELECT date_key, asset_key FROM fact WHERE date_key % 29 = 0),
ff AS (SELECT CASE WHEN k % 19 = 0 THEN NULL WHEN k % 31 = 0 THEN k - 10000000 ELSE k END AS k, CASE WHEN k % 23 = 0 THEN a + 1000 ELSE a END AS a FROM two),
fa AS (SELECT asset_key, CASE WHEN asset_key % 7 <> 0 THEN symbol END AS symbol, CASE WHEN asset_key % 6 = 0 THEN 'bond' ELSE asset_type END AS asset_type FROM (SELECT * FROM assets UNION ALL SELECT * FROM assets WHERE asset_key % 5 = 0))"""
    counted = {
        "check_positive_prices": "SELECT 1 FROM fact WHERE CASE WHEN date_key % 13 = 0 THEN -close ELSE close END <= 0", "check_drawdown_bounds": "SELECT 1 FROM fact WHERE date_key % 17 = 0 OR date_key % 37 = 0",
        "check_unique_asset_key": "SELECT asset_key FROM fa GROUP BY 1 HAVING count(*) > 1", "check_unique_fact_key": "SELECT k, a FROM ff GROUP BY ALL HAVING count(*) > 1", "check_not_null_symbol": "SELECT 1 FROM fa WHERE symbol IS NULL",
        "check_not_null_fact_key": "SELECT 1 FROM ff WHERE k IS NULL OR a IS NULL", "check_accepted_asset_types": "SELECT 1 FROM fa WHERE asset_type NOT IN ('equity', 'etf')",
        "check_fact_asset": "SELECT 1 FROM ff WHERE a IS NOT NULL AND a NOT IN (SELECT asset_key FROM assets)", "check_fact_date": "SELECT 1 FROM ff WHERE k IS NOT NULL AND k NOT IN (SELECT date_key FROM fact)",
    }
    each = " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS violations FROM ({sql})" for name, sql in counted.items())
    q["checks_of_faulty_tables"] = f"{faulty} SELECT name, violations, CASE WHEN violations = 0 THEN 'PASSED' ELSE 'FAILED (' || violations || ' violations)' END AS status FROM ({each})"
    # --- boards
    dd = "rd AS (SELECT *, (close - max(close) OVER (PARTITION BY symbol ORDER BY date)) / max(close) OVER (PARTITION BY symbol ORDER BY date) AS dd FROM ret)"
    perf = f"""SELECT symbol, {_r('(arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) * 100', 'total_return_pct')}, {_r(f'({cagr}) * 100', 'cagr_pct')}, {_r(f'({vol}) * 100', 'annualized_vol_pct')}, {_r(zero(2, sharpe), 'sharpe_ratio')}, {_r('min(dd) * 100', 'max_drawdown_pct')} FROM rd GROUP BY symbol"""
    q["performance_scorecard"] = f"{ret}, {dd} {perf}"
    q["risk_scorecard"] = f"""{ret}, {dd}, {tail} SELECT symbol, {_r(f'({vol}) * 100', 'annualized_vol_pct')}, {_r(zero(2, sharpe), 'sharpe_ratio')}, {_r(zero(2, sortino), 'sortino_ratio')}, {_r('min(dd) * 100', 'max_drawdown_pct')}, {_r(f'({zero(10, var)}) * 100', 'var_95_pct')},
 {_r('min(r) * 100', 'worst_day_pct')}, {_r('any_value(cvar) * 100', 'cvar_95_pct')} FROM rd JOIN cv USING (symbol) GROUP BY symbol"""
    q["top_bottom_leaders"] = f"{ret}, {dd}, p AS ({perf}), o AS (SELECT *, row_number() OVER (ORDER BY total_return_pct DESC, symbol) AS i, row_number() OVER (ORDER BY total_return_pct, symbol DESC) AS j FROM p) SELECT * EXCLUDE (i, j), 'top' AS side FROM o WHERE i <= 2 UNION ALL SELECT * EXCLUDE (i, j), 'bottom' AS side FROM o WHERE j <= 2"
    q["market_kpis"] = f"{gold} SELECT {_r('arg_max(close, date)', 'latest_close')}, {_r('arg_max(volatility_20d, date) * 100', 'latest_vol_pct')}, {_r('(arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) * 100', 'return_pct')}, count(*) AS sessions, (SELECT count(DISTINCT symbol) FROM bars) AS assets, (SELECT count(*) FROM bars) AS rows_total FROM gold WHERE symbol = '{benchmark}'"
    q["returns_pivot"] = f"{ret} SELECT {_DAY}, " + ", ".join(f"round(max(CASE WHEN symbol = '{x}' THEN r END), 6) + 0.0 AS \"{x}\"" for x in sorted(weights)) + " FROM ret GROUP BY ret.date"
    q["data_profile"] = f"WITH {_TYPE} SELECT symbol, count(*) AS n, {_r('min(close)', 'min_close')}, {_r('max(close)', 'max_close')}, {_r('avg(close)', 'mean_close')} FROM bars GROUP BY symbol"
    # --- regimes
    cols = ["daily_return", "return_5d", "return_20d", "return_60d", "volatility_20d", "volatility_60d", "sma_20_ratio", "sma_50_ratio", "sma_200_ratio", "volume_ratio", "drawdown", "momentum_3m", "momentum_6m"]
    w252, wcum = "(ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)", "(ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    half = lambda w, n: f"CASE WHEN count(volatility_60d) OVER {w} >= {n} THEN quantile_cont(volatility_60d, 0.5) OVER {w} END"
    lab = f"""{gold}, md AS (SELECT *, coalesce({half(w252, 60)}, {half(wcum, 30)}) AS md FROM gold WHERE symbol = '{benchmark}'), fl AS (SELECT *, coalesce(volatility_20d <= md, false) AS lo, coalesce(momentum_3m > 0, false) AS up FROM md),
lb AS (SELECT *, CAST(CASE WHEN lo AND up THEN 0 WHEN lo THEN 1 WHEN NOT up THEN 2 ELSE 3 END AS BIGINT) AS regime_target FROM fl WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)}),
la AS (SELECT *, CASE regime_target WHEN 0 THEN 'Low Vol / Bull (Calm Expansion)' WHEN 1 THEN 'Low Vol / Stagnant (Grinding Drift)' WHEN 2 THEN 'High Vol / Bear (Crisis / Selloff)' ELSE 'High Vol / Dynamic Rally (Volatile Rebound)' END AS regime_label,
 CASE WHEN date <= DATE '{split[0]}' THEN 'train' WHEN date <= DATE '{split[1]}' THEN 'val' WHEN date <= DATE '{split[2]}' THEN 'test' END AS part FROM lb)"""
    q["regime_labels"] = f"{lab} SELECT {_DAY}, regime_target, regime_label FROM la"
    q["regime_split_counts"] = f"{lab} SELECT part, count(*) AS n, strftime(min(date), '%Y-%m-%d') AS first_day, strftime(max(date), '%Y-%m-%d') AS last_day FROM la WHERE part IS NOT NULL GROUP BY part"
    q["regime_distribution"] = f"{lab} SELECT regime_target, regime_label, count(*) AS n FROM la GROUP BY ALL"
    q["majority_baseline"] = f"{lab} SELECT regime_target, count(*) AS n FROM la WHERE part = 'train' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"
    return q
