"""The driver's contract, also without the subpackage on training data."""

import builtins
import importlib
import sys
from pathlib import Path

import pytest

from tidemark import registry

ROOT = Path(__file__).resolve().parent.parent


def test_every_market_query_has_sql_but_for_trained_models():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"regime_predictions", "confusion_matrix", "regime_scores", "regime_champion"}
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_point():
    import __spark_entry__ as entry

    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found) and "q01_asset_performance" in found
    if (ROOT / "tidemark/llm/registry.py").exists() and (ROOT / "corpus_pipeline.py").exists():
        assert [n for n in range(1, 14) if not any(x.startswith(f"op{n}_") for x in found)] == [] and "pipeline" in found


def test_entry_point_without_the_subpackage(monkeypatch):
    own = builtins.__import__

    def blocked(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith(("tidemark.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name=name)
        return own(name, globals, locals, fromlist, level)

    for name in [x for x in sys.modules if x.startswith(("tidemark.llm", "corpus_pipeline")) or x == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", blocked)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) == set(registry.oracle_sql())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["q01_asset_performance", "q05_volume_anomalies", "gold_features", "silver_metrics", "mart_risk_dashboard", "portfolio_summary", "max_drawdown_path", "check_fact_asset"])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    ours, theirs = registry.queries()[name](spark, "/root/testdata/sf0.001").toPandas(), con.sql(registry.oracle_sql()[name]).df()
    text = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist()))
    plain = lambda df: df.apply(lambda c: c.astype(float) if c.dtype.kind in "if" else c)
    assert text(plain(ours)) == text(plain(theirs))


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", [
    "gold_features", "dim_asset", "dim_date", "fact_market_daily", "q01_asset_performance", "q04_drawdown_analysis", "q07_correlation_summary", "q08_risk_metrics", "mart_monthly_performance", "mart_risk_dashboard", "check_fact_asset",
    "checks_of_faulty_tables", "var_hist", "cvar", "corr_pearson", "corr_spearman", "portfolio_daily", "portfolio_summary", "portfolio_risk_decomposition", "portfolio_monthly_summary", "benchmark_wealth", "benchmark_wealth_monthly", "market_kpis",
    "top_bottom_leaders", "max_drawdown_path", "regime_labels", "regime_distribution",
])
def test_trades_are_read_once_at_most_by_what_a_query_returns(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "l_shipdate" in line for line in plan.splitlines()) <= 1
