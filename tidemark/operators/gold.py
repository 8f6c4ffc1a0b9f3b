"""The feature store: 22 columns over silver bars. All windows share one shuffle and sort by (symbol, date), or by blocks of long series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import series
from tidemark.functions.columns import YEAR, change, gated, ordered, ratio, so_far

RETURNS = {"daily_return": 1, "return_5d": 5, "return_20d": 20, "return_60d": 60}
MOMENTA = {"momentum_1m": 21, "momentum_3m": 63, "momentum_6m": 126, "momentum_12m": 252}
#: Rows of a window, and values it needs.
VOLATILITIES = {"volatility_20d": (20, 10), "volatility_60d": (60, 30)}
AVERAGES = {"sma_20": (20, 10), "sma_50": (50, 25), "sma_200": (200, 100)}
ABNORMAL = 2.0


def features(silver: DataFrame, gate: bool = True) -> DataFrame:
    """Silver's columns and the 22 features. gate=False: windows give values from their first row on (no warm-up)."""
    running = F.max("close").over(so_far())
    start = F.first("close", ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return _features(silver, gate, running, start)


#: Rows before a row that its features look at.
HALO = max(*MOMENTA.values(), *(n for n, _ in AVERAGES.values()), *(n + 1 for n, _ in VOLATILITIES.values()), 20)


def features_in_blocks(silver: DataFrame, gate: bool = True, rows: int = series.BLOCK_ROWS, cell: Column | None = None) -> DataFrame:
    """The same rows, for series that are too long for one task: a block of `rows` rows is a task's work, whatever the length of its series.

    Frames see the HALO rows before a block; the running maximum and the first price are carried over blocks. cell: see series.numbered.
    """
    blocks = series.in_blocks(series.numbered(silver, series.by_days() if cell is None else cell), HALO, rows)
    # A symbol and a block are one key from here on; all rows of it come from one exchange.
    blocks = blocks.repartition("symbol", "_block")
    before = series.carried(blocks.filter("_own"), "symbol", _peak=(F.max("close"), "max"), _start=(F.min_by("close", F.when(F.col("close").isNotNull(), F.col("_n"))), "first"))
    before = before.select(F.col("symbol").alias("_symbol"), F.col("_block").alias("_of"), "_peak", "_start")
    met = blocks.join(before, F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.col("_block") == F.col("_of"))).drop("_symbol", "_of")
    key = ["symbol", "_block"]
    running = F.greatest(F.max("close").over(so_far(key, "_n")), "_peak")
    return _features(met, gate, running, F.col("_start"), key, "_n").filter("_own").drop("_own", "_block", "_n", "_peak", "_start")


def _features(df: DataFrame, gate: bool, running: Column, start: Column, key="symbol", by: str = "date") -> DataFrame:
    least = lambda n: n if gate else 1
    first = df.withColumns({name: change("close", n, key, by) for name, n in {**RETURNS, **MOMENTA}.items()} | {
        name: gated(F.avg, "close", n, least(k), key, by) for name, (n, k) in AVERAGES.items()
    } | {
        "avg_volume_20d": gated(F.avg, "volume", 20, least(10), key, by),
        "running_max": running,
        "_first": start,
    })
    return first.withColumns(
        {name: gated(F.stddev_samp, "daily_return", n, least(k), key, by) * YEAR for name, (n, k) in VOLATILITIES.items()}
        | {f"{name}_ratio": ratio("close", name) for name in AVERAGES}
        | {
            "volume_ratio": F.when(F.col("avg_volume_20d") > 0, F.col("volume") / F.col("avg_volume_20d")).otherwise(1.0),
            "drawdown": (F.col("close") - F.col("running_max")) / F.nullif("running_max", F.lit(0.0)),
            "cumulative_return": (F.col("close") - F.col("_first")) / F.nullif("_first", F.lit(0.0)),
        }
    ).withColumn("is_abnormal_volume", (F.col("volume_ratio") > ABNORMAL).cast("int")).drop("_first")


FEATURES = [*RETURNS, *VOLATILITIES, *AVERAGES, *(f"{x}_ratio" for x in AVERAGES), "avg_volume_20d", "volume_ratio", "is_abnormal_volume", "running_max", "drawdown", *MOMENTA, "cumulative_return"]
