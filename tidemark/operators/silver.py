"""Cleaning of bronze bars and the record of what was found: lazy plans, one aggregate for the record."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

PRICES = ["open", "high", "low", "close"]
TOLERANCE, SURGE, COLLAPSE = 0.001, 1.5, -0.85
_BLANKS = " \t\n\r\x0b\x0c"


def first_of_each(bronze: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Keeps the first row of each (symbol, date) by a column that orders the input; before any normalisation."""
    w = Window.partitionBy("symbol", "date").orderBy(order)
    return bronze.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def normalised(df: DataFrame) -> DataFrame:
    return df.withColumn("symbol", F.upper(F.btrim("symbol", F.lit(_BLANKS)))).withColumn("date", F.date_format(F.to_date("date"), "yyyy-MM-dd"))


def _violation() -> Column:
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return (F.col("high") < top - TOLERANCE) | (F.col("low") > bottom + TOLERANCE) | (F.col("high") < F.col("low"))


@dataclass
class Silver:
    """Steps that share their beginnings; nothing runs until one is used."""

    bronze: DataFrame
    order: str = "ingest_seq"

    @property
    def unique(self) -> DataFrame:
        return normalised(first_of_each(self.bronze, self.order))

    @property
    def complete(self) -> DataFrame:
        return self.unique.na.drop(subset=["symbol", "date", *PRICES])

    @property
    def positive(self) -> DataFrame:
        return self.complete.filter(" AND ".join(f"{c} > 0" for c in PRICES)).withColumn("volume", F.when(F.col("volume") < 0, 0).otherwise(F.col("volume")).cast("long"))

    def clean(self) -> DataFrame:
        """If any row breaks the order of its prices, every row's range is widened to its open and close."""
        broken = self.positive.agg(F.coalesce(F.max(_violation().cast("int")), F.lit(0)).alias("_broken"))
        top, bottom = F.greatest("high", "open", "close"), F.least("low", "open", "close")
        return (
            self.positive.join(F.broadcast(broken))  # one row
            .withColumn("high", F.when(F.col("_broken") > 0, top).otherwise(F.col("high")))
            .withColumn("low", F.when(F.col("_broken") > 0, bottom).otherwise(F.col("low"))).drop("_broken", self.order)
        )

    def ordered(self) -> DataFrame:
        """The clean rows by symbol and date, as a stored layer has them."""
        return self.clean().orderBy("symbol", "date")

    def _marked(self) -> DataFrame:
        """All rows, normalised, with marks for what cleaning would keep: _first, _complete, _ok, and the change against the last kept close."""
        first = F.col("_n") == 1
        complete = first & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("symbol", "date", *PRICES)])
        ok = complete & F.expr(" AND ".join(f"{c} > 0" for c in PRICES))
        rows = normalised(self.bronze.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "date").orderBy(self.order))))
        rows = rows.withColumn("_first", first).withColumn("_complete", complete).withColumn("_ok", F.coalesce(ok, F.lit(False)))
        earlier = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
        before = F.last(F.when(F.col("_ok"), F.col("close")), ignorenulls=True).over(earlier)
        return rows.withColumn("_change", F.when(F.col("_ok"), (F.col("close") - before) / before))

    @staticmethod
    def _counts() -> list[Column]:
        """The record's numbers as aggregates of marked rows, none of them distinct: a set of symbols stands for their number."""
        count = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
        missing = lambda c: count(F.col("_first") & F.col(c).isNull())
        good = lambda c: F.when(F.col("_ok"), F.col(c))
        return [
            F.count(F.lit(1)).alias("total_rows_ingested"), count(~F.col("_first")).alias("duplicate_records_removed"), missing("close").alias("missing_close_prices"),
            (missing("open") + missing("high") + missing("low")).alias("missing_open_high_low"), missing("volume").alias("missing_volumes"),
            count(F.col("_complete") & ~F.col("_ok")).alias("non_positive_price_records"), count(F.col("_ok") & (F.col("volume") < 0)).alias("negative_volume_records"),
            count(F.col("_ok") & _violation()).alias("invalid_ohlc_relationships_reconciled"), count((F.col("_change") > SURGE) | (F.col("_change") < COLLAPSE)).alias("extreme_price_anomalies"),
            count(F.col("_ok")).alias("silver_clean_rows"), F.size(F.collect_set(good("symbol"))).cast("long").alias("distinct_symbols"),
            *[F.date_format(f(F.to_date(good("date"))), "yyyy-MM-dd").alias(name) for f, name in ((F.min, "start_date"), (F.max, "end_date"))],
        ]

    def metrics(self) -> DataFrame:
        """One row, from one pass: rows are marked instead of dropped, and every count is a condition of one aggregate."""
        return _rated(self._marked().agg(*self._counts()))

    def clean_and_metrics(self, store: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """The rows of clean() and the row of metrics() from one job: the record is observed while `store` writes what is kept (it returns the stored frame).

        Whether any row breaks the order of its prices is known only then, so ranges are widened, if they have to be, when the stored rows are read.
        """
        seen = Observation()
        kept = self._marked().observe(seen, *self._counts()).filter("_ok").select(*[c for c in self.bronze.columns if c != self.order])
        stored = store(kept.withColumn("volume", F.when(F.col("volume") < 0, 0).otherwise(F.col("volume")).cast("long")))
        found = seen.get
        if found["invalid_ohlc_relationships_reconciled"]:
            stored = stored.withColumns({"high": F.greatest("high", "open", "close"), "low": F.least("low", "open", "close")})
        kinds = ", ".join(f"{c} {'string' if c.endswith('_date') else 'long'}" for c in found)
        return stored, _rated(self.bronze.sparkSession.createDataFrame([tuple(found.values())], kinds))


def _rated(found: DataFrame) -> DataFrame:
    return found.withColumn("quality_pass_rate_pct", F.round(F.col("silver_clean_rows") / F.nullif(F.col("total_rows_ingested"), F.lit(0)) * 100.0, 4))


def report(metrics: dict) -> str:
    """The record as Markdown, with a status that follows from each number."""
    lines = ["# Data quality", "", "| Measure | Value | Status |", "|-|-|-|"]
    defects = {k for k in metrics if k.startswith(("duplicate", "missing", "non_positive", "negative", "invalid", "extreme"))}
    for k, v in metrics.items():
        lines.append(f"| {k} | {v} | {'-' if k not in defects else 'PASSED' if not v else 'FOUND'} |")
    return "\n".join(lines) + "\n"
