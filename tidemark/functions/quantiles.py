"""Exact quantiles by refined histograms: no task holds all values of a group.

A wanted rank's value lies in an interval that starts as the group's range. While an interval holds many rows it is cut into
BUCKETS equal parts, rows are counted by part (partial counts in each task), and the part that holds the rank becomes the interval. Then the few
rows that are left are numbered and the rank's one is picked. Groups that are small from the start need no round of counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut

#: Rows of an interval that one task may number, and parts of an interval.
ENOUGH, BUCKETS = 20_000, 4_096


def at_ranks(df: DataFrame, value: str, wanted: DataFrame, key: str = "symbol", enough: int = ENOUGH, buckets: int = BUCKETS) -> DataFrame:
    """(key, rank, value) for each wanted (key, rank), ranks from 1 in ascending order; missing and NaN values have none, and ranks beyond a group are left out."""
    rows = df.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)")
    spans = rows.groupBy("_k").agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count("*").alias("inside"))
    state = wanted.select(F.col(key).alias("_k"), F.col("rank").cast("long").alias("rank")).distinct().join(spans, "_k").filter("rank BETWEEN 1 AND inside").withColumn("below", F.lit(0).cast("long"))
    state = cut(state)
    # An interval of one value is settled, however many rows have it.
    while state.filter((F.col("inside") > enough) & (F.col("low") < F.col("high"))).limit(1).count():
        large = state.filter((F.col("inside") > enough) & (F.col("low") < F.col("high")))
        spans = large.select("_k", "low", "high").distinct()
        width = (F.col("high") - F.col("low")) / buckets
        part = F.least(F.greatest(F.floor((F.col("_v") - F.col("low")) / width), F.lit(0)), F.lit(buckets - 1)).cast("int")
        counts = rows.join(spans, "_k").filter("_v BETWEEN low AND high").groupBy("_k", "low", "high", part.alias("part")).agg(F.count("*").alias("n"), F.min("_v").alias("a"), F.max("_v").alias("b"))
        before = Window.partitionBy("_k", "low", "high").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        finer = large.join(counts, ["_k", "low", "high"]).filter((F.col("rank") > F.col("below") + F.col("before")) & (F.col("rank") <= F.col("below") + F.col("before") + F.col("n")))
        finer = finer.select("_k", "rank", F.col("a").alias("low"), F.col("b").alias("high"), F.col("n").alias("inside"), (F.col("below") + F.col("before")).alias("below"))
        state = cut(state.filter((F.col("inside") <= enough) | (F.col("low") >= F.col("high"))).unionByName(finer))
    settled = state.filter(F.col("low") >= F.col("high")).select("_k", "rank", F.col("low").alias("v"))
    open_ = state.filter(F.col("low") < F.col("high"))
    spans = open_.select("_k", "low", "high").distinct()
    place = F.row_number().over(Window.partitionBy("_k", "low", "high").orderBy("_v"))
    numbered = rows.join(spans, "_k").filter("_v BETWEEN low AND high").withColumn("place", place)
    picked = numbered.join(open_, ["_k", "low", "high"]).filter(F.col("place") == F.col("rank") - F.col("below")).select("_k", "rank", F.col("_v").alias("v"))
    return settled.unionByName(picked).select(F.col("_k").alias(key), "rank", F.col("v").alias(value))


def quantile(df: DataFrame, value: str, share: float, key: str = "symbol", name: str = "quantile", **limits: int) -> DataFrame:
    """(key, n, name): the number of values of each group and their quantile, interpolated between the two values beside its place."""
    place = F.col("_n") - 1
    counts = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(key).agg(F.count("*").alias("_n")).withColumn("_p", place * share)
    counts = cut(counts.withColumn("_low", F.floor("_p") + 1).withColumn("_high", F.ceil("_p") + 1))
    wanted = counts.select(key, F.explode(F.array("_low", "_high")).alias("rank"))
    found = at_ranks(df, value, wanted, key, **limits)
    side = lambda c: found.select(key, F.col("rank").alias(c), F.col(value).alias(f"{c}_v"))
    both = counts.join(side("_low"), [key, "_low"]).join(side("_high"), [key, "_high"])
    upper: Column = F.col("_p") - F.floor("_p")
    return both.select(key, F.col("_n").alias("n"), F.when(F.col("_low") == F.col("_high"), F.col("_low_v")).otherwise((1 - upper) * F.col("_low_v") + upper * F.col("_high_v")).alias(name))
