"""Long series in many tasks: numbering rows, blocks with a halo of the rows before them, and what blocks carry to later ones.

A window over a whole series is one task for each symbol. Here a series is first numbered by cells of time (a cell's rows are
counted and sorted by themselves, and the counts of earlier cells are added), then cut into blocks of equal numbers of rows. Each block also gets
the last rows of the block before it, as many as the longest frame needs, so that frames of rows come out as over the whole series. What has
no bounded frame (a running maximum, the first value) is one number for each block, carried on over the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a cell, and rows of a block. A cell's rows are sorted by one task, so denser series want shorter cells.
CELL_DAYS, BLOCK_ROWS = 366, 100_000


def by_days(by: str = "date", days: int = CELL_DAYS) -> Column:
    """A cell of time: whole periods of so many days. Rows without a time are in a cell before all others."""
    return F.coalesce(F.floor(F.datediff(F.col(by), F.lit("1970-01-01")) / days), F.lit(-(10**9))).cast("long")


def numbered(df: DataFrame, cell: Column, key: str = "symbol", by: str = "date", name: str = "_n") -> DataFrame:
    """Adds each row's number within its series, from 0 in the order of `by`; rows of equal times in any order. The cells must follow that order.

    df is shuffled once, by (key, cell): the counts are taken from the same exchange, and they meet the rows there again.
    """
    rows = df.withColumn("_cell", cell).repartition(key, "_cell")
    earlier = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(key, "_cell").agg(F.count("*").alias("_rows"))
    starts = counts.select(F.col(key).alias("_key"), F.col("_cell").alias("_of"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(key, "_cell").orderBy(by))
    met = rows.withColumn("_within", within).join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_cell") == F.col("_of")))
    return met.withColumn(name, (F.col("_start") + F.col("_within") - 1).cast("long")).drop("_cell", "_within", "_key", "_of", "_start")


def in_blocks(df: DataFrame, halo: int, rows: int = BLOCK_ROWS, name: str = "_n") -> DataFrame:
    """Adds _block, and _own: false for the copies of a block's last `halo` rows that the next block gets."""
    if not 0 <= halo <= rows:
        raise ValueError("a halo is at most a block")
    block = F.floor(F.col(name) / rows).cast("long")
    places = F.when(F.col(name) % rows >= rows - halo, F.array(block, block + 1)).otherwise(F.array(block))
    return df.withColumn("_block", F.explode(places)).withColumn("_own", F.col("_block") == block)


def carried(blocks: DataFrame, key: str, **values: tuple[Column, str]) -> DataFrame:
    """(key, _block, names): for each name the aggregate of a block's own rows, carried on as 'max' or 'first' (that of the first block that has one) over the blocks before.

    One row for each block, so the window over a series' blocks is small.
    """
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = blocks.groupBy(key, "_block").agg(*[x.alias(f"_own_{name}") for name, (x, _) in values.items()])
    over = {"max": lambda c: F.max(c).over(earlier), "first": lambda c: F.first(c, ignorenulls=True).over(whole)}
    return own.select(key, "_block", *[over[how](f"_own_{name}").alias(name) for name, (_, how) in values.items()])
