"""Layers on disk: Parquet with a CSV copy, a configuration of instruments, and SQL text or files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidemark.sources import publication

BARS = StructType([StructField("symbol", StringType()), StructField("date", StringType()), *(StructField(c, DoubleType()) for c in ("open", "high", "low", "close", "adjusted_close")), StructField("volume", LongType())])
BRONZE = StructType([*BARS.fields, *(StructField(c, StringType()) for c in ("ingestion_timestamp", "source", "batch_id"))])
SILVER_COLUMNS = BRONZE.fieldNames()


def read_layer(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType = BARS) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_layer(df: DataFrame, path: str, csv_path: str | None = None, partition_by: list[str] | None = None) -> None:
    """Overwrites a layer. The CSV copy is written from the stored Parquet, so the plan runs once."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    if csv_path:
        df.sparkSession.read.parquet(path).write.mode("overwrite").csv(csv_path, header=True)


def save_bucketed(df: DataFrame, table: str, buckets: int, key: str = "symbol", by: str = "date") -> None:
    """Replaces a table of the catalog, dealt into buckets by the key and sorted by (key, by) within each: one file for each bucket.

    Windows over the key, and joins and groups by it, then need no exchange, which is what indexes on these columns are for elsewhere. A bucket is a task's work, so take about as many as tasks; symbols beyond a task's size want gold.features_in_blocks.
    """
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key, by).saveAsTable(table)


def write_raw(df: DataFrame, folder: str, stamp: str) -> str:
    """Publishes a raw batch as `raw_<stamp>` and as `latest`: one run of the plan and one copy, and the batch before stays readable until both are there."""
    return publication.publish(df, folder, f"raw_{stamp}", publication.LATEST)


def wide_to_long(wide: DataFrame, symbols: list[str], fields: list[str], date: str = "date") -> DataFrame:
    """Columns `<symbol>_<field>` of a wide table become rows, from one scan; rows without any value go."""
    one = F.array(*[F.struct(F.lit(s).alias("symbol"), *[F.col(f"{s}_{f}").alias(f) for f in fields]) for s in symbols])
    return wide.select(F.col(date).alias("date"), F.inline(one)).select("symbol", "date", *fields).na.drop(how="all", subset=fields)


def instruments(spark: SparkSession, path: str) -> DataFrame:
    """Instruments of a JSON or YAML file {assets: [...]}, in its order, with asset_key from 1. A small file of the driver."""
    text = Path(path).read_text()
    if path.endswith((".yml", ".yaml")):
        import yaml

        assets = yaml.safe_load(text)["assets"]
    else:
        assets = json.loads(text)["assets"]
    names = ["symbol", "asset_name", "asset_type", "sector", "industry", "currency", "exchange"]
    rows = [(i + 1, *(a.get(n, "USD" if n == "currency" else None) for n in names)) for i, a in enumerate(assets)]
    return spark.createDataFrame(rows, "asset_key int, " + ", ".join(f"{n} string" for n in names))


def run_sql(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """The views exist for this statement only; views of the session by their names come back afterwards."""
    before = {name: spark.table(name) for name in views if name.lower() in {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(sql)
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
        for name, df in before.items():
            df.createOrReplaceTempView(name)


def run_sql_file(spark: SparkSession, path: str, **views: DataFrame) -> DataFrame:
    return run_sql(spark, Path(path).read_text(), **views)


def append(df: DataFrame, table: str) -> None:
    """Adds rows to a table of the catalog by the names of its columns; the table is made if there is none."""
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        df.select(spark.table(table).columns).write.insertInto(table)
    else:
        df.write.format("parquet").saveAsTable(table)


def write_text(spark: SparkSession, text: str, folder: str) -> None:
    """A small text (a report, metrics as JSON) as one file of a folder that any file system of Spark may hold."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(folder)
