"""The batch: bronze, silver, gold, star, models, checks, as pure stages over one session; layers are stored between them."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import checks, gold, silver, star
from tidemark.plans import models
from tidemark.plans.analytics import Star
from tidemark.sources import files, publication


def run(spark: SparkSession, bronze: DataFrame, folder: str, order: str = "ingest_seq", database: str | None = None) -> dict:
    """Publishes layers and models below folder and returns seconds by stage, the metrics of cleaning, and check results.

    Each is a new version beside the ones before (see sources.publication): a batch that fails half-way leaves every layer readable as it was.
    With a database, the star is also loaded into its declared tables there, which are emptied first and refuse rows that break a key.
    """
    seconds, began = {}, time.time()

    def stored(name: str, df: DataFrame, **options) -> DataFrame:
        nonlocal began
        publication.publish(df, f"{folder}/{name}", **options)
        seconds[name], began = round(time.time() - began, 3), time.time()
        return publication.published(spark, f"{folder}/{name}", schema=df.schema)

    raw = stored("bronze", bronze)
    # Cleaning and its record are one job over bronze; the layer is what that job stored, with ranges mended and in order.
    kept, record = silver.Silver(raw, order).clean_and_metrics(lambda df: stored("silver_kept", df))
    clean = stored("silver", kept.orderBy("symbol", "date"))
    metrics = record.first().asDict()
    files.write_text(spark, silver.report(metrics), f"{folder}/quality_report")
    features = stored("gold", gold.features(clean.withColumn("date", F.to_date("date"))))
    star_frames = Star.of(clean.withColumn("date", F.to_date("date")))
    star_frames = Star(stored("dim_asset", star_frames.assets), stored("dim_date", star_frames.dates), stored("fact_market_daily", star_frames.fact))
    if database:
        star.create_tables(spark, database)
        for name in star.TABLES:
            spark.sql(f"TRUNCATE TABLE {database}.{name}")
        for name, df in (("dim_asset", star_frames.assets), ("dim_date", star_frames.dates), ("fact_market_daily", star_frames.fact)):
            star.load_table(df, database, name)
    frames = models.registry.run(models.sources(star_frames), save=stored)
    results = {r.name: r.status for r in checks.results(models.tests(frames)).collect()}  # a row for each check
    return {"seconds": seconds, "metrics": metrics, "checks": results, "report": silver.report(metrics), "gold": features}
