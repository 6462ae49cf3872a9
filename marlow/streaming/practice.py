"""Streaming variants of batch operators; an extension, the batch forms are the reference semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def daily_rollup(records: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts by user and day of event time; rows later than ``late`` are left out."""
    w = F.window("submit_time", "1 day")
    g = records.withWatermark("submit_time", late).groupBy("user_id", w.alias("w"))
    return g.agg(F.count("*").alias("submits"), F.count_if(F.col("verdict") == "OK").alias("accepted")).select("user_id", F.to_date("w.start").alias("stat_date"), "submits", "accepted")


def distinct_submissions(records: DataFrame, late: str = "1 day") -> DataFrame:
    return records.withWatermark("submit_time", late).dropDuplicatesWithinWatermark(["platform", "id"])


def sessions(records: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Practice sessions: submissions of a user with less than ``gap`` between them."""
    g = records.withWatermark("submit_time", late).groupBy("user_id", F.session_window("submit_time", gap).alias("w"))
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n")
