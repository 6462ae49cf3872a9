"""Duplicates by key, digest, prefix and rolling hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlow.functions.text import utf16_units


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in this order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def exact_groups(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    return df.groupBy(*keys, F.md5(F.col(text).cast("binary")).alias("digest")).agg(F.count("*").alias("n")).where("n > 1")


def prefix_groups(df: DataFrame, text: str, width: int, key: str = "id") -> DataFrame:
    return df.groupBy(F.left(F.col(text), F.lit(width)).alias("head")).agg(F.count("*").alias("n"), F.min(key).alias("first_id")).where("n > 1")


def rolling_hash(text: Column, width: int = 200, buckets: int = 100_000) -> Column:
    """The 32-bit hash h * 31 + unit over the first ``width`` UTF-16 units, its absolute value modulo ``buckets``. A
    character above U+FFFF is two units, of which the cut may keep one."""
    h = F.aggregate(utf16_units(text, width), F.lit(0).cast("long"), lambda acc, u: F.pmod(acc * 31 + u, F.lit(1 << 32)))
    return F.abs(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)) % buckets
