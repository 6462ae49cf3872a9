"""User profiles: six dimensions, style, strengths and weaknesses, for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlow.functions import scores as S


def base_stats(records: DataFrame, as_of: Column) -> DataFrame:
    """One row a user: counts, means, ceiling (P90, linear; 0 under five rows), days since the last."""
    ok = F.col("verdict") == "OK"
    n = F.count("*")
    return records.groupBy("user_id").agg(
        n.alias("total"), F.count_if(ok).alias("accepted"), F.avg("difficulty").alias("avg_difficulty"), F.avg(F.col("first_ac").cast("int")).alias("first_ac_rate"),
        F.avg("retries").alias("avg_retries"), F.when(n < 5, 0.0).otherwise(F.percentile("difficulty", 0.9)).alias("ceiling"),
        F.greatest(F.lit(0.0), (F.unix_timestamp(as_of) - F.unix_timestamp(F.max("submit_time"))) / 86400).alias("days_since"),
    )


def tag_stats(records: DataFrame) -> DataFrame:
    """``user_id, unique_tags, top3``: distinct tags, and the counts of the three most frequent."""
    n = records.select("user_id", F.explode("tags").alias("tag")).groupBy("user_id", "tag").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("n").desc(), "tag"))
    return n.withColumn("k", k).groupBy("user_id").agg(F.count("*").alias("unique_tags"), F.sum(F.when(F.col("k") <= 3, F.col("n"))).alias("top3"))


def momentum(stats: DataFrame, window: int = 30) -> DataFrame:
    """``user_id, momentum``: slope of accepted per day over the last points by position, / 0.5, in [-1, 1]."""
    daily = stats.groupBy("user_id", "stat_date").agg(F.sum("ac_count").alias("ac"))
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("stat_date").desc()))
    tail = daily.withColumn("x", -back).where(F.col("x") >= -window)
    return tail.groupBy("user_id").agg(S.momentum(F.regr_slope(F.col("ac").cast("double"), F.col("x").cast("double"))).alias("momentum"))


def category_coverage(records: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``user_id, category, coverage`` for every user and category; taxonomy has ``tag, category``."""
    sizes = taxonomy.groupBy("category").agg(F.count_distinct("tag").alias("size"))
    users = records.select("user_id").distinct()
    have = records.select("user_id", F.explode("tags").alias("tag")).distinct().join(F.broadcast(taxonomy), "tag").groupBy("user_id", "category").agg(F.count("*").alias("n"))
    # the taxonomy is a fixed list of categories
    return users.crossJoin(F.broadcast(sizes)).join(have, ["user_id", "category"], "left").select("user_id", "category", F.coalesce(F.col("n") / F.col("size"), F.lit(0.0)).alias("coverage"))


def strengths_weaknesses(coverage: DataFrame, n: int = 5) -> DataFrame:
    """``user_id, strengths, weaknesses``: arrays of (category, coverage): the best above 0, best first; the
    last below 1, weakest first."""
    best = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("coverage").desc(), "category"))
    worst = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("coverage").asc(), F.col("category").desc()))
    ranked = coverage.withColumn("b", best).withColumn("w", worst)
    item = F.struct("category", "coverage")
    pick = lambda rank, cond: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct(rank, item.alias("item"))))), lambda x: x["item"])
    return ranked.groupBy("user_id").agg(
        pick(F.col("b"), (F.col("b") <= n) & (F.col("coverage") > 0)).alias("strengths"), pick(F.col("w"), (F.col("w") <= n) & (F.col("coverage") < 1)).alias("weaknesses"),
    )


def profile(records: DataFrame, stats: DataFrame, n_tags: int, as_of: Column) -> DataFrame:
    """Dimensions of each user; ``n_tags`` is the number of known tags."""
    df = base_stats(records, as_of).join(tag_stats(records), "user_id", "left").join(momentum(stats), "user_id", "left")
    tags, acc = F.coalesce("unique_tags", F.lit(0)), F.col("accepted")
    df = df.withColumn("coverage", F.least(tags / n_tags, F.lit(1.0))).withColumn("proficiency", S.proficiency(acc, F.col("total"), F.col("avg_difficulty"), F.col("days_since")))
    df = df.withColumn("efficiency", S.efficiency(F.col("first_ac_rate"), F.col("avg_retries"))).withColumn("momentum", F.coalesce("momentum", F.lit(0.0)))
    df = df.withColumn("style", S.style(acc, tags, S.safe_div(F.col("top3"), acc), F.col("avg_difficulty")))
    return df.withColumn("overall", S.overall(*(F.col(c) for c in ("coverage", "proficiency", "ceiling", "efficiency", "style", "momentum"))))
