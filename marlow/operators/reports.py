"""Daily and weekly reports, heat map, streaks, job summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlow.sources.shared import stored


def daily_report(records: DataFrame, as_of: str) -> DataFrame:
    """Totals of the day before ``as_of`` and the acceptance rate as text."""
    day = records.where(F.col("stat_date") == F.date_sub(F.lit(as_of).cast("date"), 1))
    g = day.agg(F.count("*").alias("submits"), F.count_if(F.col("verdict") == "OK").alias("accepted"))
    rate = F.when(F.col("submits") == 0, "0%").otherwise(F.format_string("%.1f%%", F.lit(100.0) * F.col("accepted") / F.col("submits")))
    return g.withColumn("rate", rate)


def user_stats(records: DataFrame) -> DataFrame:
    """``user_id, total, accepted, mean_difficulty, first_rate, mean_retries, n_tags``: a record counts once, however many tags
    it has, or none; tags are counted apart. The mean difficulty is of six digits' decimals, so that it doesn't depend
    on the order in which rows are added."""
    tags = records.select("user_id", F.explode("tags").alias("tag")).groupBy("user_id").agg(F.count_distinct("tag").alias("n_tags"))
    g = records.groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("verdict") == "OK").alias("accepted"), (F.sum(F.col("difficulty").cast("decimal(20,6)")).cast("double") / F.count("difficulty")).alias("mean_difficulty"),
        F.avg(F.col("first_ac").cast("int")).alias("first_rate"), F.avg("retries").alias("mean_retries"),
    )
    return g.join(tags, "user_id", "left").withColumn("n_tags", F.coalesce("n_tags", F.lit(0)))


def by_pattern(df: DataFrame, text: str, pattern: str, id_col: str) -> DataFrame:
    """``key, n, first, last, ids``: rows by what the pattern's group finds, with the ids of a group in order; rows in which it
    finds nothing are left out."""
    key = F.regexp_extract(text, pattern, 1)
    return df.where(key != "").groupBy(key.alias("key")).agg(
        F.count("*").alias("n"), F.min(id_col).alias("first"), F.max(id_col).alias("last"), F.sort_array(F.collect_list(id_col)).alias("ids"),
    )


def chunks(rows: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """``group, chunk, items``: rows of each group in order, ``size`` to a chunk (the last may have fewer).

    A group's rows are numbered without one task having them all: rows are put in ranges of (group, order), numbered in
    their range, and a range starts where those before it end. Only rows that are equal in all of ``order`` share a range.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("__at", F.monotonically_increasing_id())
    # numbers are read more than once, and ranges are drawn anew each time: so they are written
    ranged = stored(ranged.withColumn("__part", F.shiftright("__at", 33)), "chunks")
    parts = ranged.groupBy(group, "__part").agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), "__first", F.coalesce(before, F.lit(0)).alias("__start"))
    at = ranged.join(starts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p"))).withColumn("__place", F.col("__start") + F.col("__at") - F.col("__first"))
    item = F.struct("__place", *[c for c in rows.columns if c != group])
    g = at.groupBy(group, F.floor(F.col("__place") / size).alias("chunk")).agg(F.sort_array(F.collect_list(item)).alias("items"))  # ``size`` at most
    return g.select(group, "chunk", F.transform("items", lambda x: x.dropFields("__place")).alias("items"))


def _week(stats: DataFrame, as_of: str) -> DataFrame:
    return stats.where(F.col("stat_date") >= F.date_sub(F.lit(as_of).cast("date"), 7))


def weekly_report(stats: DataFrame, as_of: str) -> DataFrame:
    return _week(stats, as_of).agg(F.sum("submit_count").alias("submits"), F.sum("ac_count").alias("accepted"), F.count_distinct("user_id").alias("active_users"))


def weekly_top_rows(stats: DataFrame, as_of: str, limit: int = 5) -> DataFrame:
    """The best daily rows of the week, not summed by user."""
    return _week(stats, as_of).orderBy(F.col("ac_count").desc(), "user_id", "platform", "stat_date").limit(limit).select("user_id", "platform", "stat_date", "ac_count")


def weekly_leaderboard(stats: DataFrame, as_of: str, limit: int = 5) -> DataFrame:
    return _week(stats, as_of).groupBy("user_id").agg(F.sum("ac_count").alias("ac")).orderBy(F.col("ac").desc(), "user_id").limit(limit)


def heat_map(records: DataFrame, first: str, last: str) -> DataFrame:
    """Every day of the span with its week (Monday), count and shade 0 to 4 by quarters of the best day."""
    spark = records.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    counts = records.groupBy(F.col("stat_date").alias("day")).agg(F.count("*").alias("n"))
    best = counts.agg(F.max("n").alias("m"))
    n = F.coalesce("n", F.lit(0))
    shade = F.when(n == 0, 0).otherwise(F.least(F.ceil(n * 4 / F.col("m")), F.lit(4))).cast("int")
    return days.join(counts, "day", "left").crossJoin(F.broadcast(best)).select(F.date_trunc("week", "day").cast("date").alias("week"), "day", n.alias("n"), shade.alias("shade"))


def streaks(records: DataFrame, as_of: str) -> DataFrame:
    """Longest run of days, and the run that reaches ``as_of`` or the day before."""
    days = records.select("user_id", "stat_date").distinct()
    island = F.date_sub("stat_date", F.row_number().over(Window.partitionBy("user_id").orderBy("stat_date")))
    runs = days.withColumn("island", island).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.max("stat_date").alias("last"))
    now = F.when(F.col("last") >= F.date_sub(F.lit(as_of).cast("date"), 1), F.col("n")).otherwise(0)
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"), F.max(now).alias("current_streak"))


def summary(records: DataFrame) -> DataFrame:
    solved = F.count_distinct(F.when(F.col("verdict") == "OK", F.col("problem_id")))
    g = records.groupBy("user_id").agg(
        F.round(F.count_if(F.col("verdict") == "OK") / F.count("*"), 6).alias("acceptance"), solved.alias("solved"), F.count_distinct("problem_id").alias("attempted"),
    )
    # Rank by way of the counts of each score: the window runs over distinct scores, not over users.
    steps = g.groupBy("solved").agg(F.count("*").alias("n"))
    below = steps.withColumn("below", F.coalesce(F.sum("n").over(Window.orderBy("solved").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = g.agg(F.count("*").alias("total"))
    ranked = below.crossJoin(F.broadcast(total)).select("solved", F.when(F.col("total") > 1, F.col("below") / (F.col("total") - 1)).otherwise(0.0).alias("percentile"))
    return g.join(ranked, "solved").select("user_id", "acceptance", "solved", "attempted", F.round("percentile", 6).alias("percentile"))


def job_summary(records: DataFrame, as_of: str, idle_minutes: int = 30) -> DataFrame:
    """Errors, duration and whether the last sign of life is over ``idle_minutes`` old, by user."""
    last = F.max("submit_time")
    return records.groupBy("user_id").agg(
        F.count_if(F.col("verdict") == "RE").alias("errors"), (F.unix_timestamp(last) - F.unix_timestamp(F.min("submit_time"))).alias("seconds"),
        (last < F.lit(as_of).cast("timestamp") - F.make_interval(mins=F.lit(idle_minutes))).alias("stale"),
    )


def card(report: DataFrame, title: str) -> DataFrame:
    """A report row as the JSON of a message card and as Markdown."""
    cells = [F.concat(F.lit(f"**{c}**: "), F.col(c).cast("string")) for c in report.columns]
    return report.select(F.to_json(F.struct(F.lit(title).alias("title"), F.struct(*report.columns).alias("fields"))).alias("card"), F.concat_ws("\n", F.lit(f"# {title}"), *cells).alias("markdown"))


def progress(steps: DataFrame, key: str, at: str, total: str, over: int = 10) -> DataFrame:
    """``steps`` (a row for each item that is done, in the order of ``at``, then ``id``) with ``done``, the moving
    ``rate`` of the last ``over`` items (a second; null until there are so many, or if no time passed) and ``eta``, the seconds that what is left of
    ``total`` takes at that rate."""
    w = Window.partitionBy(key).orderBy(at, "id")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    seconds = (micros(F.col(at)) - micros(F.lag(at, over).over(w))) / 1_000_000
    out = steps.withColumn("done", F.row_number().over(w)).withColumn("rate", F.when(seconds > 0, over / seconds))
    return out.withColumn("eta", (F.col(total) - F.col("done")) / F.col("rate"))
