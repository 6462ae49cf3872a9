"""Tables of the domain: loading with the soft-delete default, snapshots, and the mapping from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The five judges.
PLATFORMS = ["luogu", "leetcode", "nowcoder", "codeforces", "atcoder"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def health(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    """``name, up`` of each table: whether a row of it can be read. A table that can't be opened is an error."""
    out = None
    for name in names:
        one = read_table(spark, sf_dir, name).limit(1).agg(F.lit(name).alias("name"), (F.count("*") == 1).alias("up"))
        out = one if out is None else out.unionByName(one)
    return out


def spread(df: DataFrame) -> DataFrame:
    """A scan over at least as many partitions as there are cores: a file of one row group is one task otherwise.
    Larger inputs have more partitions than that and stay as they are. For work that is much per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def spread_rows(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` dealt to tasks of about ``rows`` rows, and to as many as there are cores at least. For short rows with much
    work for each: their files are small, so that a scan has few tasks, and no more as rows come."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)))


def live(df: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Without soft-deleted rows, unless they are asked for."""
    return df if include_deleted or "deleted_at" not in df.columns else df.where(F.col("deleted_at").isNull())


def platform_of(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PLATFORMS)), (number % 5 + 1).cast("int"))


def practice_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions out of ``events``."""
    e = read_table(spark, sf_dir, "events")
    verdict = F.coalesce(F.element_at(F.create_map(*map(F.lit, ("purchase", "OK", "click", "WA", "view", "TLE", "error", "RE", "signup", "CE"))), F.col("event_type")), F.lit("OTHER"))
    # records have no, one, two or three tags
    e6, k = F.col("event_id") % 6, F.get_json_object("props", "$.k").cast("int") % 20
    tag = lambda n: F.concat(F.lit("tag_"), n.cast("string"))
    return e.select(
        F.col("event_id").alias("id"), "user_id", platform_of(F.col("user_id")).alias("platform"), (F.col("event_id") % 97).alias("problem_id"),
        F.col("ts").alias("submit_time"), F.to_date("ts").alias("stat_date"), verdict.alias("verdict"),
        F.least(F.lit(10.0), 1 + F.col("value") / 50).alias("difficulty"),
        F.when(e6 == 0, F.array().cast("array<string>")).when(e6 <= 2, F.array_distinct(F.array(tag(k), tag(k * 7 % 20), tag(k * 3 % 20)))).when(e6 == 3, F.array_distinct(F.array(tag(k), tag(k * 7 % 20)))).otherwise(F.array(tag(k))).alias("tags"),
        (F.col("event_id") % 3 == 0).alias("first_ac"), (F.col("event_id") % 4).cast("int").alias("retries"),
    )


def problems(spark: SparkSession, sf_dir: str, include_deleted: bool = False) -> DataFrame:
    """Problems out of ``documents``."""
    d = read_table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    tag = lambda n: F.concat(F.lit("tag_"), n.cast("string"))
    out = d.select(
        i.alias("id"), platform_of(i).alias("source_platform"), F.concat(F.lit("P"), i.cast("string")).alias("source_id"), F.left("text", F.lit(40)).alias("title"),
        (F.col("n_chars") % 3500).cast("double").alias("difficulty"), F.array_distinct(F.array(tag(i % 20), tag(i * 7 % 20))).alias("tags"),
        F.col("text").alias("content"), "lang", "source", "n_chars",
        F.timestamp_seconds(F.lit(1704067200) + i * 60).alias("created_at"),
        F.when(i % 17 == 0, F.timestamp_seconds(F.lit(1704067200) + i * 61)).alias("deleted_at"),
    )
    return live(out, include_deleted)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users out of ``customer``."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"), F.col("c_name").alias("username"), F.when(k % 10 == 0, "admin").when(k % 3 == 0, "observed").otherwise("user").alias("role"),
        F.when(k % 4 != 0, F.concat(F.lit("nick"), k.cast("string"))).alias("nickname"), F.col("c_mktsegment").alias("department"), F.col("c_acctbal").alias("rating"),
        F.lit("secret").alias("password_hash"), F.when(k % 13 == 0, F.timestamp_seconds(F.lit(1704067200) + k)).alias("deleted_at"), F.col("c_nationkey").alias("nation"),
    )


def solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem solutions out of ``lineitem``: order = problem, line = index."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("problem_id"), F.col("l_linenumber").alias("solution_index"), F.col("l_partkey").alias("author"),
        F.concat_ws(" ", F.lit("part"), (F.col("l_partkey") % 50).cast("string"), F.col("l_returnflag"), F.col("l_linestatus")).alias("content"), F.col("l_shipdate").alias("created_at"), F.col("l_quantity").alias("votes"),
    )


def daily_stats(records: DataFrame) -> DataFrame:
    """Rollup of submissions by user, platform and date; ``new_problems_solved`` counts first acceptances."""
    from pyspark.sql import Window

    ok = F.col("verdict") == "OK"
    w = Window.partitionBy("user_id", "problem_id").orderBy("submit_time", "id")
    ranked = records.withColumn("__first", ok & (F.sum(ok.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1))
    count = lambda c: F.sum(c.cast("long"))
    return ranked.groupBy("user_id", "platform", "stat_date").agg(
        F.count("*").alias("submit_count"), count(ok).alias("ac_count"), count(F.col("verdict") == "WA").alias("wa_count"), count(F.col("verdict") == "TLE").alias("tle_count"),
        count(~F.col("verdict").isin("OK", "WA", "TLE")).alias("other_count"), count(F.col("__first")).alias("new_problems_solved"),
        F.max("difficulty").alias("hardest_difficulty"), F.avg("difficulty").alias("avg_difficulty"),
    )
