"""Mutations as new snapshots: upserts, soft and hard deletes, backfills, logs.

Parquet has no MERGE, so an upsert is what stays of the old rows (anti join on the key) and the newest of
the incoming rows. ``commit_snapshot`` writes a new directory and then moves a pointer file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlow.operators.dedup import keep_one, rolling_hash


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], newest: list[Column] | None = None) -> DataFrame:
    """Incoming rows replace existing ones of the same key; of several, the first by ``newest`` (else by
    all their columns). Columns that incoming lacks are null."""
    last = keep_one(incoming, keys, newest or [F.col(c) for c in incoming.columns])
    return existing.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def upsert_problems(existing: DataFrame, incoming: DataFrame, new_id: Column, seq: str = "seq") -> DataFrame:
    """Problems by (source_platform, source_id): the last incoming row of a key, by ``seq``, wins.

    Ids are cut at 50 characters; rows without one are left out. A soft-deleted twin of an incoming row is purged
    first: what comes in is then a new row, with ``new_id`` and nothing of the old one. A live twin keeps its id and
    the columns that incoming lacks. Rows that come in are live.
    """
    keys = ["source_platform", "source_id"]
    given = incoming.withColumn("source_id", F.left(F.trim("source_id"), F.lit(50))).where("source_id <> '' and source_platform is not null")
    last = keep_one(given, keys, [F.col(seq).desc(), *(F.col(c) for c in incoming.columns if c not in (*keys, seq))])
    kept = [c for c in existing.columns if c not in (*keys, "id", "deleted_at") and c not in last.columns]
    twin = existing.where("deleted_at is null").select(*keys, F.col("id").alias("__id"), *kept)
    new = last.withColumn("__new", new_id).join(twin, keys, "left").withColumn("id", F.coalesce("__id", "__new")).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    return existing.join(last.select(*keys), keys, "left_anti").unionByName(new.select(*existing.columns))


def upsert_solutions(existing: DataFrame, problems: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """Solutions by (problem_id, solution_index): ``incoming`` has source_platform, source_id, content, author,
    solution_index (may be null) and ``seq``.

    Without content, or for no problem, a row is left out. The index is, on codeforces, the given one modulo 100000,
    else 0; elsewhere the rolling hash of the content. Codeforces and atcoder have one solution a problem: the last one
    that comes in replaces all others, also those stored. Elsewhere the last of an index wins. A missing author is 匿名.
    """
    known = problems.where("deleted_at is null").select("source_platform", "source_id", F.col("id").alias("problem_id"))
    rows = incoming.where(F.length("content") > 0).join(known, ["source_platform", "source_id"])
    given = F.when(F.col("source_platform") == "codeforces", F.coalesce(F.col("solution_index") % 100_000, F.lit(0))).otherwise(rolling_hash(F.col("content")))
    rows = rows.withColumn("solution_index", given.cast("long")).withColumn("author", F.coalesce(F.nullif("author", F.lit("")), F.lit("匿名")))
    one = F.col("source_platform").isin("codeforces", "atcoder")
    last = keep_one(rows.withColumn("__slot", F.when(one, -1).otherwise(F.col("solution_index"))).withColumn("__one", one), ["problem_id", "__slot"], [F.col(seq).desc(), F.col("content"), F.col("author")])
    # one row for each problem whose solutions are all replaced, and one for each index that is
    whole = last.where("__one").select("problem_id")
    left = existing.join(whole, "problem_id", "left_anti").join(last.select("problem_id", "solution_index"), ["problem_id", "solution_index"], "left_anti")
    return left.unionByName(last.select(*existing.columns))


def versioned_upsert(existing: DataFrame, incoming: DataFrame, key: str, least_rows: int = 10, count_col: str = "n_records") -> DataFrame:
    """Profiles: only with enough records; the version is one more than before."""
    fit = incoming.where(F.col(count_col) >= least_rows)
    old = existing.select(key, F.col("version").alias("__v"))
    new = fit.join(old, key, "left").withColumn("version", F.coalesce("__v", F.lit(0)) + 1).drop("__v")
    return existing.join(fit.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def soft_delete(df: DataFrame, ids: DataFrame, as_of: str, key: str = "id") -> DataFrame:
    mark = ids.select(F.col(key)).distinct().withColumn("__gone", F.lit(True))
    when = F.when(F.col("__gone") & F.col("deleted_at").isNull(), F.lit(as_of).cast("timestamp")).otherwise(F.col("deleted_at"))
    return df.join(mark, key, "left").withColumn("deleted_at", when).drop("__gone")


def hard_delete(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def conditional_insert(members: DataFrame, requests: DataFrame, capacity: int = 3) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``): requests ``team, user, seq`` in order, if the user is no
    member and the team has room."""
    sizes = members.groupBy("team").agg(F.count("*").alias("held"))
    known = members.select("team", "user").withColumn("__in", F.lit(True))
    r = requests.join(sizes, "team", "left").join(known, ["team", "user"], "left").withColumn("held", F.coalesce("held", F.lit(0)))
    again = F.row_number().over(Window.partitionBy("team", "user").orderBy("seq")) > 1
    r = r.withColumn("__twice", F.coalesce(F.col("__in"), F.lit(False)) | again)
    place = F.sum((~F.col("__twice")).cast("int")).over(Window.partitionBy("team").orderBy("seq"))
    r = r.withColumn("reason", F.when(F.col("__twice"), "duplicate").when(F.col("held") + place > capacity, "full"))
    return r.where("reason is null").select("team", "user"), r.where("reason is not null").select("team", "user", "reason")


def partial_update(df: DataFrame, changes: DataFrame, key: str, blocked: tuple[str, ...] = ("role", "password_hash")) -> DataFrame:
    """Non-null values of ``changes`` replace old ones, but for blocked columns."""
    cols = [c for c in changes.columns if c != key and c not in blocked]
    new = changes.select(key, *(F.col(c).alias(f"__{c}") for c in cols))
    out = df.join(new, key, "left")
    return out.select(*(F.coalesce(f"__{c}", c).alias(c) if c in cols else c for c in df.columns))


def work_log(log: DataFrame, results: DataFrame) -> DataFrame:
    """One row for (item, stage): the newest wins; messages are cut at 500 characters."""
    cut = results.withColumn("message", F.left("message", F.lit(500)))
    return keep_one(log.unionByName(cut), ["item", "stage"], [F.col("at").desc(), F.col("status")])


def backfill(df: DataFrame, column: str, recomputed: Column, force: bool = False) -> DataFrame:
    """Recompute where missing, or everywhere; the old value stays where nothing comes out."""
    missing = F.lit(force) | F.nullif(F.col(column), F.lit("")).isNull()
    return df.withColumn(column, F.when(missing, F.coalesce(recomputed, F.col(column))).otherwise(F.col(column)))


def rewrite_vectors(df: DataFrame, computed: DataFrame, version: str, as_of: str, key: str = "id") -> DataFrame:
    """``df`` (vector, embedding_version, embedding_generated_at, updated_at) with the vectors of ``computed`` (key, vector); version
    and both times are set with them. Empty and missing vectors change nothing."""
    new = computed.where(F.size("vector") > 0).select(key, F.col("vector").alias("__v"))
    out = df.join(new, key, "left")
    there = F.col("__v").isNotNull()
    put = {"vector": F.col("__v"), "embedding_version": F.lit(version), "embedding_generated_at": F.lit(as_of).cast("timestamp"), "updated_at": F.lit(as_of).cast("timestamp")}
    return out.withColumns({c: F.when(there, v).otherwise(F.col(c)) for c, v in put.items()}).select(*df.columns)


def clear_vectors(df: DataFrame, as_of: str, where: Column | None = None) -> DataFrame:
    """Vectors to null, and ``updated_at`` to now, where there is a vector (and the condition holds)."""
    hit = F.col("vector").isNotNull() if where is None else F.col("vector").isNotNull() & F.coalesce(where, F.lit(False))
    # the time first: it looks at the vector
    return df.withColumn("updated_at", F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at"))).withColumn("vector", F.when(~hit, F.col("vector")))


def fail_stuck(jobs: DataFrame, as_of: str, idle_minutes: int = 30) -> DataFrame:
    """Running jobs (status, updated_at, finished_at) that have been idle for more than ``idle_minutes`` become failed and get an end."""
    now = F.lit(as_of).cast("timestamp")
    stuck = (F.col("status") == "running") & (F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(idle_minutes)))
    return jobs.withColumn("finished_at", F.when(stuck, now).otherwise(F.col("finished_at"))).withColumn("status", F.when(stuck, "failed").otherwise(F.col("status")))


def changed_only(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of ``new`` whose value differs from the old one (null-safe)."""
    o = old.select(key, F.col(column).alias("__old"))
    return new.join(o, key, "left").where(~F.col(column).eqNullSafe(F.col("__old"))).drop("__old")


def cap_per_group(df: DataFrame, keys: list[str], order: list[Column], most: int, text: str, width: int = 10_000) -> DataFrame:
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__k", k).where(F.col("__k") <= most).drop("__k").withColumn(text, F.left(F.col(text), F.lit(width)))


def with_submission_id(records: DataFrame, platform_id: str = "id", uid: str = "uid", at: str = "timestamp") -> DataFrame:
    """``submission_id``: the judge's id, else user and time joined; rows that have neither are left out."""
    made = F.when(F.col(uid).isNotNull() & F.col(at).isNotNull(), F.concat_ws("_", F.col(uid).cast("string"), F.col(at).cast("string")))
    given = F.nullif(F.col(platform_id).cast("string"), F.lit(""))
    return records.withColumn("submission_id", F.coalesce(given, made)).where("submission_id is not null")


def archive(teams: DataFrame, ids: DataFrame, key: str = "team") -> DataFrame:
    """Status ``archived`` for the listed teams; ids of no team do nothing."""
    listed = ids.select(F.col(key)).distinct().withColumn("__listed", F.lit(True))
    return teams.join(listed, key, "left").withColumn("status", F.when(F.col("__listed"), "archived").otherwise(F.col("status"))).drop("__listed")


def upsert_settings(settings: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """New rows as they are; of rows that exist, only what the change gives (is not null) is replaced."""
    rest = [c for c in settings.columns if c not in keys]
    new = changes.select(*keys, *(F.col(c).alias(f"__{c}") for c in rest))
    return settings.join(new, keys, "full").select(*keys, *(F.coalesce(f"__{c}", c).alias(c) for c in rest))


def bind_accounts(accounts: DataFrame, users: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accounts with the new ones, rejected with ``reason``): requests ``user, platform, uid, name, seq`` in order; the
    user must exist, and the (platform, uid) must be free. The name defaults to the uid."""
    taken = accounts.select("platform", "uid").distinct().withColumn("__taken", F.lit(True))
    known = users.select("user").distinct().withColumn("__known", F.lit(True))
    r = requests.join(taken, ["platform", "uid"], "left").join(known, "user", "left")
    fits = F.col("__known").isNotNull() & F.col("__taken").isNull()
    first = F.row_number().over(Window.partitionBy("platform", "uid").orderBy(F.when(fits, 0).otherwise(1), "seq")) == 1
    r = r.withColumn("reason", F.when(F.col("__known").isNull(), "no user").when(F.col("__taken").isNotNull() | ~first, "bound"))
    added = r.where("reason is null").select("user", "platform", "uid", F.coalesce("name", "uid").alias("name"))
    return accounts.unionByName(added), r.where("reason is not null").select("user", "platform", "uid", "reason")


def commit_snapshot(df: DataFrame, root: str) -> str:
    """Write a new snapshot directory, then point to it by a rename that replaces the old pointer, in one step where
    the store has one (HDFS, local files). Readers see the old or the new one, whole."""
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    sc = spark.sparkContext
    fs, conf = sc._jvm.org.apache.hadoop.fs, sc._jsc.hadoopConfiguration()
    part, final = fs.Path(root, f"CURRENT.{name}"), fs.Path(root, "CURRENT")
    out = part.getFileSystem(conf).create(part)
    out.write(bytearray(name.encode()))
    out.close()
    kind = getattr(fs, "Options$Rename")
    replace = sc._gateway.new_array(kind, 1)
    replace[0] = kind.OVERWRITE
    files = fs.FileContext.getFileContext(part.getFileSystem(conf).getUri(), conf)
    files.rename(files.makeQualified(part), files.makeQualified(final), replace)
    return name


def read_snapshot(spark, root: str) -> DataFrame:
    name = spark.read.text(f"{root}/CURRENT").first()[0]
    return spark.read.parquet(f"{root}/{name}")
