"""Training plans: phase, targets, difficulty curve, candidate scores, arrangement of a week."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The basic tags.
BASIC_TAGS = ["prefix_sum", "two_pointers", "binary_search", "sliding_window", "binary_tree_traverse", "bst", "hash_map", "heap"]


def phase(coverage: Column, weak_basics: Column, ceiling: Column, overall: Column, efficiency: Column) -> Column:
    return (
        F.when((coverage < 0.3) | (weak_basics >= 3), "template_consolidation").when((ceiling >= 8) & (overall >= 0.7), "contest_simulation")
        .when((ceiling >= 6) & (efficiency >= 0.5), "integrated_practice").otherwise("topic_breakthrough")
    )


def targets(phase_: Column, weak: Column, strong_categories: Column, weak_categories: Column, adjacent: Column, all_tags: list[str], user: Column) -> Column:
    """struct(primary, secondary, explore). ``adjacent`` are prerequisites of the weak tags, in order. For
    contests tags are drawn by a hash of user and tag (any fixed draw does)."""
    lits = lambda xs: F.array(*map(F.lit, xs))
    every, basic = lits(all_tags), lits(BASIC_TAGS)
    none = F.array().cast("array<string>")
    first = lambda a, n: F.slice(a, 1, n)
    basics = first(F.concat(F.filter(weak, lambda t: F.array_contains(basic, t)), F.array_except(basic, weak)), 2)
    shuffled = F.transform(F.array_sort(F.transform(every, lambda t: F.struct(F.md5(F.concat_ws(":", user.cast("string"), t).cast("binary")).alias("h"), t.alias("t")))), lambda x: x["t"])
    weak3 = first(weak, 3)
    near = first(F.array_except(adjacent, weak3), 2)
    mixed = first(F.concat(F.when(F.size(weak_categories) > 0, first(weak_categories, 2)).otherwise(first(weak, 2)), strong_categories), 2)
    pack = lambda p, s, e: F.struct(p.alias("primary"), s.alias("secondary"), e.alias("explore"))
    return (
        F.when(phase_ == "template_consolidation", pack(basics, first(F.filter(F.array_except(weak, basics), lambda t: ~F.array_contains(basic, t)), 1), none))
        .when(phase_ == "integrated_practice", pack(mixed, F.when(F.size(strong_categories) > 0, first(strong_categories, 2)).otherwise(first(every, 2)), none))
        .when(phase_ == "contest_simulation", pack(first(shuffled, 3), F.slice(shuffled, 4, 1), F.slice(shuffled, 5, 1)))
        .otherwise(pack(weak3, near, first(F.filter(every, lambda t: ~F.array_contains(F.concat(weak3, near), t)), 1)))
    )


def curve(phase_: Column, days: int = 7) -> Column:
    """Target difficulty of each day, two digits, in [1, 10]."""
    span, half = max(days - 1, 1), days // 2
    pi = F.pi()

    def at(i: Column) -> Column:
        contest = F.when(i < half, 5 + i / max(half - 1, 1) * 3).otherwise(7 + 1.5 * F.sin((i - half) / max(days - half - 1, 1) * pi))
        return (
            F.when(phase_ == "template_consolidation", 2.5 + 0.8 * F.sin(i / days * 2 * pi)).when(phase_ == "topic_breakthrough", 2 + i / span * 4.0)
            .when(phase_ == "integrated_practice", 6 + 2 * F.sin(i / span * pi)).when(phase_ == "contest_simulation", contest).otherwise(3 + i / span * 4.0)
        )

    return F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.round(at(i.cast("double")), 2))))


def ready(needs: Column, known: Column) -> Column:
    """All prerequisites are known."""
    return F.size(F.array_except(needs, known)) == 0


def arrange(candidates: DataFrame, plans: DataFrame, daily_target: int = 5) -> DataFrame:
    """``user_id, day, slot, position, problem_id``: a greedy week for each user, no problem twice.

    ``candidates``: user_id, problem_id, tags, difficulty, score (already cut to a pool a user);
    ``plans``: user_id, primary, secondary, explore, curve. Each pick depends on those before it, so a
    user's pool is one group of ``applyInPandas``; pools are bounded by the retrieval limit.
    """

    def week(pdf: pd.DataFrame) -> pd.DataFrame:
        plan = pdf.iloc[0]
        used: set = set()
        pool = [(r.problem_id, set(r.tags), r.difficulty, r.score) for r in pdf.itertuples()]

        def pick(tags, count: int, target: float) -> list:
            tags = set(tags)
            fit = [c for c in pool if c[0] not in used and (not tags or c[1] & tags)]
            fit.sort(key=lambda c: (-c[3] if tags else 0.0, abs(c[2] - target), c[0]))
            got = [c[0] for c in fit[:count]]
            used.update(got)
            return got

        rows = []
        for day, target in enumerate(plan.curve, 1):
            parts = {"primary": pick(plan.primary, 2, target), "secondary": pick(plan.secondary, 2, target), "explore": pick(plan.explore, 1, target)}
            left = daily_target - sum(map(len, parts.values()))
            if left > 0:
                parts["secondary"] += pick([*plan.primary, *plan.secondary], left, target)
            rows += [(plan.user_id, day, slot, i, p) for slot, ids in parts.items() for i, p in enumerate(ids, 1)]
        return pd.DataFrame(rows, columns=["user_id", "day", "slot", "position", "problem_id"])

    return candidates.join(plans, "user_id").groupBy("user_id").applyInPandas(week, "user_id long, day int, slot string, position int, problem_id long")


#: Stands for every problem where a list of tags is empty.
ANY = ""


def pools(candidates: DataFrame, plans: DataFrame, daily_target: int = 5) -> DataFrame:
    """``candidates`` that ``arrange`` can pick, for each user of ``plans``: the same week comes out as from all of them.

    A pick takes the first unused of the fitting candidates in its order, and a week uses ``daily_target`` a day
    at most, or the five of the slots; so the first of each order, as many as a week uses, are enough. The first of
    a list of tags are among the first of each of its tags. So the best are found for each tag and target that any
    plan has, and users meet those alone: no user meets all problems.

    Best rows are cut in two steps, first by score (ties of the last one stay), then by distance to each target. The first
    counts rows by tag and score and keeps the last score that counts; the second is a rank under a constant, which Spark
    applies to each partition before rows are sent. So candidates stay in the task that reads them, also those of a tag that
    all have, or of a score that many share: a partition sends as many a tag and target as a week uses. Tags and targets are
    those of plans, a bounded list.
    """
    none = F.array().cast("array<string>")
    tags = lambda c: F.coalesce(F.col(c), none)
    lists = F.array(tags("primary"), tags("secondary"), tags("explore"), F.concat(tags("primary"), tags("secondary")))
    asked = plans.select("user_id", F.explode("curve").alias("target"), lists.alias("l")).select("user_id", "target", F.explode("l").alias("want"))
    asked = asked.select("user_id", "target", F.explode(F.when(F.size("want") > 0, F.col("want")).otherwise(F.array(F.lit(ANY)))).alias("tag")).distinct()
    most = (plans.agg(F.max(F.size("curve"))).first()[0] or 0) * max(daily_target, 5)
    tagged = candidates.withColumn("tag", F.explode(F.array_union(F.coalesce("tags", none), F.array(F.lit(ANY)))))
    tagged = tagged.withColumn("by", F.when(F.col("tag") == ANY, 0.0).otherwise(-F.coalesce("score", F.lit(0.0))))
    # rows for each score of a tag; the last score that a week can reach, a row a tag, is all that the candidates meet
    wanted = asked.select("tag").distinct()
    w = Window.partitionBy("tag").orderBy("by")
    scores = tagged.join(F.broadcast(wanted), "tag", "left_semi").groupBy("tag", "by").agg(F.count("*").alias("n"))
    scores = scores.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = scores.withColumn("before", before).where(F.col("before") < most).groupBy("tag").agg(F.max("by").alias("last"))
    tagged = tagged.join(F.broadcast(last), "tag").where(F.col("by") <= F.col("last")).drop("last")
    aimed = tagged.join(F.broadcast(asked.select("tag", "target").distinct()), "tag")
    near = F.row_number().over(Window.partitionBy("tag", "target").orderBy("by", F.abs(F.col("difficulty") - F.col("target")), "problem_id"))
    best = aimed.withColumn("k", near).where(F.col("k") <= most)
    return asked.join(best.drop("k", "by"), ["tag", "target"]).select("user_id", *candidates.columns).dropDuplicates(["user_id", "problem_id"])


def arrange_all(candidates: DataFrame, plans: DataFrame, daily_target: int = 5) -> DataFrame:
    """``arrange`` where every candidate (problem_id, tags, difficulty, score) is there for every user.

    Users with equal plans get equal weeks, which are arranged once.
    """
    parts = ["primary", "secondary", "explore", "curve"]
    leads = plans.groupBy(*parts).agg(F.min("user_id").alias("user_id"))
    weeks = arrange(pools(candidates, leads, daily_target), leads, daily_target)
    same = plans.join(leads.select(*parts, F.col("user_id").alias("lead")), parts).select("user_id", "lead")
    return same.join(weeks.withColumnRenamed("user_id", "lead"), "lead").drop("lead")


#: Consecutive positions whose reviews are one row.
FOLD = 256


def review_states(reviews: DataFrame, key: str, at: str, quality: str) -> DataFrame:
    """``key, ease, interval``: each key's reviews replayed in the order of ``at`` (whole numbers, nulls last), then of quality.

    The ease is a sum of doubles, whose last digits depend on the order of the additions; so steps are taken one by one, as
    the loop takes them. The qualities of FOLD positions are one row, and a key's rows come to one task in order, which keeps
    the state of one key only: however long a history is, nothing holds all of it. Positions that repeat are in one row.
    """
    kind = reviews.schema[key].dataType.simpleString()
    said = reviews.where(F.col(quality).isNotNull()).select(key, F.floor(F.col(at) / FOLD).alias("run"), at, F.col(quality).cast("double").alias("__q"))
    runs = said.groupBy(key, "run").agg(F.transform(F.sort_array(F.collect_list(F.struct(at, "__q"))), lambda r: r["__q"]).alias("qualities"))
    runs = runs.repartition(key).sortWithinPartitions(F.col(key), F.col("run").asc_nulls_last()).select(key, "qualities")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ease, doubled, begun = None, 2.5, 0, False
        for batch in batches:
            keys, eases, days = [], [], []
            for k, qualities in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not begun or k != last:
                    if begun:
                        keys.append(last), eases.append(ease), days.append(doubled)
                    last, ease, doubled, begun = k, 2.5, 0, True
                for q in qualities:
                    if q >= 3:
                        ease, doubled = max(1.3, ease + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)), min(doubled + 1, 20)
                    else:
                        ease, doubled = max(1.3, ease - 0.15), 0
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(eases, pa.float64()), pa.array(days, pa.int32())], names=[key, "ease", "doubled"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([last], batch.schema.field(0).type), pa.array([ease], pa.float64()), pa.array([doubled], pa.int32())], names=[key, "ease", "doubled"])

    # an interval of 1 is doubled once for each success since the last failure, up to the cap of a year
    return runs.mapInArrow(replay, f"`{key}` {kind}, ease double, doubled int").select(key, "ease", F.least(F.lit(365), F.pow(F.lit(2), F.col("doubled")).cast("int")).alias("interval"))
