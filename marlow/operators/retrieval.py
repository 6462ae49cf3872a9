"""Hybrid retrieval: exact vector recall, min-max fusion, weighted rank, rerank, filters."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlow.functions.scores import cosine_to
from marlow.functions.text import utf16_left
from marlow.operators.fulltext import words

#: Weight of each recall path by query type.
WEIGHTS = {
    "problem_semantic": {"content": 0.60, "solution": 0.30, "keyword": 0.10},
    "algorithm_intent": {"content": 0.20, "solution": 0.55, "keyword": 0.25},
    "error_reason": {"content": 0.20, "solution": 0.60, "keyword": 0.20},
}
PATHS = ("content", "solution", "keyword")


def vector_recall(vectors: DataFrame, query: list[float], k: int = 80, where: Column | None = None) -> DataFrame:
    """``id, score``: the k nearest by exact cosine, after the filter if there is one. The query is scaled to length 1
    here, so that one pass over a row's vector is left; the plan is a scan with a top-k (TakeOrderedAndProject)."""
    df = vectors if where is None else vectors.where(where)
    return df.select("id", cosine_to(F.col("vector"), [float(x) for x in query]).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def answered(paths: dict[str, Callable[[], DataFrame]], seconds: float = 3.0) -> dict[str, DataFrame]:
    """The recall paths that answer in time, each run on its own; one that fails or is late is left out, which
    ``fuse`` takes as empty. Answers are a recall limit of rows each, so they pass through the driver."""

    def run(name: str, build: Callable[[], DataFrame], group: str) -> tuple[list, str]:
        df = build()
        df.sparkSession.sparkContext.setJobGroup(group, f"recall path {name}", True)
        return df.collect(), df.schema

    out = {}
    pool = ThreadPoolExecutor(len(paths) or 1)
    started = {name: (f"recall-{uuid.uuid4().hex}", build) for name, build in paths.items()}
    waiting = {name: pool.submit(run, name, build, group) for name, (group, build) in started.items()}
    end = time.monotonic() + seconds
    for name, answer in waiting.items():
        spark = SparkSession.active()
        try:
            rows, schema = answer.result(max(0.0, end - time.monotonic()))
            out[name] = spark.createDataFrame(rows, schema)
        except Exception:  # late, or failed in whatever way
            spark.sparkContext.cancelJobGroup(started[name][0])
    pool.shutdown(wait=False, cancel_futures=True)
    return out


def fuse(paths: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """``id, content_score, solution_score, keyword_score, rough_score, sources``.

    Scores of a path are min-max normalised (1 where there is one hit or all are equal); a path that has
    not found the id counts 0. ``sources`` lists the paths in their fixed order. A path may be missing.
    """
    hits = None
    for name, df in paths.items():
        one = df.select("id", F.lit(name).alias("path"), "score")
        hits = one if hits is None else hits.unionByName(one)
    # a path is at most its recall limit, tens of rows
    w = Window.partitionBy("path")
    low, high, n = F.min("score").over(w), F.max("score").over(w), F.count("*").over(w)
    norm = hits.withColumn("norm", F.when((n < 2) | (high == low), 1.0).otherwise((F.col("score") - low) / (high - low)))
    found = norm.groupBy("id").agg(*(F.max(F.when(F.col("path") == p, F.col("norm"))).alias(p) for p in PATHS))
    score = {p: F.coalesce(p, F.lit(0.0)) for p in PATHS}
    return found.select(
        "id", *(score[p].alias(f"{p}_score") for p in PATHS), sum((weights[p] * score[p] for p in PATHS), F.lit(0.0)).alias("rough_score"),
        F.array_compact(F.array(*(F.when(F.col(p).isNotNull(), p) for p in PATHS))).alias("sources"),
    )


def rerank(candidates: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None = None, top: int = 20, least_spread: float = 0.01) -> DataFrame:
    """The ``top`` candidates by rough score with ``final_score``: a scorer gives ``id, rerank_score``.
    Without one, for candidates that it misses, or if its scores hardly differ, the rough score stands."""
    cut = candidates.orderBy(F.col("rough_score").desc(), "id").limit(top)
    if scorer is None:
        return cut.withColumn("final_score", F.col("rough_score"))
    scored = cut.join(scorer(cut), "id", "left")
    w = Window.partitionBy()  # over ``top`` rows
    flat = F.max("rerank_score").over(w) - F.min("rerank_score").over(w) < least_spread
    return scored.withColumn("final_score", F.when(flat, F.col("rough_score")).otherwise(F.coalesce("rerank_score", "rough_score"))).drop("rerank_score")


def rerank_document(title: Column, retrieval: Column, solution: Column, full: Column, tags: Column) -> Column:
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(" | ", title, utf16_left(F.coalesce(blank(retrieval), blank(solution), blank(full), F.lit("")), 250), F.array_join(tags, ","))


def term_share(document: Column, terms: list[str]) -> Column:
    """A rerank score without a model: the share of the terms that are words of the document."""
    return F.size(F.array_intersect(F.array(*map(F.lit, terms)), words(document))) / len(terms)


def hybrid_search(paths: dict[str, DataFrame], problems: DataFrame, query_type: str, top_k: int = 10, where: Column | None = None, filter_stage: str = "post", scorer=None) -> DataFrame:
    """Fusion, hydration, rerank, filter, top-k. ``post`` filters after the rerank cut (so fewer than
    top_k rows may be left); ``pre`` drops candidates that don't fit before it."""
    hydrated = problems.join(F.broadcast(fuse(paths, WEIGHTS[query_type])), "id")  # at most the sum of recall limits
    if where is not None and filter_stage == "pre":
        hydrated = hydrated.where(where)
    out = rerank(hydrated, scorer)
    if where is not None and filter_stage == "post":
        out = out.where(where)
    top = out.orderBy(F.col("final_score").desc(), "id").limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("final_score").desc(), "id")))


def similar_by_tags(problems: DataFrame, problem_id: int, limit: int = 10) -> DataFrame:
    me = problems.where(F.col("id") == problem_id).select(F.explode("tags").alias("tag"))
    hits = problems.where(F.col("id") != problem_id).withColumn("tag", F.explode("tags")).join(F.broadcast(me), "tag", "left_semi")
    return hits.dropDuplicates(["id"]).orderBy(F.col("created_at").desc(), "id").limit(limit).drop("tag")


def newest_per(df: DataFrame, key: str, n: int, order: list[Column]) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__k") <= n).drop("__k")
