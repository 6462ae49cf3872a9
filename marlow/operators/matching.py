"""Teammates: pair scores, trios of the ten best, teams of three."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlow.functions.scores import STYLE_PAIRS, compatibility, level_proximity, round3, skill_complement, style_match


def side(prefix: str) -> dict[str, Column]:
    return {k: F.col(f"{prefix}_{k}") for k in ("strong", "weak", "score", "style")}


def prefixed(profiles: DataFrame, prefix: str) -> DataFrame:
    """Profiles have user_id, strong, weak (arrays), score, style."""
    empty = F.array().cast("array<string>")
    return profiles.select(F.col("user_id").alias(f"{prefix}_id"), *(F.coalesce(c, empty).alias(f"{prefix}_{c}") for c in ("strong", "weak")), F.col("score").alias(f"{prefix}_score"), F.col("style").alias(f"{prefix}_style"))


def _hits(of: list[np.ndarray], among: list[np.ndarray]) -> np.ndarray:
    """[i, j]: entries of ``of[i]`` that ``among[j]`` has; repeats in ``of[i]`` count."""
    number = {t: k for k, t in enumerate(sorted({t for x in of for t in x}))}
    a, b = np.zeros((len(of), len(number))), np.zeros((len(number), len(among)))
    for i, x in enumerate(of):
        for t in x:
            a[i, number[t]] += 1
    for j, x in enumerate(among):
        b[[number[t] for t in x if t in number], j] = 1
    return a @ b


def block_scores(u: pd.DataFrame, c: pd.DataFrame) -> np.ndarray:
    """``compatibility`` of each row of ``u`` with each of ``c``."""
    size = lambda p: np.array([len(x) for x in p.strong], dtype=float)
    skill = (_hits(list(u.strong), list(c.weak)) + _hits(list(c.strong), list(u.weak)).T) / np.maximum(size(u)[:, None] + size(c)[None, :], 1)
    level = np.fmax(0.0, 1 - np.abs(u.score.to_numpy(float)[:, None] - c.score.to_numpy(float)[None, :]) * 2)
    pairs = STYLE_PAIRS | {(y, x): v for (x, y), v in STYLE_PAIRS.items()}
    a, styles_u = pd.factorize(u["style"].fillna("").str.strip(" ").str.lower())
    b, styles_c = pd.factorize(c["style"].fillna("").str.strip(" ").str.lower())
    style = np.array([[pairs.get((x, y), 0.5) for y in styles_c] for x in styles_u])[a[:, None], b[None, :]]
    return np.floor((0.5 * skill + 0.3 * level + 0.2 * style) * 1000 + 0.5) / 1000


def style_class(style: Column) -> Column:
    """The style if pairs of it have a value of their own, else nothing."""
    known = sorted({x for pair in STYLE_PAIRS for x in pair})
    s = F.lower(F.trim(F.coalesce(style, F.lit(""))))
    return F.when(s.isin(known), s).otherwise("")


def pair_scores(seekers: DataFrame, candidates: DataFrame, exclude: DataFrame | None = None, keep: int = 10, rows: int = 1000, levels: int | None = None) -> DataFrame:
    """``best_pairs`` with the profiles of both sides: ``u_*``, ``c_*``, ``pair``, ``rk``."""
    found = best_pairs(seekers, candidates, exclude, keep, rows, levels)
    seekers, candidates = seekers.where("user_id is not null"), candidates.where("user_id is not null")
    return found.join(prefixed(seekers, "u"), "u_id").join(prefixed(candidates, "c"), "c_id")


def best_pairs(seekers: DataFrame, candidates: DataFrame, exclude: DataFrame | None = None, keep: int = 10, rows: int = 1000, levels: int | None = None) -> DataFrame:
    """``u_id, c_id, pair, rk``: the ``keep`` best candidates of each seeker, but for itself; excluded (user_id, other_id)
    pairs are left out. Users with a null id neither ask nor are found.

    A top-k join with bounds. Candidates are dealt to shards, those of equal skills and style to one, and each shard meets
    all seekers, in blocks. There, equal skills and style are a cell, in order of level: skill and style of a seeker and a
    cell are exact, so that what the cell can give at most is known but for the level. The nearest of the best cells tell
    what has to be reached; then only levels near enough in cells whose bound is no less, ties included, are scored.
    Candidates are sent once for each ``rows`` * SHARD seekers. ``levels`` has no effect any more.
    """
    return _rounds(seekers, candidates, exclude, keep, rows, levels)[0]


def looked_at(seekers: DataFrame, candidates: DataFrame, keep: int = 10, rows: int = 1000, levels: int | None = None) -> DataFrame:
    """``seekers, candidates, pairs, looked_at``: how many pairs there are, and how many of them ``pair_scores`` scores."""
    _, met = _rounds(seekers, candidates, None, keep, rows, levels)
    n = candidates.where("user_id is not null").count()
    return met.agg(F.count_distinct("user_id").alias("seekers"), F.sum("held").alias("looked_at")).select(
        "seekers", F.lit(n).cast("long").alias("candidates"), (F.col("seekers") * n).alias("pairs"), "looked_at",
    )


#: Candidates and seekers of a task: this many times ``rows``.
SHARD = 100


def _rounds(seekers: DataFrame, candidates: DataFrame, exclude: DataFrame | None, keep: int, rows: int, levels: int | None) -> tuple[DataFrame, DataFrame]:
    """(u_id, c_id, pair, rk; user_id and held, the pairs scored, of each seeker and task)."""
    spark = candidates.sparkSession
    none = F.array().cast("array<string>")
    kind = candidates.schema["user_id"].dataType.simpleString()
    columns = ["user_id", "strong", "weak", "score", "style"]

    def plain(df: DataFrame) -> DataFrame:
        cols = [F.coalesce("strong", none).alias("strong"), F.coalesce("weak", none).alias("weak"), F.nanvl(F.col("score").cast("double"), F.lit(None)).alias("score"), style_class(F.col("style")).alias("style")]
        return df.where("user_id is not null").select("user_id", *cols)

    c, u = plain(candidates), plain(seekers)
    shards = max(spark.sparkContext.defaultParallelism, -(-c.count() // (rows * SHARD)))
    blocks = max(1, -(-u.count() // (rows * SHARD)))
    if exclude is not None:
        u = u.join(exclude.groupBy("user_id").agg(F.collect_set(F.col("other_id").cast(kind)).alias("skip")), "user_id", "left")
    else:
        u = u.withColumn("skip", F.array().cast(f"array<{kind}>"))
    # equal profiles in one shard; those that more users have than a shard holds in several: of these there are as many as shards at most
    c = c.withColumn("alike", F.xxhash64("strong", "weak", "style"))
    hot = c.groupBy("alike").agg(F.ceil(F.count("*") / (rows * SHARD)).alias("copies")).where("copies > 1")
    c = c.join(F.broadcast(hot), "alike", "left")
    shard = F.pmod(F.xxhash64("alike") + F.pmod(F.xxhash64("user_id"), F.coalesce("copies", F.lit(1))), F.lit(shards)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = c.select(shard.alias("shard"), every(blocks).alias("block"), *columns)
    left = u.withColumn("block", F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int")).select(every(shards).alias("shard"), "block", *columns, "skip")
    right = right.toDF(*right.columns)  # both may come from one table

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return shard_best(a, b, keep)

    met = left.toDF(*left.columns).groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(best, f"u_id {kind}, c_id {kind}, pair double, held long")
    rk = F.row_number().over(Window.partitionBy("u_id").orderBy(F.col("pair").desc(), "c_id"))
    found = met.where("held is null").select("u_id", "c_id", "pair").withColumn("rk", rk).where(F.col("rk") <= keep)
    return found, met.where("held is not null").select(F.col("u_id").alias("user_id"), "held")


def shard_best(a: pd.DataFrame, b: pd.DataFrame, keep: int) -> pd.DataFrame:
    """``u_id, c_id, pair, held``: the best of each seeker of ``a`` among ``b``, and a row a seeker with the pairs scored."""
    if a.empty or b.empty:
        return pd.DataFrame({"u_id": [], "c_id": [], "pair": [], "held": []})
    a = a.reset_index(drop=True)
    code = pd.factorize(pd.Series(list(zip(map(tuple, b.strong), map(tuple, b.weak), b["style"], strict=True)), dtype=object))[0]
    score = b.score.to_numpy(float)
    order = np.lexsort((score, code))
    b, code, score = b.iloc[order].reset_index(drop=True), code[order], score[order]
    ids = b.user_id.to_numpy()
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    held, cell = np.diff(np.r_[first, len(code)]), b.iloc[first]
    # cells are groups of equal profiles in order of level; a key in this order finds the levels of a range in all cells at once
    own = a.score.to_numpy(float)
    known = np.r_[score, own]
    known = known[~np.isnan(known)]
    low, high = (known.min(), known.max()) if len(known) else (0.0, 0.0)
    width = (high - low) or 1.0
    key = code * 4.0 + np.where(np.isnan(score), 1.5, (score - low) / width)
    size = lambda p: np.array([len(x) for x in p.strong], dtype=float)
    pairs = STYLE_PAIRS | {(y, x): v for (x, y), v in STYLE_PAIRS.items()}
    out_u, out_c, out_p, looked = [], [], [], np.zeros(len(a), np.int64)
    step = max(1, 2_000_000 // len(first))
    for at in range(0, len(a), step):
        u = a.iloc[at:at + step]
        skill = (_hits(list(u.strong), list(cell.weak)) + _hits(list(cell.strong), list(u.weak)).T) / np.maximum(size(u)[:, None] + size(cell)[None, :], 1)
        x, styles_u = pd.factorize(u["style"])
        y, styles_c = pd.factorize(cell["style"])
        style = np.array([[pairs.get((p, q), 0.5) for q in styles_c] for p in styles_u])[x[:, None], y[None, :]]
        bound = np.floor((0.5 * skill + 0.3 * 1.0 + 0.2 * style) * 1000 + 0.5) / 1000
        for i, (me, skip) in enumerate(zip(u.user_id, u["skip"], strict=True)):
            mine = own[at + i]
            skip = skip if skip is not None and len(skip) else None
            spare = keep + 1 + (0 if skip is None else len(skip))

            def scored(cells: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                n = end - begin
                where = np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                level = np.fmax(0.0, 1 - np.abs(mine - score[where]) * 2)
                pair = np.floor((0.5 * np.repeat(skill[i, cells], n) + 0.3 * level + 0.2 * np.repeat(style[i, cells], n)) * 1000 + 0.5) / 1000
                away = ids[where] == me
                if skip is not None:
                    away |= np.isin(ids[where], skip)
                return where[~away], pair[~away]

            # the nearest levels of the cells of the best bounds tell what the last one kept has to reach
            ranked = np.argsort(-bound[i], kind="stable")
            some = ranked[:np.searchsorted(np.cumsum(held[ranked]), spare) + 1]
            near = np.searchsorted(key, some * 4.0 + (0.0 if np.isnan(mine) else (mine - low) / width))
            _, pair = scored(some, np.maximum(first[some], near - spare), np.minimum(first[some] + held[some], near + spare))
            need = np.partition(pair, -keep)[-keep] if len(pair) >= keep else -np.inf
            # whatever may reach it, ties included: a range of levels in each cell, a little wider than arithmetic asks
            cells = np.flatnonzero(bound[i] >= need)
            begin, end = first[cells], first[cells] + held[cells]
            if need > -np.inf and not np.isnan(mine):
                level = (need - 0.0005 - 0.5 * skill[i, cells] - 0.2 * style[i, cells]) / 0.3 - 1e-6
                gap = (1 - level) / 2 + 1e-6
                part = level > 0
                begin = np.where(part, np.searchsorted(key, np.maximum(cells * 4.0 - 1, cells * 4.0 + (mine - gap - low) / width - 1e-6)), begin)
                end = np.where(part, np.searchsorted(key, np.minimum(cells * 4.0 + 1.25, cells * 4.0 + (mine + gap - low) / width + 1e-6), "right"), end)
            where, pair = scored(cells, begin, np.maximum(begin, end))
            looked[at + i] = len(where)
            top = np.lexsort((ids[where], -pair))[:keep]
            out_u.append(np.full(len(top), at + i)), out_c.append(ids[where[top]]), out_p.append(pair[top])
    ua = a.user_id.to_numpy()
    at, none = np.concatenate(out_u), np.full(len(a), None, dtype=object)
    counts = pd.arrays.IntegerArray(np.r_[np.zeros(len(at), np.int64), looked], np.r_[np.ones(len(at), bool), np.zeros(len(a), bool)])
    return pd.DataFrame({"u_id": np.concatenate([ua[at], ua]), "c_id": np.concatenate([np.concatenate(out_c).astype(object), none]), "pair": np.concatenate([*out_p, np.full(len(a), np.nan)]), "held": counts})


def mean3(f, *sides: dict[str, Column]) -> Column:
    a, b, c = sides
    return (f(a, b) + f(a, c) + f(b, c)) / 3


def team_score(a: dict[str, Column], b: dict[str, Column], c: dict[str, Column]) -> Column:
    covered = F.least(F.size(F.array_distinct(F.concat(a["strong"], b["strong"], c["strong"]))) / 10, F.lit(1.0))
    return round3(mean3(compatibility, a, b, c) * 0.7 + covered * 0.3)


def recommend(seekers: DataFrame, candidates: DataFrame, top_k: int = 5, exclude: DataFrame | None = None) -> DataFrame:
    """``user_id, first_id, second_id, team_score, skill, level, style_div, coverage, place``."""
    return trios_of(pair_scores(seekers, candidates, exclude), top_k)


def trios_of(best: DataFrame, top_k: int) -> DataFrame:
    """The best teams of each seeker and two of the candidates that ``pair_scores`` kept."""
    rename = lambda df, p: df.select("u_id", *(F.col(f"c_{k}").alias(f"{p}_{k}") for k in ("id", "strong", "weak", "score", "style")), F.col("rk").alias(f"{p}_rk"))
    users = best.select("u_id", "u_strong", "u_weak", "u_score", "u_style").dropDuplicates(["u_id"])
    # ten rows a seeker on either side: 45 trios
    trios = rename(best, "x").join(rename(best, "y"), "u_id").where("x_rk < y_rk").join(users, "u_id")
    u, x, y = side("u"), side("x"), side("y")
    covered = F.least(F.size(F.array_distinct(F.concat(u["strong"], x["strong"], y["strong"]))) / 10, F.lit(1.0))
    out = trios.select(
        F.col("u_id").alias("user_id"), F.col("x_id").alias("first_id"), F.col("y_id").alias("second_id"), team_score(u, x, y).alias("team_score"),
        round3(mean3(lambda a, b: skill_complement(a["strong"], a["weak"], b["strong"], b["weak"]), u, x, y)).alias("skill"),
        round3(mean3(lambda a, b: level_proximity(a["score"], b["score"]), u, x, y)).alias("level"),
        round3(mean3(lambda a, b: style_match(a["style"], b["style"]), u, x, y)).alias("style_div"), round3(covered).alias("coverage"),
    )
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("team_score").desc(), "first_id", "second_id"))
    return out.withColumn("place", place).where(F.col("place") <= top_k)


def pair_detail(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Compatibility of listed (user_id, other_id) pairs with its parts."""
    df = pairs.join(prefixed(profiles, "u"), F.col("user_id") == F.col("u_id")).join(prefixed(profiles, "c"), F.col("other_id") == F.col("c_id"))
    u, c = side("u"), side("c")
    return df.select(
        "user_id", "other_id", compatibility(u, c).alias("total"), round3(skill_complement(u["strong"], u["weak"], c["strong"], c["weak"])).alias("skill"),
        round3(level_proximity(u["score"], c["score"])).alias("level"), round3(style_match(u["style"], c["style"])).alias("style_div"),
    )
