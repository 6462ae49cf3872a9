"""Scores as column expressions: ability dimensions, compatibility, problem scores, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplier of the overall score by style.
STYLE_BONUS = {"grinder": 0.6, "deep_diver": 0.8, "specialist": 0.5, "balanced": 1.0}
#: How well two styles go together; other pairs 0.5.
STYLE_PAIRS = {
    ("grinder", "deep_diver"): 1.0, ("grinder", "specialist"): 0.8, ("deep_diver", "specialist"): 0.9, ("balanced", "grinder"): 0.7,
    ("balanced", "deep_diver"): 0.7, ("balanced", "specialist"): 0.7, ("balanced", "balanced"): 0.5,
}


def literal_map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(default))


def sigmoid(x: Column, center: float = 0.5, slope: float = 10.0) -> Column:
    return 1 / (1 + F.exp(-slope * (x - center)))


def proficiency(ac: Column, total: Column, avg_difficulty: Column, days: Column) -> Column:
    return (
        0.4 * sigmoid(safe_div(ac, total)) + 0.3 * F.least(avg_difficulty / 10, F.lit(1.0))
        + 0.2 * F.least(F.log(1 + ac) / F.log(F.lit(31.0)), F.lit(1.0)) + 0.1 * F.exp(-0.023 * F.greatest(days, F.lit(0.0)))
    )


def efficiency(first_ac_rate: Column, avg_retries: Column) -> Column:
    return 0.6 * first_ac_rate + 0.4 * (1 - F.least(avg_retries / 5, F.lit(1.0)))


def momentum(slope: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(slope, F.lit(0.0)) / 0.5))


def style(solved: Column, tags: Column, top3: Column, avg_difficulty: Column) -> Column:
    return (
        F.when((solved >= 200) & (avg_difficulty <= 4), "grinder").when((avg_difficulty >= 7) & (tags <= 8), "deep_diver")
        .when(top3 >= 0.5, "specialist").otherwise("balanced")
    )


def overall(coverage: Column, prof: Column, ceiling: Column, eff: Column, styl: Column, mom: Column) -> Column:
    base = 0.2 * coverage + 0.25 * prof + 0.2 * F.least(ceiling / 10, F.lit(1.0)) + 0.2 * eff
    return base * F.coalesce(F.element_at(literal_map(STYLE_BONUS), styl), F.lit(1.0)) * (1 + 0.1 * mom)


def round3(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x * 1000 + 0.5) / 1000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero or missing, or lengths differ."""
    ok = (F.size(a) == F.size(b)) & (dot(a, a) > 0) & (dot(b, b) > 0)
    return F.coalesce(F.when(ok, dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))), F.lit(0.0))


def cosine_to(a: Column, query: list[float]) -> Column:
    """``cosine`` to a fixed vector, in one pass over ``a``."""
    length = sum(x * x for x in query) ** 0.5
    if not length:
        return F.lit(0.0)
    unit = F.array(*(F.lit(x / length) for x in query))
    steps = F.zip_with(a, unit, lambda x, y: F.struct((x.cast("double") * y).alias("d"), (x.cast("double") * x.cast("double")).alias("n")))
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("n"))
    cos = lambda s: F.when(s["n"] > 0, s["d"] / F.sqrt(s["n"])).otherwise(0.0)
    sums = F.aggregate(steps, zero, lambda s, x: F.struct((s["d"] + x["d"]).alias("d"), (s["n"] + x["n"]).alias("n")), cos)
    return F.coalesce(F.when(F.size(a) == len(query), sums), F.lit(0.0))


def pad_vector(v: Column, dim: int) -> Column:
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), dim)), 1, dim)


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(b) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def gaussian(x: Column, target: Column, sigma: float = 1.5) -> Column:
    return F.exp(-F.pow(x - target, F.lit(2.0)) / (2 * sigma * sigma))


def problem_score(tags: Column, targets: Column, difficulty: Column, target_difficulty: Column, vector_similarity: Column, solved: Column, ready: Column) -> dict[str, Column]:
    """Five dimensions and their weighted total."""
    parts = {
        "tag_match": jaccard(tags, targets), "diff_match": gaussian(difficulty, target_difficulty), "vector_similarity": vector_similarity,
        "novelty": F.when(solved, 0.0).otherwise(1.0), "dependency_satisfied": F.when(ready, 1.0).otherwise(0.2),
    }
    weights = {"tag_match": 0.30, "diff_match": 0.25, "vector_similarity": 0.15, "novelty": 0.15, "dependency_satisfied": 0.15}
    return parts | {"total": sum((w * parts[k] for k, w in weights.items()), F.lit(0.0))}


def style_match(a: Column, b: Column) -> Column:
    """Either order counts; case and outer blanks don't."""
    pairs = {f"{x}_{y}": v for (x, y), v in STYLE_PAIRS.items()}
    pairs |= {f"{y}_{x}": v for (x, y), v in STYLE_PAIRS.items()}
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.coalesce(F.element_at(literal_map(pairs), F.concat_ws("_", norm(a), norm(b))), F.lit(0.5))


def overlap_count(a: Column, b: Column) -> Column:
    """Entries of ``a`` that ``b`` has; repeats in ``a`` count."""
    return F.size(F.filter(a, lambda x: F.array_contains(b, x)))


def skill_complement(a_strong: Column, a_weak: Column, b_strong: Column, b_weak: Column) -> Column:
    return (overlap_count(a_strong, b_weak) + overlap_count(b_strong, a_weak)) / F.greatest(F.size(a_strong) + F.size(b_strong), F.lit(1))


def level_proximity(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(a - b) * 2)


def compatibility(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """``a`` and ``b`` have strong, weak, score, style."""
    return round3(0.5 * skill_complement(a["strong"], a["weak"], b["strong"], b["weak"]) + 0.3 * level_proximity(a["score"], b["score"]) + 0.2 * style_match(a["style"], b["style"]))


def sm2(history: Column) -> Column:
    """Replay of review qualities (array of int): struct of ``ease`` and ``interval`` (days, 365 at most)."""
    start = F.struct(F.lit(2.5).alias("ease"), F.lit(1).alias("interval"))

    def step(acc: Column, q: Column) -> Column:
        good = F.greatest(F.lit(1.3), acc["ease"] + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))
        ease = F.when(q >= 3, good).otherwise(F.greatest(F.lit(1.3), acc["ease"] - 0.15))
        # doubling stops at the cap, which nothing below a reset can undo
        return F.struct(ease.cast("double").alias("ease"), F.when(q >= 3, F.least(acc["interval"] * 2, F.lit(1 << 20))).otherwise(1).cast("int").alias("interval"))

    done = F.aggregate(history, start.cast("struct<ease:double,interval:int>"), step)
    return F.struct(F.round(done["ease"], 2).alias("ease"), F.least(done["interval"], F.lit(365)).alias("interval"))
