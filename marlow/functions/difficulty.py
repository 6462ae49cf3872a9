"""Difficulty scales, bands and imputations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlow.functions.scores import literal_map

# Named levels on the scale of ten.
LUOGU_TEN = {"入门": 1.0, "普及-": 2.0, "普及/提高-": 3.0, "普及+/提高": 4.0, "提高+/省选-": 5.0, "省选/NOI-": 6.0, "NOI/NOI+": 7.0, "NOI+": 8.0, "CTSC": 9.0, "CTSC+": 10.0}
LEETCODE_TEN = {"Easy": 3.0, "Medium": 5.0, "Hard": 8.0}
# Levels on the rating scale; for the score of 1 to 100, the upper end of each level.
LUOGU_ELO = [600, 1000, 1400, 1800, 2200, 2700, 3200]
LUOGU_ENDS = [5, 12, 20, 35, 45, 70]
NOWCODER_ELO = {"入门": 600, "entry": 600, "简单": 1000, "easy": 1000, "中等": 1700, "medium": 1700, "较难": 2200, "hard": 2200, "困难": 2800, "very_hard": 2800}
NOWCODER_LEVELS = [600, 1000, 1700, 2200, 2800]
LEETCODE_ELO = {"easy": 900, "medium": 1700, "hard": 2500}
ELO_BANDS = [(999, "入门"), (1699, "普及"), (2399, "提高"), (3499, "省选")]


def number(raw: Column) -> Column:
    return raw.try_cast("double")


def clamp(x: Column, low: float, high: float) -> Column:
    # least and greatest pass over nulls
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def to_ten(platform: Column, raw: Column) -> Column:
    """1 to 10; 5 for what is unknown."""
    n, p = number(raw), F.lower(platform)
    value = (
        F.when(p == "luogu", F.element_at(literal_map(LUOGU_TEN), raw)).when(p == "leetcode", F.element_at(literal_map(LEETCODE_TEN), raw))
        .when(p == "codeforces", clamp((n - 800) / 300 + 1, 1.0, 10.0)).when(p == "atcoder", clamp((n - 100) / 300 + 1, 1.0, 10.0))
        .when(p == "nowcoder", clamp(n / 5, 1.0, 10.0))
    )
    return F.coalesce(value, F.lit(5.0))


def _steps(x: Column, ends: list[float], values: list[float]) -> Column:
    out = F.lit(float(values[len(ends)]))
    for end, v in reversed(list(zip(ends, values, strict=False))):
        out = F.when(x <= end, float(v)).otherwise(out)
    return out


def to_elo(platform: Column, raw: Column) -> Column:
    """0 to 3500; 1500 for what is unknown."""
    n, p, s = number(raw), F.lower(platform), F.lower(raw)
    rating = clamp(F.floor(n + 0.5).cast("double"), 0.0, 3500.0)
    floats = lambda m: {k: float(v) for k, v in m.items()}
    luogu = (
        F.when(n <= 0, 1500.0).when((n == F.floor(n)) & n.between(1, 7), F.element_at(F.array(*(F.lit(float(x)) for x in LUOGU_ELO)), F.greatest(F.lit(1), F.least(F.lit(7), n.cast("int")))))
        .when(n.isNotNull(), _steps(n, LUOGU_ENDS, LUOGU_ELO))
    )
    nowcoder = F.coalesce(F.element_at(literal_map(floats(NOWCODER_ELO)), s), F.when(n > 5, rating).when(n <= 1, 600.0).when(n == 2, 1000.0).when(n == 3, 1700.0).when(n == 4, 2200.0).when(n.isNotNull(), 2800.0))
    leetcode = F.coalesce(F.element_at(literal_map(floats(LEETCODE_ELO)), s), F.when(n <= 1, 900.0).when(n == 2, 1700.0).when(n.isNotNull(), 2500.0))
    return F.coalesce(F.when(p == "luogu", luogu).when(p == "nowcoder", nowcoder).when(p == "leetcode", leetcode).otherwise(rating), F.lit(1500.0))


def elo_band(x: Column) -> Column:
    out = F.lit("NOI")
    for end, name in reversed(ELO_BANDS):
        out = F.when(x <= end, name).otherwise(out)
    return out


def ten_colour(x: Column) -> Column:
    return F.when(x <= 3, "green").when(x <= 5, "blue").when(x <= 7, "orange").otherwise("red")


def from_pass_rate(rate: Column) -> Column:
    return F.when(rate >= 0.8, "简单").when(rate >= 0.5, "中等").when(rate >= 0.2, "较难").when(rate.isNotNull(), "困难")


def simple_cf(raw: Column) -> Column:
    """The offline adapter's own scale: rating / 350 * 10, 10 at most; 5 without a rating."""
    return F.coalesce(F.when(number(raw).isNotNull(), F.least(number(raw) / 350 * 10, F.lit(10.0))), F.lit(5.0))
