"""Ids, links, tags and verdicts of the five judges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlow.functions.scores import literal_map
from marlow.sources.dims import TAG_SLUGS

# Spellings of verdicts.
VERDICTS = {
    "ok": "OK", "ac": "OK", "accepted": "OK", "wa": "WA", "wrong_answer": "WA", "wrong answer": "WA", "tle": "TLE", "time_limit_exceeded": "TLE", "time limit exceeded": "TLE",
    "mle": "MLE", "memory_limit_exceeded": "MLE", "memory limit exceeded": "MLE", "re": "RE", "runtime_error": "RE", "runtime error": "RE", "ce": "CE", "compilation_error": "CE", "compile error": "CE",
    "ole": "OLE", "output_limit_exceeded": "OLE", "se": "SE", "system_error": "SE",
}


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def source_url(platform: Column, sid: Column, contest: Column, index: Column, slug: Column, given: Column) -> Column:
    c = F.nullif(contest, F.lit(""))
    built = (
        F.when(platform == "luogu", F.concat(F.lit("https://www.luogu.com.cn/problem/"), sid))
        .when(platform == "codeforces", F.concat(F.lit("https://codeforces.com/problemset/problem/"), c, F.lit("/"), F.nullif(index, F.lit(""))))
        .when(platform == "leetcode", F.concat(F.lit("https://leetcode.cn/problems/"), F.nullif(slug, F.lit("")), F.lit("/")))
        .when(platform == "nowcoder", F.concat(F.lit("https://ac.nowcoder.com/acm/problem/"), sid))
        .when(platform == "atcoder", F.concat(F.lit("https://atcoder.jp/contests/"), F.coalesce(c, sid), F.lit("/tasks/"), sid))
    )
    return F.coalesce(F.nullif(given, F.lit("")), built)


def contest_and_index(c: Column) -> Column:
    """``1234B2`` -> struct(contest 1234, index B2)."""
    return F.struct(F.regexp_extract(c, r"^(\d+)([A-Z]\d*)$", 1).try_cast("int").alias("contest"), F.nullif(F.regexp_extract(c, r"^(\d+)([A-Z]\d*)$", 2), F.lit("")).alias("index"))


def atcoder_contest(task: Column) -> Column:
    """``abc123_a`` -> ``abc123``."""
    return F.regexp_extract(task, r"^(.+)_[^_]+$", 1)


def contest_prefix(c: Column) -> Column:
    """Letters before the first digit, lower case."""
    return F.lower(F.regexp_extract(c, r"^([a-zA-Z]+)\d", 1))


def slug(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("-"))


def tag_slugs(tags: Column) -> Column:
    return F.array_distinct(F.transform(tags, slug))


def raw_tags(text: Column) -> Column:
    """Tags of a JSON list whose entries are texts or objects: a text stands for itself, an object for its name, else its
    slug; what is no list, or no JSON, has no tags. Other entries are as they are written."""
    items = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")

    def tag(t: Column) -> Column:
        part = lambda name: F.nullif(F.try_variant_get(t, f"$.{name}", "string"), F.lit(""))
        whole = F.try_variant_get(t, "$", "string")
        return F.when(F.is_variant_null(t), "null").when(F.schema_of_variant(t).startswith("OBJECT"), F.coalesce(part("name"), part("slug"), F.lit("[object Object]"))).otherwise(whole)

    return F.coalesce(F.transform(items, tag), F.array().cast("array<string>"))


def english_slug(tag: Column) -> Column:
    """The English slug of a tag; of one that isn't known, its small letters with dashes for blanks."""
    return F.coalesce(F.element_at(literal_map(TAG_SLUGS), tag), F.replace(F.lower(tag), F.lit(" "), F.lit("-")))


def verdict(raw: Column) -> Column:
    """One of the nine verdicts; OTHER for what is unknown."""
    return F.coalesce(F.element_at(literal_map(VERDICTS), F.lower(F.trim(raw))), F.lit("OTHER"))


def normalise_tags(tags: Column, platform: Column, aliases: Column) -> Column:
    """Order and repeats stay; ``aliases`` maps ``platform:raw`` to the tag; unknown ones are marked."""
    return F.transform(tags, lambda t: F.coalesce(F.element_at(aliases, F.concat_ws(":", platform, t)), F.concat(F.lit("unmapped:"), t)))


def file_key(name: Column) -> Column:
    return F.regexp_replace(name, r"^\d{4}-\d{2}-\d{2}_|\.json$", "")


def retryable(message: Column) -> Column:
    return F.coalesce(message.rlike("(?i)429|503|502|504|timeout|timed out|connection"), F.lit(False))


def backoff(attempt: Column, base: float = 1.0, times: float = 2.0, most: float = 30.0) -> Column:
    """Seconds to wait before attempt 0, 1, 2 ...; jitter is left to the caller, so that plans stay deterministic."""
    return F.least(F.lit(base) * F.pow(F.lit(times), attempt.cast("double")), F.lit(most))
