"""Filters, lists and lookups over problems, users and configurations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problem_list(problems: DataFrame, platform: str | None = None, low: float | None = None, high: float | None = None, title: str | None = None, tags: list[str] | None = None, page: int = 1, limit: int = 20) -> DataFrame:
    """One page, newest first, with the total of rows that pass the filters in ``total``."""
    df = problems
    if platform:
        df = df.where(F.col("source_platform") == platform)
    if low is not None:
        df = df.where(F.col("difficulty") >= low)
    if high is not None:
        df = df.where(F.col("difficulty") <= high)
    if title:
        df = df.where(F.col("title").contains(title))
    if tags:
        df = df.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    limit = max(1, min(limit, 100))
    total = df.agg(F.count("*").alias("total"))  # one row
    return df.orderBy(F.col("created_at").desc_nulls_last(), "id").offset((page - 1) * limit).limit(limit).crossJoin(F.broadcast(total))


def title_search(problems: DataFrame, text: str, limit: int = 20) -> DataFrame:
    return problems.where(F.col("title").contains(text)).orderBy(F.col("created_at").desc_nulls_last(), "id").limit(limit).withColumn("score", F.lit(0.0))


def user_list(users: DataFrame, role: str | None = None, search: str | None = None, with_account: DataFrame | None = None) -> DataFrame:
    df = users
    if role:
        df = df.where(F.col("role") == role)
    if search and (s := search.strip()):
        df = df.where(F.col("username").contains(s) | F.col("nickname").contains(s) | F.col("department").contains(s))
    if with_account is not None:
        df = df.join(with_account.select(F.col("user_id").alias("id")), "id", "left_semi")
    return df.drop("password_hash", "deleted_at")


def blank(c: Column) -> Column:
    return F.nullif(c, F.lit("")).isNull()


def differs(c: Column, current: str) -> Column:
    """True also where the version is null."""
    return ~c.eqNullSafe(F.lit(current))


def blank_pairs(text: Column) -> Column:
    """Pairs of line feeds, without overlap."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit("\n\n"), F.lit("")))) / 2)


def newer_than_profile(records: DataFrame, profiles: DataFrame) -> DataFrame:
    """``user_id, fresh``: submissions after the user's profile; all where there is none."""
    since = F.coalesce("generated_at", F.timestamp_seconds(F.lit(0)))
    return records.join(profiles.select("user_id", "generated_at"), "user_id", "left").groupBy("user_id").agg(F.count_if(F.col("submit_time") > since).alias("fresh"))


def pending(df: DataFrame, version_col: str, current: str, after: object = None, limit: int | None = None, key: str = "id") -> DataFrame:
    """Rows of another version, in key order, after a resume key, cut at a limit if one is given."""
    out = df.where(differs(F.col(version_col), current))
    if after is not None:
        out = out.where(F.col(key) > F.lit(after))
    out = out.orderBy(key)
    return out.limit(limit) if limit else out


def skip_known(candidates: DataFrame, known: DataFrame, key: str = "id", width: int = 50) -> DataFrame:
    """Neither the id nor its first ``width`` characters are known."""
    k = known.select(F.col(key).alias("__k")).distinct()
    out = candidates.join(k, candidates[key] == F.col("__k"), "left_anti")
    return out.join(k, F.substring(out[key], 1, width) == F.col("__k"), "left_anti")


def english_first(df: DataFrame, is_english: Column, position: str, limit: int) -> DataFrame:
    return df.withColumn("is_english", is_english).orderBy(F.col("is_english").desc(), position).limit(limit)


def not_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """SQL's NOT IN: no row if a key is null (unless there are no keys at all), and no row whose own key is null.

    A plain anti join, behind one aggregate that looks for a null; the null-aware join of Spark would broadcast all keys.
    """
    some = keys.select(F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("nulls"))
    n, nulls = some.first()
    if not n:
        return df
    if nulls:
        return df.where(F.lit(False))
    return df.where(F.col(key).isNotNull()).join(keys.select(key).distinct(), key, "left_anti")


#: Prefixes of tutorials and exercises, whose problems are no contest problems.
TUTORIALS = ["apg4b", "practice", "typical90", "tessoku", "past", "math-and-algorithm", "math_and_algorithm"]
#: Headings of statements in Japanese.
JAPANESE_HEADINGS = ["問題文", "制約", "入力例", "出力例", "入力", "出力"]
#: Titles of pages that a proxy has put in the place of a problem.
BLOCK_TITLES = ["ERROR: The request could not be satisfied", "Access Denied", "403 ERROR", "404 Not Found"]
#: Phrases of advertisements among solutions, and of pages that may not be seen.
ADVERTS = ["扫描二维码", "扫码加入", "下载牛客APP", "扫码添加"]
DENIED = ["没有查看题目的权限", "没有权限"]
#: Marks of a complete summary.
SUMMARY_MARKS = ["【核心考点】", "【推荐解法】", "【易错点】"]


def any_of(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(x) for x in parts))


def contest_problem(problem_id: Column, contest_id: Column) -> Column:
    """A problem of a regular contest: no tutorial prefix, and an id of abc, arc or agc with a digit or separator after
    it, or a contest whose id has a digit and no tutorial prefix. Case doesn't count."""
    pid, cid = F.lower(problem_id), F.lower(F.coalesce(contest_id, F.lit("")))
    tutorial = lambda c: reduce(lambda a, b: a | b, (c.startswith(x) for x in TUTORIALS))
    return ~tutorial(pid) & (pid.rlike(r"^(abc|arc|agc)(\d|[_-])") | ((cid != "") & ~tutorial(cid) & cid.rlike(r"\d")))


def has_statement(description: Column, samples: Column) -> Column:
    """A page that isn't polluted: ten characters of description and a sample at least."""
    return (F.length(F.coalesce(description, F.lit(""))) >= 10) & (F.size(F.coalesce(samples, F.array())) > 0)


def complete_summary(summary: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, (summary.contains(x) for x in SUMMARY_MARKS)), F.lit(False))


def awaiting_vector(problems: DataFrame, summary: str = "solution_summary", vector: str = "vector") -> DataFrame:
    """Live rows with a complete summary and no vector, oldest first, then by id."""
    return problems.where("deleted_at is null").where(complete_summary(F.col(summary)) & F.col(vector).isNull()).orderBy("created_at", "id")


def block_page(title: Column, description: Column, constraints: Column, input_format: Column) -> Column:
    """The title of a proxy's page, and nothing of a problem."""
    nothing = F.coalesce(*(F.nullif(c, F.lit("")) for c in (description, constraints, input_format))).isNull()
    return F.coalesce(any_of(title, BLOCK_TITLES), F.lit(False)) & nothing


def solution_spam(content: Column) -> Column:
    """Under 20 characters, or an advertisement; null is spam, too."""
    c = F.coalesce(content, F.lit(""))
    return (F.length(c) < 20) | any_of(c, ADVERTS)


def permission_denied(html: Column) -> Column:
    return F.coalesce(any_of(html, DENIED), F.lit(False))


def without_markup(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


def statement_language(source_id: Column, html: Column) -> Column:
    """Why a page's statement is no use to readers of English, or null. In this order: ids of ``dp_`` and ``tdpc_`` pass,
    as do pages without a statement; in a statement without language spans, a heading (h3) in Japanese ("headings"),
    then characters of CJK without an English section word, or with more than 0.15 of all characters ("text"); spans
    of Japanese alone ("no english"); an English one of less than 20 characters ("short english").

    The English part reaches from its span to the Japanese one, or to the end.
    """
    statement = F.split_part(F.coalesce(html, F.lit("")), F.lit('id="task-statement">'), F.lit(2))
    en, ja = F.lit('<span class="lang-en">'), F.lit('<span class="lang-ja">')
    has_en, has_ja = F.contains(statement, en), F.contains(statement, ja)
    headings = F.regexp_extract_all(statement, F.lit("(?s)<h3[^>]*>(.*?)</h3>"), 1)
    text = without_markup(statement)
    cjk = text.rlike("[぀-ヿ一-鿿]")
    section = text.rlike(r"(?i)(^|[^\p{L}\p{N}_])(Problem|Constraints?|Input|Output|Sample)([^\p{L}\p{N}_]|$)")
    share = F.length(F.regexp_replace(text, "[^぀-呣一-鿿]", "")) / F.greatest(F.length(F.trim(text)), F.lit(1))
    english = F.trim(without_markup(F.split_part(F.split_part(statement, en, F.lit(2)), ja, F.lit(1))))
    return (
        F.when(source_id.startswith("dp_") | source_id.startswith("tdpc_") | (statement == ""), F.lit(None))
        .when(~has_en & ~has_ja & F.exists(headings, lambda h: any_of(without_markup(h), JAPANESE_HEADINGS)), "headings")
        .when(~has_en & ~has_ja & cjk & (~section | (share > 0.15)), "text")
        .when(~has_en & has_ja, "no english").when(has_en & has_ja & (F.length(english) < 20), "short english")
    )
