"""Queries over quality predicates, tags of two forms, UTF-16 units, and mutations that go through the snapshot log."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlow.functions import identity as I
from marlow.functions import text as T
from marlow.operators import dedup, filters, snapshots, upsert
from marlow.plans.registry import query
from marlow.sources import catalog as C
from marlow.sources import dims
from marlow.sources.shared import scratch

ANY = lambda x, parts: "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"
STARTS = lambda x, parts: "(" + " OR ".join(f"starts_with({x}, '{p}')" for p in parts) + ")"
PICK = lambda n, *parts: F.element_at(F.array(*map(F.lit, parts)), (n % len(parts) + 1).cast("int"))
PICKED = lambda n, *parts: f"([{', '.join(repr(p) for p in parts)}])[CAST({n} % {len(parts)} + 1 AS INTEGER)]"

# --- predicates ----------------------------------------------------------------------------------

_PREFIXES = ("abc", "ARC_", "agc-", "apg4b_", "xmascon", "Practice_", "past", "abcd", "tessoku", "abc")
_CONTESTS = ("", "DP2024", "PAST12", "yahoo", "math-and-algorithm7", "wupc9")


@query("p16_contest_filter", "P-16", rf"""WITH t AS (SELECT page_id, lower({PICKED("page_id", *_PREFIXES)} || page_id || '_a') AS pid, lower({PICKED("page_id // 10", *_CONTESTS)}) AS cid FROM pages)
SELECT page_id FROM t WHERE NOT {STARTS("pid", filters.TUTORIALS)} AND (regexp_matches(pid, '^(abc|arc|agc)(\d|[_-])') OR (cid <> '' AND NOT {STARTS("cid", filters.TUTORIALS)} AND regexp_matches(cid, '\d')))""")
def p16(spark, d):
    n = F.col("page_id")
    pid, cid = F.concat(PICK(n, *_PREFIXES), n.cast("string"), F.lit("_a")), F.nullif(PICK(F.floor(n / 10), *_CONTESTS), F.lit(""))
    return C.read_table(spark, d, "pages").where(filters.contest_problem(pid, cid)).select("page_id")


@query("p22_has_statement", "P-22", "SELECT id FROM (SELECT id, CASE WHEN id % 4 = 0 THEN left(content, 12) WHEN id % 9 <> 0 THEN content END AS description, id % 6 AS samples FROM problems) WHERE length(coalesce(description, '')) >= 10 AND samples BETWEEN 1 AND 4")
def p22(spark, d):
    i, c = F.col("id"), F.col("content")
    description = F.when(i % 4 == 0, F.left(c, F.lit(12))).when(i % 9 != 0, c)
    samples = F.when(i % 6 == 0, F.array().cast("array<string>")).when(i % 6 != 5, F.array_repeat(F.lit("1 2"), (i % 6).cast("int")))
    return C.problems(spark, d).where(filters.has_statement(description, samples)).select("id")


_SUMMARY = "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN '【核心考点】a【推荐解法】b' WHEN 2 THEN '' ELSE '【核心考点】a' || lang || '【推荐解法】b【易错点】c' END"


@query("p23_awaiting_vector", "P-23", f"SELECT id, CAST(row_number() OVER (ORDER BY created_at, id) AS INTEGER) AS place FROM (SELECT *, {_SUMMARY} AS s FROM problems) WHERE {' AND '.join(f'contains(s, {m!r})' for m in filters.SUMMARY_MARKS)} AND id % 3 <> 0 QUALIFY place <= 100")
def p23(spark, d):
    i = F.col("id")
    summary = F.when(i % 5 == 1, "【核心考点】a【推荐解法】b").when(i % 5 == 2, "").when(i % 5 != 0, F.concat(F.lit("【核心考点】a"), "lang", F.lit("【推荐解法】b【易错点】c")))
    p = C.problems(spark, d).select("id", "created_at", "deleted_at", summary.alias("solution_summary"), F.when(i % 3 == 0, F.array(F.lit(1.0))).alias("vector"))
    # the next hundred to be embedded
    from pyspark.sql import Window

    return filters.awaiting_vector(p).limit(100).select("id", F.row_number().over(Window.orderBy("created_at", "id")).alias("place"))


_H3 = ("Problem Statement", "<b>問題文</b>", "Input", "入力例 1", "制約")
_CJK = "これは問題です。整数が与えられる。"


def _page(n, text):
    """A page: old ones without spans, with English or Japanese headings and texts; new ones with spans; others."""
    h3 = F.concat(F.lit("<h3>"), PICK(F.floor(n / 8), *_H3), F.lit("</h3><p>"))
    head, cut = F.lit('<html><div id="task-statement">'), F.left(text, F.lit(200))
    old = F.concat(head, h3, cut, F.lit("</p>"))
    spans = lambda en: F.concat(head, F.lit('<span class="lang-ja">' + _CJK + '</span><span class="lang-en"><p>'), en, F.lit("</p></span>"))
    return (
        F.when(n % 8 == 0, old).when(n % 8 == 1, F.concat(head, F.lit("<h3>Notes</h3>"), F.lit(_CJK), F.left(text, F.lit(30)))).when(n % 8 == 2, F.concat(head, F.lit("<h3>Input</h3>" + _CJK), cut))
        .when(n % 8 == 3, F.concat(head, F.lit('<span class="lang-ja">' + _CJK + "</span>"))).when(n % 8 == 4, spans(cut)).when(n % 8 == 5, spans(F.left(text, F.lit(12)))).when(n % 8 == 6, F.concat(F.lit("<html>"), cut))
    )


_PAGE = f"""CASE id % 8 WHEN 0 THEN '<html><div id="task-statement"><h3>' || {PICKED("id // 8", *_H3)} || '</h3><p>' || left(content, 200) || '</p>' WHEN 1 THEN '<html><div id="task-statement"><h3>Notes</h3>{_CJK}' || left(content, 30)
WHEN 2 THEN '<html><div id="task-statement"><h3>Input</h3>{_CJK}' || left(content, 200) WHEN 3 THEN '<html><div id="task-statement"><span class="lang-ja">{_CJK}</span>'
WHEN 4 THEN '<html><div id="task-statement"><span class="lang-ja">{_CJK}</span><span class="lang-en"><p>' || left(content, 200) || '</p></span>' WHEN 5 THEN '<html><div id="task-statement"><span class="lang-ja">{_CJK}</span><span class="lang-en"><p>' || left(content, 12) || '</p></span>'
WHEN 6 THEN '<html>' || left(content, 200) END"""


@query("p27_language_ratio", "P-27", rf"""WITH p AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'dp_' || id WHEN id % 13 = 0 THEN 'tdpc_' || id ELSE 'abc' || id END AS source_id, split_part(coalesce({_PAGE}, ''), 'id="task-statement">', 2) AS s FROM problems),
t AS (SELECT *, contains(s, '<span class="lang-en">') AS en, contains(s, '<span class="lang-ja">') AS ja, regexp_extract_all(s, '(?s)<h3[^>]*>(.*?)</h3>', 1) AS h, regexp_replace(s, '<[^>]*>', '', 'g') AS x,
  trim(regexp_replace(split_part(split_part(s, '<span class="lang-en">', 2), '<span class="lang-ja">', 1), '<[^>]*>', '', 'g')) AS e FROM p),
v AS (SELECT id, CASE WHEN starts_with(source_id, 'dp_') OR starts_with(source_id, 'tdpc_') OR s = '' THEN NULL
  WHEN NOT en AND NOT ja AND len(list_filter(h, lambda y: {ANY("regexp_replace(y, '<[^>]*>', '', 'g')", filters.JAPANESE_HEADINGS)})) > 0 THEN 'headings'
  WHEN NOT en AND NOT ja AND regexp_matches(x, '[぀-ヿ一-鿿]') AND (NOT regexp_matches(x, '(?i)(^|[^\p{{L}}\p{{N}}_])(Problem|Constraints?|Input|Output|Sample)([^\p{{L}}\p{{N}}_]|$)') OR length(regexp_replace(x, '[^぀-呣一-鿿]', '', 'g')) / greatest(length(trim(x)), 1) > 0.15) THEN 'text'
  WHEN NOT en AND ja THEN 'no english' WHEN en AND ja AND length(e) < 20 THEN 'short english' END AS reason FROM t)
SELECT id, reason FROM v WHERE reason IS NOT NULL""")
def p27(spark, d):
    i = F.col("id")
    source_id = F.concat(F.when(i % 11 == 0, "dp_").when(i % 13 == 0, "tdpc_").otherwise("abc"), i.cast("string"))
    return C.problems(spark, d).select("id", filters.statement_language(source_id, _page(i, F.col("content"))).alias("reason")).where("reason is not null")


_TITLES = ("Access Denied", "A - Sum", "502 - 403 ERROR", "ERROR: The request could not be satisfied", "404 not found")


@query("p28_block_pages", "P-28", f"""SELECT id FROM (SELECT id, {PICKED("id", *_TITLES)} AS title, CASE WHEN id % 3 = 0 THEN content WHEN id % 3 = 1 THEN '' END AS a, CASE WHEN id % 7 = 0 THEN lang END AS b, CASE WHEN id % 4 = 0 THEN '' END AS c FROM problems)
WHERE {ANY("title", filters.BLOCK_TITLES)} AND coalesce(nullif(a, ''), nullif(b, ''), nullif(c, '')) IS NULL""")
def p28(spark, d):
    i = F.col("id")
    parts = (F.when(i % 3 == 0, F.col("content")).when(i % 3 == 1, ""), F.when(i % 7 == 0, F.col("lang")), F.when(i % 4 == 0, ""))
    return C.problems(spark, d).where(filters.block_page(PICK(i, *_TITLES), *parts)).select("id")


_SAID = "CASE WHEN id % 10 = 0 THEN left(content, 19) WHEN id % 10 = 3 THEN content || '请扫描二维码' WHEN id % 10 = 4 THEN '下载牛客APP' || content WHEN id % 10 <> 7 THEN content END"


@query("p29_solution_spam", "P-29", f"SELECT id FROM (SELECT id, coalesce({_SAID}, '') AS c FROM problems) WHERE length(c) < 20 OR {ANY('c', filters.ADVERTS)}")
def p29(spark, d):
    i, c = F.col("id") % 10, F.col("content")
    said = F.when(i == 0, F.left(c, F.lit(19))).when(i == 3, F.concat(c, F.lit("请扫描二维码"))).when(i == 4, F.concat(F.lit("下载牛客APP"), c)).when(i != 7, c)
    return C.problems(spark, d).where(filters.solution_spam(said)).select("id")


@query("p31_permission_denied", "P-31", f"SELECT page_id FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN html || '没有查看题目的权限' WHEN 1 THEN '<p>没有权限' || html WHEN 2 THEN NULL ELSE html END AS h FROM pages) WHERE {ANY('h', filters.DENIED)}")
def p31(spark, d):
    i, h = F.col("page_id") % 6, F.col("html")
    return C.read_table(spark, d, "pages").where(filters.permission_denied(F.when(i == 0, F.concat(h, F.lit("没有查看题目的权限"))).when(i == 1, F.concat(F.lit("<p>没有权限"), h)).when(i != 2, h))).select("page_id")


# --- tags, units ---------------------------------------------------------------------------------

_RAW_TAGS = """CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '[oops' WHEN 2 THEN '{"name": "no list"}' WHEN 3 THEN '["' || p_brand || '", {"name": "动态规划", "slug": "dp"}, {"name": "", "slug": "' || p_type || '"}]'
WHEN 4 THEN '[{"slug": "贪心"}, {"id": 5}, 12, null, true, "贪心"]' WHEN 5 THEN '[]' ELSE '["字典树", "' || p_type || '"]' END"""
_SLUG_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in dims.TAG_SLUGS.items()) + "}"


@query("f16_variant_tags", "F-16 F-17", f"""WITH r AS (SELECT p_partkey AS id, {_RAW_TAGS} AS raw FROM part),
t AS (SELECT id, CASE WHEN json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN raw END) = 'ARRAY' THEN list_transform(CAST(CAST(raw AS JSON) AS JSON[]), lambda x: CASE WHEN x IS NULL OR json_type(x) = 'NULL' THEN 'null' WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$')
  WHEN json_type(x) = 'OBJECT' THEN coalesce(nullif(json_extract_string(x, '$.name'), ''), nullif(json_extract_string(x, '$.slug'), ''), '[object Object]') ELSE CAST(x AS VARCHAR) END) ELSE CAST([] AS VARCHAR[]) END AS tags FROM r)
SELECT id, tags, list_transform(tags, lambda x: coalesce({_SLUG_MAP}[x], replace(lower(x), ' ', '-'))) AS slugs FROM t""")
def f16(spark, d):
    i = F.col("p_partkey") % 7
    mixed = F.concat(F.lit('["'), "p_brand", F.lit('", {"name": "动态规划", "slug": "dp"}, {"name": "", "slug": "'), "p_type", F.lit('"}]'))
    raw = (
        F.when(i == 1, "[oops").when(i == 2, '{"name": "no list"}').when(i == 3, mixed).when(i == 4, '[{"slug": "贪心"}, {"id": 5}, 12, null, true, "贪心"]').when(i == 5, "[]")
        .when(i == 6, F.concat(F.lit('["字典树", "'), "p_type", F.lit('"]')))
    )
    tags = C.read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), I.raw_tags(raw).alias("tags"))
    return tags.select("id", "tags", F.transform("tags", I.english_slug).alias("slugs"))


_ASTRAL = "CASE id % 3 WHEN 0 THEN '😀' || content WHEN 1 THEN left(content, 100) || '𝒳😀' || content ELSE content END"
_UNITS = "flatten(list_transform(list_transform(string_split(left({x}, {n}), ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda u: CASE WHEN u > 65535 THEN [55296 + (u - 65536) // 1024, 56320 + (u - 65536) % 1024] ELSE [u] END))[1:{n}]"


def _astral(spark, d):
    i, c = F.col("id") % 3, F.col("content")
    return C.problems(spark, d).where(F.length("content") > 0).select("id", F.when(i == 0, F.concat(F.lit("😀"), c)).when(i == 1, F.concat(F.left(c, F.lit(100)), F.lit("𝒳😀"), c)).otherwise(c).alias("text"))


@query("d06b_hash_of_units", "D-06", f"""WITH t AS (SELECT id, {_UNITS.format(x="text", n=200)} AS u FROM (SELECT id, {_ASTRAL} AS text FROM problems WHERE length(content) > 0)),
h AS (SELECT id, list_reduce(list_prepend(CAST(0 AS BIGINT), u), lambda a, b: (a * 31 + b) % 4294967296) AS h FROM t)
SELECT id, CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 100000 AS BIGINT) AS bucket FROM h""")
def d06b(spark, d):
    return _astral(spark, d).select("id", dedup.rolling_hash(F.col("text")).alias("bucket"))


_CUT = "CASE WHEN len({u}) = {n} AND {u}[{n}] BETWEEN 55296 AND 56319 THEN left({x}, CAST(len(list_filter({u}, lambda q: q NOT BETWEEN 56320 AND 57343)) - 1 AS BIGINT)) || chr(65533) ELSE left({x}, CAST(len(list_filter({u}, lambda q: q NOT BETWEEN 56320 AND 57343)) AS BIGINT)) END"


@query("f21_unit_cuts", "F-21", f"""WITH t AS (SELECT id, text, {_UNITS.format(x="text", n=101)} AS u101, {_UNITS.format(x="text", n=250)} AS u250 FROM (SELECT id, {_ASTRAL} AS text FROM problems WHERE length(content) > 0))
SELECT id, {_CUT.format(u="u101", n=101, x="text")} AS cut_101, {_CUT.format(u="u250", n=250, x="text")} AS cut_250 FROM t""")
def f21(spark, d):
    return _astral(spark, d).select("id", T.utf16_left(F.col("text"), 101).alias("cut_101"), T.utf16_left(F.col("text"), 250).alias("cut_250"))


# --- mutations -----------------------------------------------------------------------------------


def logged(spark, first, *changes):
    """What the snapshot log holds after ``first`` and each change of it, one commit after the other."""
    root = scratch(spark, "log")
    snapshots.commit(first, root, 0)
    for change in changes:
        snapshots.update(spark, root, change)
    return snapshots.read(spark, root)


@query("u01b_restored_problems", "U-01 S-07", """WITH e AS (SELECT id, source_platform, source_id, title, lang, deleted_at IS NOT NULL AS gone FROM allproblems),
i AS (SELECT source_platform, source_id, 'new ' || lang AS title, id AS seq FROM allproblems WHERE id % 3 = 0 UNION ALL SELECT source_platform, ' ' || source_id || ' ', 'newer', id + 1000000 FROM allproblems WHERE id % 6 = 0
 UNION ALL SELECT source_platform, repeat('N', 46) || lpad(CAST(id % 1000 AS VARCHAR), 4, '0') || 'cut', 'first', id + 2000000 FROM allproblems WHERE id % 5 = 0 UNION ALL SELECT source_platform, '', 'no key', id FROM allproblems),
k AS (SELECT source_platform, left(trim(source_id), 50) AS source_id, title, seq FROM i WHERE trim(source_id) <> '' QUALIFY row_number() OVER (PARTITION BY source_platform, left(trim(source_id), 50) ORDER BY seq DESC, title) = 1)
SELECT coalesce(e.id, k.seq + 100000000) AS id, k.source_platform, k.source_id, k.title, e.lang, false AS gone FROM k LEFT JOIN e ON e.source_platform = k.source_platform AND e.source_id = k.source_id AND NOT e.gone
UNION ALL SELECT e.* FROM e ANTI JOIN k ON e.source_platform = k.source_platform AND e.source_id = k.source_id""")
def u01b(spark, d):
    p = C.problems(spark, d, include_deleted=True)
    i = F.col("id")
    one = lambda cond, sid, title, more: p.where(cond).select("source_platform", sid.alias("source_id"), title.alias("title"), (i + more).alias("seq"))
    name = F.concat(F.lit("N" * 46), F.lpad((i % 1000).cast("string"), 4, "0"), F.lit("cut"))
    batches = [
        one(i % 3 == 0, F.col("source_id"), F.concat(F.lit("new "), "lang"), 0), one(i % 6 == 0, F.concat(F.lit(" "), "source_id", F.lit(" ")), F.lit("newer"), 1_000_000),
        one(i % 5 == 0, name, F.lit("first"), 2_000_000), one(i >= 0, F.lit(""), F.lit("no key"), 0),
    ]
    whole = batches[0].unionByName(batches[1]).unionByName(batches[2]).unionByName(batches[3])
    first = p.select("id", "source_platform", "source_id", "title", "lang", "deleted_at")
    got = logged(spark, first, lambda df: upsert.upsert_problems(df, whole, F.col("seq") + 100_000_000))
    return got.select("id", "source_platform", "source_id", "title", "lang", F.col("deleted_at").isNotNull().alias("gone"))


_HASH = "(SELECT CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 100000 AS BIGINT) FROM (SELECT list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(left(content, 200), ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, b: (a * 31 + b) % 4294967296) AS h))"


@query("u02b_stored_solutions", "U-02", f"""WITH i AS (SELECT source_platform, source_id, CASE WHEN l_linenumber % 5 = 4 THEN '' ELSE 'text ' || l_linenumber % 3 || l_returnflag END AS content, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'a' || l_partkey % 9 END AS author,
  CASE WHEN l_orderkey % 2 = 0 THEN l_linenumber + 100000 END AS given, l_orderkey * 10 + l_linenumber AS seq, id AS problem_id FROM lineitem JOIN problems ON id = l_orderkey),
r AS (SELECT problem_id, source_platform IN ('codeforces', 'atcoder') AS one, CASE WHEN source_platform = 'codeforces' THEN coalesce(given % 100000, 0) ELSE {_HASH} END AS solution_index, content, coalesce(author, '匿名') AS author, seq FROM i WHERE content <> ''),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY problem_id, CASE WHEN one THEN -1 ELSE solution_index END ORDER BY seq DESC, content, author) = 1),
e AS (SELECT problem_id, CAST(solution_index AS BIGINT) AS solution_index, content, 'p' || author AS author FROM solutions)
SELECT problem_id, solution_index, content, author FROM k UNION ALL SELECT * FROM e WHERE problem_id NOT IN (SELECT problem_id FROM k WHERE one) AND (problem_id, solution_index) NOT IN (SELECT (problem_id, solution_index) FROM k)""")
def u02b(spark, d):
    p = C.problems(spark, d)
    li = C.read_table(spark, d, "lineitem").join(p.select(F.col("id").alias("l_orderkey"), "source_platform", "source_id"), "l_orderkey")
    n = F.col("l_linenumber")
    incoming = li.select(
        "source_platform", "source_id", F.when(n % 5 == 4, "").otherwise(F.concat(F.lit("text "), (n % 3).cast("string"), "l_returnflag")).alias("content"),
        F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("a"), (F.col("l_partkey") % 9).cast("string"))).alias("author"),
        F.when(F.col("l_orderkey") % 2 == 0, n + 100_000).alias("solution_index"), (F.col("l_orderkey") * 10 + n).alias("seq"),
    )
    first = C.solutions(spark, d).select("problem_id", F.col("solution_index").cast("long").alias("solution_index"), "content", F.concat(F.lit("p"), F.col("author").cast("string")).alias("author"))
    return logged(spark, first, lambda df: upsert.upsert_solutions(df, p, incoming))


@query("u09_clear_vectors", "U-09", """SELECT vec_id AS id, CASE WHEN label = 3 THEN NULL WHEN vec_id % 4 = 0 THEN 1 ELSE len(embedding) END AS n, CASE WHEN vec_id % 4 = 0 THEN 'v2' ELSE 'v1' END AS embedding_version,
CASE WHEN vec_id % 4 = 0 THEN TIMESTAMP '2024-01-30' ELSE TIMESTAMP '2024-01-01' END AS embedding_generated_at, CASE WHEN label = 3 THEN TIMESTAMP '2024-01-31' WHEN vec_id % 4 = 0 THEN TIMESTAMP '2024-01-30' ELSE TIMESTAMP '2024-01-01' END AS updated_at FROM embeddings""")
def u09(spark, d):
    """Every fourth vector is rewritten, then those of one label are cleared."""
    then = F.lit("2024-01-01").cast("timestamp")
    v = C.read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", F.lit("v1").alias("embedding_version"), then.alias("embedding_generated_at"), then.alias("updated_at"))
    new = v.where("id % 4 < 2").select("id", F.when(F.col("id") % 4 == 0, F.array(F.lit(1.0).cast("float"))).otherwise(F.array().cast("array<float>")).alias("vector"))
    out = upsert.clear_vectors(upsert.rewrite_vectors(v, new, "v2", "2024-01-30"), "2024-01-31", F.col("label") == 3)
    return out.select("id", F.when(F.col("vector").isNotNull(), F.size("vector")).cast("long").alias("n"), "embedding_version", "embedding_generated_at", "updated_at")


@query("u14_mark_failed", "U-14 W-07", """SELECT id, CASE WHEN stuck THEN 'failed' ELSE status END AS status, CASE WHEN stuck THEN TIMESTAMP '2024-01-30 12:00:00' END AS finished_at FROM (SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'done' ELSE 'running' END AS status,
event_type <> 'view' AND ts < TIMESTAMP '2024-01-30 11:30:00' AS stuck FROM events)""")
def u14(spark, d):
    e = C.read_table(spark, d, "events")
    jobs = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "done").otherwise("running").alias("status"), F.col("ts").alias("updated_at"), F.lit(None).cast("timestamp").alias("finished_at"))
    return upsert.fail_stuck(jobs, "2024-01-30 12:00:00").select("id", "status", "finished_at")
