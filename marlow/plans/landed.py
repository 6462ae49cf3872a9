"""Queries over landing-zone adapters, page tables and scraped text, on pages built from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlow.functions import scraped
from marlow.functions import text as T
from marlow.operators import upsert
from marlow.plans.registry import query
from marlow.sources import catalog as C
from marlow.sources import dims, landing, paged
from marlow.sources.shared import kept, scratch


CRAWLED = "id long, title string, lang string"


def _landed(spark, d, problems) -> str:
    """A landing zone of problem files by platform and day, beside a work list and a broken file."""
    root = scratch(spark, "zone")
    rows = problems.select(F.col("source_platform").alias("platform"), F.date_format("created_at", "yyyy-MM-dd").alias("day"), "id", "title", "lang")
    landing.write_landing(rows, root, "problems")
    landing.put_file(spark, f"{root}/luogu/problems/bulk_list_luogu.json", '[{"id": -1}]')
    landing.put_file(spark, f"{root}/luogu/problems/2024-01-01_broken.json", "{oops")
    return root


@query("s02_json_landing", "S-02 S-03 S-04", "SELECT id, title, lang, 'problems' AS kind, source_platform AS file_key FROM problems")
def s02(spark, d):
    root = _landed(spark, d, C.problems(spark, d))
    out = None
    for platform in C.PLATFORMS:
        one = landing.read_kinds(spark, root, platform, CRAWLED)
        out = one if out is None else out.unionByName(one)
    return out.select("id", "title", "lang", "kind", "file_key")


@query("s04_dated_files", "S-02 S-04", "SELECT id, strftime(created_at, '%Y-%m-%d') || '_luogu.json' AS file FROM problems WHERE source_platform = 'luogu' AND strftime(created_at, '%Y-%m-%d') = '2024-01-01'")
def s04(spark, d):
    root = _landed(spark, d, C.problems(spark, d))
    return landing.read_json_files(spark, f"{root}/luogu/problems", CRAWLED, "2024-01-01").select("id", F.col("file_name").alias("file"))


@query("s05_date_partition", "S-05 S-06", "SELECT id, title, lang FROM problems WHERE source_platform = 'atcoder' AND CAST(created_at AS DATE) = DATE '2024-01-01'")
def s05(spark, d):
    base = scratch(spark, "enriched")
    rows = C.problems(spark, d).select("id", "title", "lang", F.col("source_platform").alias("platform"), F.date_format("created_at", "yyyy-MM-dd").alias("date"))
    landing.write_enriched(rows, base)
    return landing.read_problems(spark, base, "atcoder", "2024-01-01", CRAWLED, order=("id",)).select("id", "title", "lang")


@query("s07_bulk_load", "S-07 U-01", "SELECT source_platform AS platform, source_id, CASE WHEN id % 3 = 0 THEN title ELSE 'old' END AS title FROM problems WHERE id % 3 = 0 OR id % 2 = 0")
def s07(spark, d):
    p = C.problems(spark, d)
    old = p.where("id % 2 = 0").select(F.col("source_platform").alias("platform"), "source_id", F.lit("old").alias("title"))
    root = _landed(spark, d, p.where("id % 3 = 0"))
    out = None
    for platform in C.PLATFORMS:
        raw = landing.read_kinds(spark, root, platform, CRAWLED).withColumn("pid", F.concat(F.lit("P"), F.col("id").cast("string")))
        one = landing.as_common(raw, platform, {"source_id": "pid", "title": "title"}).select("platform", "source_id", "title")
        out = one if out is None else out.unionByName(one)
    return upsert.upsert(old, out, ["platform", "source_id"])


@query("s14_page_fallback", "S-14", "SELECT event_id AS submission_id, event_type AS verdict_raw FROM events")
def s14(spark, d):
    e = C.read_table(spark, d, "events")
    island = F.to_json(F.struct(F.array(F.struct(F.col("event_id").alias("submission_id"), F.col("event_type").alias("verdict_raw"))).alias("list")))
    html = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("<p>x</p><script>window.__INITIAL_STATE__="), island, F.lit(";</script>"))).otherwise(_submission_page())
    return landing.nowcoder_submissions(e.select(html.alias("html")), lambda bare: _pages_of(spark, bare, F.col("html")))


def _refuse_fives(row: dict) -> None:
    if row["user_id"] % 5 == 0:
        raise ConnectionError("refused")


@query("s18_sink_log", "-", "SELECT user_id, user_id % 5 <> 0 AS ok, CASE WHEN user_id % 5 = 0 THEN 'refused' END AS error FROM (SELECT DISTINCT user_id FROM records)")
def s18(spark, d):
    reports = C.practice_records(spark, d).groupBy("user_id").agg(F.count("*").alias("submits"))
    return landing.send_and_log(reports, _refuse_fives, "user_id")


def _refuse_short(row: dict) -> None:
    if len(row["title"] or "") < 20:
        raise ValueError("title is short")


@query("s08_sink_counts", "-", "SELECT source_platform AS platform, count(*) FILTER (length(coalesce(title, '')) >= 20) AS sent, count(*) FILTER (length(coalesce(title, '')) < 20) AS failed FROM problems GROUP BY source_platform")
def s08(spark, d):
    p = C.problems(spark, d).select("id", "title", "source_platform")
    log = landing.send_and_log(p, _refuse_short, "id").join(p.select("id", F.col("source_platform").alias("platform")), "id")
    return log.groupBy("platform").agg(F.count_if("ok").alias("sent"), F.count_if(~F.col("ok")).alias("failed"))


@query("s09_first_filled_source", "S-09 S-24", "SELECT DISTINCT o_custkey || o_orderstatus AS id FROM orders ORDER BY id")
def s09(spark, d):
    o = C.read_table(spark, d, "orders").select(F.col("o_custkey").alias("contestId"), F.col("o_orderstatus").alias("index"))
    return landing.problem_ids(landing.first_filled_source(None, o.where("false"), o))


@query("s10_codeforces_envelope", "S-10", "SELECT event_id AS id, event_type AS verdict FROM events WHERE event_id % 7 <> 0")
def s10(spark, d):
    e = C.read_table(spark, d, "events")
    status = F.when(F.col("event_id") % 7 == 0, "FAILED").otherwise("OK")
    raw = e.select(F.to_json(F.struct(status.alias("status"), F.array(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("verdict"))).alias("result"))).alias("value"))
    return landing.codeforces_envelope(raw, "id: bigint, verdict: string")


_PAGED = """WITH r AS (SELECT platform, user_id, id, verdict, row_number() OVER (PARTITION BY platform, user_id ORDER BY id DESC) AS k FROM records),
p AS (SELECT *, (k - 1) // 20 + 1 AS page, first_value(id) OVER (PARTITION BY platform, user_id, (k - 1) // 20 ORDER BY k) % 11 <> 0 AS ok FROM r)"""


def judge_pages(spark, d):
    """Records of every user, landed as pages once for a session; the answer of a page whose newest id 11 divides has failed."""
    def build(root):
        bad = F.col("id") % 11 == 0
        paged.land_pages(C.practice_records(spark, d).select("platform", F.col("user_id").alias("uid"), "id", "verdict", F.when(bad, "FAILED").otherwise("OK").alias("status"), F.when(bad, "limit exceeded").alias("comment")), root)

    return paged.read_pages(spark, kept(spark, f"{d}/events.parquet", "pages", build))


@query("s10b_paged_answers", "S-10 S-12", _PAGED + """
SELECT platform, CAST(page AS INTEGER) AS page, count(*) FILTER (ok) AS entries, count(DISTINCT CASE WHEN NOT ok THEN user_id END) AS failed, count(DISTINCT user_id) AS users FROM p WHERE page <= 5 GROUP BY platform, page""")
def s10b(spark, d):
    """Five pages of twenty at most; failed answers are counted."""
    return judge_pages(spark, d).groupBy("platform", "page").agg(F.count_if("ok").alias("entries"), F.count_if(~F.col("ok")).alias("failed"), F.count_distinct("uid").alias("users"))


@query("s12b_first_pages", "S-12", _PAGED + " SELECT user_id AS uid, id, verdict FROM p WHERE ok AND page <= 2 AND platform IN ('luogu', 'codeforces')")
def s12b(spark, d):
    """Filters on judge and page are pushed into the source."""
    return judge_pages(spark, d).where((F.col("page") <= 2) & F.col("platform").isin("luogu", "codeforces") & F.col("ok")).select("uid", "id", "verdict")


@query("s11_leetcode_adapter", "S-11 S-25", "SELECT source_id, CASE WHEN id % 2 = 0 THEN 'T' || id ELSE title END AS title, tags FROM problems WHERE id % 3 <> 0 AND title <> ''")
def s11(spark, d):
    i = F.col("id")
    p = C.problems(spark, d).where("title <> ''").select(
        (i % 3 == 0).alias("paidOnly"), F.col("source_id").alias("titleSlug"), F.when(i % 2 == 0, F.concat(F.lit("T"), i.cast("string"))).otherwise("").alias("translatedTitle"), "title", "difficulty",
        F.transform("tags", lambda t: F.struct(t.alias("slug"))).alias("topicTags"), F.lit("").alias("translatedContent"), "content",
    )
    return landing.leetcode_problems(p).select("source_id", "title", "tags")


@query("s12_page_islands", "S-12 F-19", "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN n_chars END AS luogu, CASE WHEN doc_id % 5 <> 0 THEN n_chars END AS nowcoder FROM documents")
def s12(spark, d):
    docs = C.read_table(spark, d, "documents")
    data = F.to_json(F.struct("n_chars", "lang"))
    i = F.col("doc_id")
    # pages without one of the islands, and islands that are no JSON
    first = F.when(i % 3 != 0, F.concat(F.lit('<html><script type="application/json" id="lentille-context">'), data, F.lit("</script>"))).otherwise("<html>")
    second = F.when(i % 5 != 0, F.concat(F.lit("<p>x</p><script>window.__INITIAL_STATE__ = "), data, F.lit(";</script></html>"))).otherwise("<script>window.__INITIAL_STATE__={oops};</script></html>")
    pages = docs.select("doc_id", F.concat(first, second).alias("html"))
    out = landing.luogu_island(pages, "n_chars long").withColumnRenamed("island", "a")
    return landing.nowcoder_island(out, "n_chars long").select("doc_id", F.col("a.n_chars").alias("luogu"), F.col("island.n_chars").alias("nowcoder"))


@query("s13_atcoder_tables", "S-13 J-05 J-15", "SELECT p_partkey AS id, s_name AS contest_id, CASE WHEN p_partkey % 4 = 0 THEN p_retailprice END AS difficulty FROM part LEFT JOIN supplier ON p_partkey = s_suppkey")
def s13(spark, d):
    p = C.read_table(spark, d, "part")
    contests = C.read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("problem_id"), F.col("s_name").alias("contest_id"))
    models = p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("difficulty"))
    return landing.atcoder_problems(p.select(F.col("p_partkey").alias("id")), contests, models)


def _pages_of(spark, df, html, *keep):
    df.select(*keep, html.alias("html")).createOrReplaceTempView("marlow_pages")
    spark.udtf.register("marlow_html_rows", landing.HtmlTableRows)
    return spark.sql(f"SELECT {''.join(f'{k}, ' for k in keep)}t.* FROM marlow_pages, LATERAL marlow_html_rows(html) t")


@query("s16_submission_table", "S-16", "SELECT event_id AS submission_id, event_type AS verdict_raw FROM events")
def s16(spark, d):
    return _submissions(spark, C.spread_rows(C.read_table(spark, d, "events").select("event_id", "event_type")))


def _submission_page():
    cells = F.concat_ws("</td><td>", F.col("event_id").cast("string"), F.lit("<a href='/p/1'>P</a>"), "event_type", F.lit("C++"), F.lit("now"))
    return F.concat(F.lit("<table><tr><th>id</th></tr><tr><td>"), cells, F.lit("</td></tr></table>"))


def _submissions(spark, e):
    return landing.submission_table(_pages_of(spark, e, _submission_page())).select("submission_id", "verdict_raw")


_TAGS = ", ".join(f"('{c}', '{t}')" for c, ts in dims.CATEGORIES.items() for t in ts)
_NEEDS = ", ".join(f"('{t}', '{n}', {i})" for t, ns in dims.PREREQUISITES.items() for i, n in enumerate(ns))


_TAG_LIST = sorted({t for ts in dims.CATEGORIES.values() for t in ts})


@query("s21_dimensions", "S-21", f"""WITH u AS (SELECT ([{", ".join(f"'{t}'" for t in _TAG_LIST)}])[CAST(c_custkey * 3 % {len(_TAG_LIST)} + 1 AS INTEGER)] AS tag FROM customer),
n AS (SELECT tag, count(*) AS needs FROM (VALUES {_NEEDS}) n(tag, needs, position) GROUP BY tag)
SELECT category, count(*) AS users, count(DISTINCT u.tag) AS tags, CAST(sum(coalesce(needs, 0)) AS BIGINT) AS needs FROM u JOIN (VALUES {_TAGS}) c(category, tag) ON u.tag = c.tag LEFT JOIN n ON n.tag = u.tag GROUP BY category""")
def s21(spark, d):
    """Users by the category of the tag they are at, with what these tags need: the lists are joined as tables."""
    tag = F.element_at(F.array(*map(F.lit, _TAG_LIST)), (F.col("c_custkey") * 3 % len(_TAG_LIST) + 1).cast("int"))
    needs = dims.prerequisites(spark).groupBy("tag").agg(F.count("*").alias("needs"))
    # the lists are fixed
    u = C.read_table(spark, d, "customer").select(tag.alias("tag")).join(F.broadcast(dims.tag_category(spark)), "tag").join(F.broadcast(needs), "tag", "left")
    return u.groupBy("category").agg(F.count("*").alias("users"), F.count_distinct("tag").alias("tags"), F.sum(F.coalesce("needs", F.lit(0))).alias("needs"))


@query("s23_problem_table", "S-23", "SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_size AS VARCHAR) AS difficulty, [lower(p_brand), 'x'] AS tags FROM part")
def s23(spark, d):
    # list pages of a hundred rows
    return _problem_pages(spark, C.read_table(spark, d, "part"), F.floor(F.col("p_partkey") / 100))


def _problem_pages(spark, p, page):
    row = F.concat(F.lit("<tr><td><a href='/acm/problem/"), F.col("p_partkey").cast("string"), F.lit("'>t</a></td><td>"), F.col("p_size").cast("string"), F.lit("</td><td>"), F.lower("p_brand"), F.lit("，x</td></tr>"))
    html = F.concat(F.lit("<table><tr><th>题目</th><th>难度</th><th>标签</th></tr>"), F.col("rows"), F.lit("</table>"))
    pages = p.groupBy(page.alias("page")).agg(F.array_join(F.sort_array(F.collect_list(row)), "").alias("rows"))
    return landing.problem_table(_pages_of(spark, pages, html, "page"), page="page")


@query("t03_leetcode_samples", "T-03", """SELECT id, CASE id % 4 WHEN 0 THEN [['a = ' || id, lang], ['b', source]] WHEN 1 THEN [['x', lang]] WHEN 2 THEN [[lang, source], ['1', CAST(id AS VARCHAR)]] ELSE [] END AS samples FROM problems""")
def t03(spark, d):
    n = F.col("id").cast("string")
    strong = F.concat(F.lit("<p>x</p><pre>\n<strong>输入：</strong>a = "), n, F.lit("\n<strong>输出：</strong>"), "lang", F.lit("\n<strong>解释：</strong>because\n</pre><pre><strong>Input:</strong> <b>b</b>\n<strong>Output:</strong> "), "source", F.lit("</pre>"))
    plain = F.concat(F.lit("<pre>Input: x\nOutput: "), "lang", F.lit("\nExplanation: y</pre>"))
    block = lambda a, b: F.concat(F.lit('<div class="example-block"><p><strong>Input:</strong> <span class="example-io">'), a, F.lit('</span></p>\n<p><strong>输出：</strong><span class="example-io">'), b, F.lit("</span></p></div>"))
    blocks = F.concat(block(F.col("lang"), F.col("source")), block(F.lit("1"), n))
    kind = F.col("id") % 4
    html = F.when(kind == 0, strong).when(kind == 1, plain).when(kind == 2, blocks).otherwise(F.concat(F.lit("<p>none</p><pre>int a;</pre>"), "lang"))
    return C.problems(spark, d).select("id", T.leetcode_samples(html).alias("samples"))


@query("t04_sample_strings", "T-04", "SELECT id, CASE id % 3 WHEN 0 THEN [[lang, source], ['1 2', CAST(id AS VARCHAR)]] WHEN 1 THEN [[lang, source], ['1', '']] ELSE [] END AS samples FROM problems")
def t04(spark, d):
    n = F.col("id").cast("string")
    bare = F.concat(F.lit("输入：\n"), "lang", F.lit("\n输出：\n"), "source", F.lit("\n输入: 1 2\n输出: "), n)
    numbered = F.concat(F.lit("示例 1\n输入: "), "lang", F.lit("\n输出: "), "source", F.lit("\n 示例 2：\n输入：1\n输出：\n"))
    kind = F.col("id") % 3
    return C.problems(spark, d).select("id", T.sample_pairs(F.when(kind == 0, bare).when(kind == 1, numbered).otherwise(F.col("lang"))).alias("samples"))


@query("t05_html_samples", "T-05", "SELECT id, CASE id % 4 WHEN 0 THEN [[lang || chr(10) || 'x', source]] WHEN 1 THEN [[lang, source], ['a & b', CAST(id AS VARCHAR)]] WHEN 2 THEN [['1' || chr(10) || lang, source], ['2', 'y']] ELSE [] END AS samples FROM problems")
def t05(spark, d):
    n = F.col("id").cast("string")
    classes = F.concat(F.lit('<div class="input"><div>in</div><pre>'), "lang", F.lit('<br/>x</pre></div><div class="output"><pre>'), "source", F.lit("</pre></div>"))
    turns = F.concat(F.lit("<pre>"), "lang", F.lit("</pre><p>then</p><pre class='a'>"), "source", F.lit("</pre><pre>a &amp; b</pre><pre>"), n, F.lit("</pre>"))
    pair = lambda a, b: F.concat(F.lit('<div class="sample-test input"><pre>'), a, F.lit('</pre></div><div class="output"><div class="title">o</div><pre>'), b, F.lit("</pre></div>"))
    lines = F.concat(F.lit('<div class="line">1</div><div class="line">'), "lang", F.lit("</div>"))
    kind = F.col("id") % 4
    html = F.when(kind == 0, classes).when(kind == 1, turns).when(kind == 2, F.concat(pair(lines, F.col("source")), pair(F.lit("2"), F.lit("y")))).otherwise(F.lit("<pre>alone</pre>"))
    return C.problems(spark, d).select("id", scraped.html_samples_col(html).alias("samples"))


@query("t06_math_cleaner", "T-06", r"""SELECT id, CASE id % 5 WHEN 0 THEN lang || ' 是' || chr(10) || chr(10) || '$x_' || id || ' \le 5$' || chr(10) || chr(10) || '好' WHEN 1 THEN '题 ' || lang || chr(10) || '```' || chr(10) || 'x' || chr(10) || '≤' || chr(10) || 'x_1' || chr(10) || '```' || chr(10) || '好'
WHEN 2 THEN '题' || chr(10) || 'x' || chr(10) || '≤' || chr(10) || '好 ' || lang WHEN 3 THEN '$' || lang || ' \le ' || id || '$' || chr(10) || '好' ELSE '题' || chr(10) || 'n_' || id || ' = 10' || chr(10) || '好' END AS body FROM problems""")
def t06(spark, d):
    n = F.col("id").cast("string")
    kind = F.col("id") % 5
    thrice = F.concat("lang", F.lit(" 是\n\nx\n\n≤\n\nx_"), n, F.lit(" \\le 5\n\n5\n\n好"))
    code = F.concat(F.lit("题 "), "lang", F.lit("\n```\nx\n≤\nx_1\n```\n好"))
    twice = F.concat(F.lit("题\nx\n≤\n好 "), "lang")
    bare = F.concat("lang", F.lit(" \\le\\, "), n, F.lit("\n好"))
    no_command = F.concat(F.lit("题\nn\n10\nn_"), n, F.lit(" = 10\n好"))
    s = F.when(kind == 0, thrice).when(kind == 1, code).when(kind == 2, twice).when(kind == 3, bare).otherwise(no_command)
    return C.problems(spark, d).select("id", scraped.clean_math_col(s).alias("body"))


@query("t07_cluster_cleaners", "T-07 W-05", """SELECT id, CASE id % 3 WHEN 0 THEN '题' || chr(10) || 'a_' || id || chr(10) || '尾' WHEN 1 THEN '题' || chr(10) || 'a' || chr(10) || 'b' || chr(10) || '尾' || lang ELSE '题' || chr(10) || 'x^2' || chr(10) || '尾' END AS ascii,
CASE id % 3 WHEN 0 THEN '有 ' || lang || ' 行' WHEN 1 THEN '输入' || chr(10) || lang || ' 行' || chr(10) || chr(10) || '尾 部' ELSE repeat('长', 30) || chr(10) || lang || chr(10) || repeat('长', 25) END AS merged FROM problems""")
def t07(spark, d):
    n = F.col("id").cast("string")
    kind = F.col("id") % 3
    a = F.when(kind == 0, F.concat(F.lit("题\na\na_"), n, F.lit("\na\n尾"))).when(kind == 1, F.concat(F.lit("题\na\nb\n尾"), "lang")).otherwise(F.lit("题\nabc\nx^2\nxy2\n尾"))
    long = lambda k: F.lit("长" * k)
    m = F.when(kind == 0, F.concat(F.lit("有\n"), "lang", F.lit("\n行"))).when(kind == 1, F.concat(F.lit("输入\n"), "lang", F.lit("\n行\n\n尾\n部"))).otherwise(F.concat(long(30), F.lit("\n"), "lang", F.lit("\n"), long(25)))
    return C.problems(spark, d).select("id", scraped.clean_ascii_clusters_col(a).alias("ascii"), scraped.merge_orphans_col(m).alias("merged"))


@query("t11_page_sections", "T-11 T-12")
def t11(spark, d):
    return C.read_table(spark, d, "pages").select("page_id", F.explode(scraped.html_sections_col(F.col("html"))).alias("s")).select("page_id", "s.title", "s.text")


_SECTIONS = """(SELECT id, 0 AS k, 'Statement ' || id AS title, lang || ' $N$ & **' || source || '**' || chr(10) || chr(10) || '- a' || chr(10) || '- ' || lang AS text FROM problems
UNION ALL SELECT id, 1, 'Input', CASE WHEN id % 2 = 0 THEN '| x | ' || source ELSE '$x^2$ ![pic](' || lang || '.png)' END FROM problems
UNION ALL SELECT id, 2, 'Sample', '```' || chr(10) || '1  2' || chr(10) || lang || chr(10) || '```' FROM problems WHERE id % 3 <> 0)"""


def _statements(spark, d):
    """Statement pages: headings, lists, variables, tables, images of formulas, code, scripts."""
    first = F.concat(F.lit("<nav>menu</nav><section><h3>Statement "), F.col("id").cast("string"), F.lit("</h3><p>"), "lang", F.lit("\n  <var>N</var> &amp; <b>"), "source", F.lit("</b></p><ul><li>a</li><li>"), "lang", F.lit("</li></ul></section>"))
    table = F.concat(F.lit("<table><tr><td>x</td><td>"), "source", F.lit("</td></tr></table>"))
    images = F.concat(F.lit('<p><img class="equation" alt="x^2"> <img src="'), "lang", F.lit('.png" alt="pic"></p>'))
    second = F.concat(F.lit("<h3>Input</h3><script>track()</script>"), F.when(F.col("id") % 2 == 0, table).otherwise(images))
    third = F.when(F.col("id") % 3 != 0, F.concat(F.lit("<h3>Sample</h3><pre>1  2\n"), "lang", F.lit("</pre>"))).otherwise("")
    return C.problems(spark, d).select("id", F.concat(first, second, third).alias("html"))


@query("t12_statement_sections", "T-11 T-12", f"SELECT id, title, text FROM {_SECTIONS}")
def t12(spark, d):
    return _statements(spark, d).select("id", F.explode(scraped.html_sections_col(F.col("html"))).alias("s")).select("id", "s.title", "s.text")


@query("t11_statement_parts", "T-11", """WITH p AS (SELECT *, CASE id % 3 WHEN 0 THEN ['問題文', '入力', 'Sample 1'] ELSE ['Problem Statement', 'Input', 'Sample Input 1'] END AS h FROM problems)
SELECT id, h[k] AS title, CASE k WHEN 1 THEN 'description' WHEN 2 THEN 'input_format' ELSE CASE id % 3 WHEN 0 THEN 'sample' ELSE 'sample_input' END END AS part, CASE k WHEN 1 THEN lang WHEN 2 THEN source ELSE CAST(id AS VARCHAR) END AS text FROM p, (VALUES (1), (2), (3)) n(k)""")
def t11_parts(spark, d):
    """Statements in one language, and in two in either order, of which the English one is read."""
    body = lambda *h: F.concat(*(x for t, c in zip(h, (F.col("lang"), F.col("source"), F.col("id").cast("string")), strict=True) for x in (F.lit(f"<h3>{t}</h3><p>"), c, F.lit("</p>"))))
    ja = F.concat(F.lit('<span class="lang-ja">'), body("問題文", "入力", "Sample 1"), F.lit("</span>"))
    en = F.concat(F.lit('<span class="lang-en">'), body("Problem Statement", "Input", "Sample Input 1"), F.lit("</span>"))
    kind = F.col("id") % 3
    html = F.when(kind == 0, ja).when(kind == 1, F.concat(ja, en)).otherwise(F.concat(en, ja))
    parts = C.problems(spark, d).select("id", F.explode(scraped.html_sections_col(scraped.english_part(html))).alias("s"))
    return parts.select("id", "s.title", scraped.section_key(F.col("s.title")).alias("part"), "s.text")


@query("t13_rendered_formulas", "T-12 T-13", r"""SELECT id, CASE id % 4 WHEN 0 THEN 'let $x_' || id || '$ be ' || lang WHEN 1 THEN 'let $a^{\ast} \le ' || id || '$ be ' || lang WHEN 2 THEN 'let n' || id || ' be ' || lang ELSE 'let be ' || lang END AS markdown FROM problems""")
def t13_formulas(spark, d):
    """Formulas that a page holds two or three times."""
    n = F.col("id").cast("string")
    katex = lambda tex: F.concat(F.lit('<span class="katex"><span class="katex-mathml"><math><mi>x</mi><annotation>'), tex, F.lit('</annotation></math></span><span class="katex-html"><span>x</span></span></span>'))
    mathjax = lambda shown: F.concat(F.lit('<span class="MathJax_Preview">x</span><span class="MathJax"><nobr><span>'), shown, F.lit('</span></nobr></span><script type="math/tex">x</script>'))
    kind = F.col("id") % 4
    formula = F.when(kind == 0, katex(F.concat(F.lit("\\hspace{3pt} x_"), n))).when(kind == 1, mathjax(F.concat(F.lit("a^{\\text{*}} \\le "), n))).when(kind == 2, mathjax(F.concat(F.lit("n"), n))).otherwise(katex(F.lit("\\hspace{3pt}")))
    return C.problems(spark, d).select("id", scraped.html_markdown_col(F.concat(F.lit("<p>let "), formula, F.lit(" be "), "lang", F.lit("</p>"))).alias("markdown"))


@query("t13_statement_markdown", "T-13", f"SELECT id, string_agg('### ' || title || chr(10) || text, chr(10) || chr(10) ORDER BY k) AS markdown FROM {_SECTIONS} GROUP BY id")
def t13_statements(spark, d):
    return _statements(spark, d).select("id", scraped.html_markdown_col(F.col("html")).alias("markdown"))


@query("t13_page_markdown", "T-13")
def t13(spark, d):
    return C.read_table(spark, d, "pages").select("page_id", scraped.html_markdown_col(F.col("html")).alias("markdown"))


@query("t22_math_fences", "T-22", r"""SELECT id, CASE id % 4 WHEN 0 THEN 'let $n_' || id || '$ be ' || lang WHEN 1 THEN 'let $a b_' || id || ' c$ be ' || lang WHEN 2 THEN 'let n be ' || lang ELSE '$\text{max}$ of ' || lang || ', and $x$; then $y$' END AS body FROM problems""")
def t22(spark, d):
    n = F.col("id").cast("string")
    kind = F.col("id") % 4
    one = F.concat(F.lit("let $$$n_"), n, F.lit("$$$ be "), "lang")
    three = F.concat(F.lit("let $$$a$$$ $$$b_"), n, F.lit("$$$$$$ c$$$ be "), "lang")
    open_ = F.concat(F.lit("let $$$n be "), "lang")
    spaced = F.concat(F.lit("$$$\\text{m a x}$$$ of "), "lang", F.lit(",\nand $$$x$$$;\nthen $$$y$$$"))
    s = F.when(kind == 0, one).when(kind == 1, three).when(kind == 2, open_).otherwise(spaced)
    return C.problems(spark, d).select("id", scraped.refence_math_col(s).alias("body"))