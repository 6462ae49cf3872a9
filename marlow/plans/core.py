"""Queries over filters, joins, aggregates, windows and sorts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlow.operators import filters
from marlow.plans.registry import query
from marlow.sources import catalog as C

AS_OF = "2024-01-30"


def long_sum(c):
    return F.sum(c.cast("long"))


@query("s01_live_scan", "S-01", "SELECT id, source_platform, lang FROM problems")
def s01(spark, d):
    return C.problems(spark, d).select("id", "source_platform", "lang")


_PROBED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("s19_health", "S-19", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) = 1 AS up FROM (SELECT 1 FROM {t} LIMIT 1)" for t in _PROBED))
def s19(spark, d):
    """A probe of every table: whether a row can be read."""
    return C.health(spark, d, _PROBED)


@query("s20_seed_upsert", "S-20 U-01", "SELECT id, username, role FROM users WHERE id <> 1 UNION ALL SELECT 1, 'seed-admin', 'admin'")
def s20(spark, d):
    from marlow.operators.upsert import upsert

    seed = spark.createDataFrame([(1, "seed-admin", "admin")], "id long, username string, role string")
    return upsert(C.users(spark, d).select("id", "username", "role"), seed, ["id"])


@query("p01_problem_list", "P-01 K-01 K-03 S-01", """
WITH f AS (SELECT * FROM problems WHERE source_platform = 'luogu' AND difficulty BETWEEN 100 AND 3000 AND list_has_any(tags, ['tag_5', 'tag_15', 'tag_10']))
SELECT id, title, difficulty, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_at DESC NULLS LAST, id LIMIT 20 OFFSET 20""")
def p01(spark, d):
    return filters.problem_list(C.problems(spark, d), "luogu", 100, 3000, tags=["tag_5", "tag_15", "tag_10"], page=2).select("id", "title", "difficulty", "total")


@query("p02_title_search", "P-02", "SELECT id, title, CAST(0 AS DOUBLE) AS score FROM problems WHERE contains(title, 'the') ORDER BY created_at DESC, id LIMIT 20")
def p02(spark, d):
    return filters.title_search(C.problems(spark, d), "the").select("id", "title", "score")


@query("p03_user_list", "P-03 J-02", """SELECT id, username, role, nickname FROM users WHERE role = 'user' AND NOT deleted AND (contains(username, '7') OR contains(nickname, '7') OR contains(department, '7'))
AND id IN (SELECT user_id FROM records)""")
def p03(spark, d):
    return filters.user_list(C.live(C.users(spark, d)), "user", " 7 ", C.practice_records(spark, d)).select("id", "username", "role", "nickname")


@query("p04_point_lookup", "P-04", "SELECT id, username, role, nickname, department, rating, nation FROM users WHERE id = 5")
def p04(spark, d):
    return C.users(spark, d).where("id = 5").drop("password_hash", "deleted_at")


@query("p05_enabled_configs", "P-05", "SELECT id, department AS channel FROM users WHERE role = 'admin' AND NOT deleted")
def p05(spark, d):
    return C.live(C.users(spark, d)).where("role = 'admin'").select("id", F.col("department").alias("channel"))


@query("p06_date_ranges", "P-06", f"""SELECT 'yesterday' AS span, count(*) AS n FROM records WHERE stat_date = DATE '{AS_OF}' - 1
UNION ALL SELECT 'week', count(*) FROM records WHERE stat_date >= DATE '{AS_OF}' - 7""")
def p06(spark, d):
    r, day = C.practice_records(spark, d), F.lit(AS_OF).cast("date")
    one = lambda name, cond: r.where(cond).agg(F.lit(name).alias("span"), F.count("*").alias("n"))
    return one("yesterday", F.col("stat_date") == F.date_sub(day, 1)).union(one("week", F.col("stat_date") >= F.date_sub(day, 7)))


@query("p07_observed_users", "P-07", "SELECT id FROM users WHERE role = 'observed' AND NOT deleted")
def p07(spark, d):
    return C.live(C.users(spark, d)).where("role = 'observed'").select("id")


@query("p08_newer_than_profile", "P-08", """SELECT r.user_id, count(*) FILTER (submit_time > coalesce(generated_at, TIMESTAMP '1970-01-01')) AS fresh FROM records r
LEFT JOIN (SELECT user_id, TIMESTAMP '2024-01-15' AS generated_at FROM records WHERE user_id % 2 = 0 GROUP BY user_id) p ON r.user_id = p.user_id GROUP BY r.user_id""")
def p08(spark, d):
    r = C.practice_records(spark, d)
    profiles = r.where("user_id % 2 = 0").select("user_id").distinct().withColumn("generated_at", F.timestamp_seconds(F.lit(1705276800)))
    return filters.newer_than_profile(r, profiles)


@query("p09_missing_text", "P-09", "SELECT id FROM (SELECT id, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN '' ELSE lang END AS t FROM problems) WHERE t IS NULL OR t = ''")
def p09(spark, d):
    t = F.when(F.col("id") % 3 == 1, "").when(F.col("id") % 3 == 2, F.col("lang"))
    return C.problems(spark, d).withColumn("t", t).where(filters.blank(F.col("t"))).select("id")


@query("p10_incomplete_summary", "P-10", r"""SELECT id, n_chars FROM problems WHERE NOT (regexp_matches(content, 'the') AND regexp_matches(content, 'and') AND regexp_matches(content, 'of') AND regexp_matches(content, '[.!?]\s*$')) OR lang IS NULL""")
def p10(spark, d):
    c = F.col("content")
    whole = c.rlike("the") & c.rlike("and") & c.rlike("of") & c.rlike(r"[.!?]\s*\z")
    return C.problems(spark, d).where(~whole | F.col("lang").isNull()).select("id", "n_chars")


@query("p11_short_incomplete", "P-11", "SELECT id, CAST(length(content) AS INTEGER) AS len, left(content, 200) AS head FROM problems WHERE NOT contains(content, 'and') ORDER BY len, id LIMIT 30")
def p11(spark, d):
    return C.problems(spark, d).where(~F.col("content").contains("and")).select("id", F.length("content").alias("len"), F.left("content", F.lit(200)).alias("head")).orderBy("len", "id").limit(30)


@query("p12_pending", "P-12", "SELECT id, version FROM (SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 'v2' ELSE 'v1' END AS version FROM problems) WHERE version IS DISTINCT FROM 'v2' AND id > 100 ORDER BY id LIMIT 50")
def p12(spark, d):
    v = F.when(F.col("id") % 4 == 1, "v2").when(F.col("id") % 4 != 0, "v1")
    return filters.pending(C.problems(spark, d).select("id", v.alias("version")), "version", "v2", 100, 50)


@query("p13_blank_pairs", "P-13", r"SELECT id, pairs FROM (SELECT id, CAST((length(content) - length(replace(content, chr(10) || chr(10), ''))) // 2 AS BIGINT) AS pairs FROM (SELECT id, replace(content, '. ', chr(10) || chr(10)) AS content FROM problems)) WHERE pairs > 3")
def p13(spark, d):
    c = F.replace("content", F.lit(". "), F.lit("\n\n"))
    return C.problems(spark, d).select("id", filters.blank_pairs(c).cast("long").alias("pairs")).where("pairs > 3")


@query("p14_like_counts", "P-14", "SELECT count(*) FILTER (content LIKE '%!!%') AS before, count(*) FILTER (replace(content, '!!', '!') LIKE '%!!%') AS after FROM problems")
def p14(spark, d):
    return C.problems(spark, d).agg(F.count_if(F.col("content").like("%!!%")).alias("before"), F.count_if(F.replace("content", F.lit("!!"), F.lit("!")).like("%!!%")).alias("after"))


@query("p15_spam_characters", "P-15 J-02", "SELECT problem_id, solution_index FROM solutions WHERE contains(content, 'N') AND problem_id IN (SELECT id FROM problems WHERE source_platform = 'luogu')")
def p15(spark, d):
    of = C.problems(spark, d).where("source_platform = 'luogu'").select(F.col("id").alias("problem_id"))
    return C.solutions(spark, d).where(F.col("content").contains("N")).join(of, "problem_id", "left_semi").select("problem_id", "solution_index")


@query("p17_english_first", "P-17", "SELECT id, lang FROM problems ORDER BY (lang = 'en') DESC, id LIMIT 40")
def p17(spark, d):
    return filters.english_first(C.problems(spark, d), F.col("lang") == "en", "id", 40).select("id", "lang")


@query("p18_skip_known", "P-18 D-04", "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 5 = 0) AND left(url, 50) NOT IN (SELECT url FROM pages WHERE page_id % 5 = 0)")
def p18(spark, d):
    pages = C.read_table(spark, d, "pages").select("page_id", F.col("url").alias("id"))
    return filters.skip_known(pages, pages.where("page_id % 5 = 0")).select("page_id", F.col("id").alias("url"))


@query("p19_recommendation_filter", "P-19 P-20", "SELECT id, difficulty FROM problems WHERE difficulty < 500 AND len(list_filter(tags, lambda x: contains(lower(x), 'g_1'))) > 0 AND list_has_any(tags, string_split('tag_1,tag_12,tag_19', ','))")
def p19(spark, d):
    has = F.exists("tags", lambda t: F.lower(t).contains("g_1"))
    return C.problems(spark, d).where((F.col("difficulty") < 500) & has & F.arrays_overlap("tags", F.split(F.lit("tag_1,tag_12,tag_19"), ","))).select("id", "difficulty")


@query("p21_content_length", "P-21", "SELECT id FROM problems WHERE length(trim(content)) >= 50 AND NOT contains(content, 'MIT License')")
def p21(spark, d):
    return C.problems(spark, d).where((F.length(F.trim("content")) >= 50) & ~F.col("content").contains("MIT License")).select("id")


@query("p24_missing_sample", "P-24", "SELECT id FROM (SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE content END AS c FROM problems) WHERE c IS NULL OR c = '' OR NOT contains(c, 'License') ORDER BY id LIMIT 100")
def p24(spark, d):
    c = F.coalesce(F.when(F.col("id") % 3 != 0, F.col("content")), F.lit(""))
    return C.problems(spark, d).where(~c.contains("License")).select("id").orderBy("id").limit(100)


@query("p25_list_markers", "P-25", r"SELECT page_id FROM pages WHERE regexp_matches(html, '(?i)[a-z0-9]:- |[a-z];- |<li>')")
def p25(spark, d):
    return C.read_table(spark, d, "pages").where(F.col("html").rlike("(?i)[a-z0-9]:- |[a-z];- |<li>")).select("page_id")


@query("p26_section_markers", "P-26", "SELECT page_id, list_filter(['<nav>', '<article>', '<table>', '<pre>', '<script>'], lambda m: contains(html, m)) AS present, CAST(length(html) AS INTEGER) AS size FROM pages")
def p26(spark, d):
    marks = F.array(*map(F.lit, ["<nav>", "<article>", "<table>", "<pre>", "<script>"]))
    return C.read_table(spark, d, "pages").select("page_id", F.filter(marks, lambda m: F.contains(F.col("html"), m)).alias("present"), F.length("html").alias("size"))


@query("p30_editorial_choice", "P-30", """SELECT source, id FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY created_at DESC, id) AS rn, content FROM problems WHERE regexp_matches(title, '(?i)the|der|la ') QUALIFY rn <= 20)
WHERE contains(content, 'and') OR contains(content, 'und') QUALIFY row_number() OVER (PARTITION BY source ORDER BY rn) = 1""")
def p30(spark, d):
    w = Window.partitionBy("source").orderBy(F.col("created_at").desc(), "id")
    top = C.problems(spark, d).where(F.col("title").rlike("(?i)the|der|la ")).withColumn("rn", F.row_number().over(w)).where("rn <= 20")
    fits = top.where(F.col("content").contains("and") | F.col("content").contains("und"))
    return fits.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("rn"))).where("k = 1").select("source", "id")


# --- joins ---------------------------------------------------------------------------------------


@query("j01_include_many", "J-01 A-24", """SELECT id, (SELECT list(solution_index ORDER BY solution_index) FROM solutions s WHERE s.problem_id = p.id) AS solutions, (SELECT count(*) FROM solutions s WHERE s.problem_id = p.id) AS n FROM problems p""")
def j01(spark, d):
    return _with_solutions(C.problems(spark, d), C.solutions(spark, d))


def _with_solutions(problems, solutions):
    s = solutions.groupBy(F.col("problem_id").alias("id")).agg(F.sort_array(F.collect_list("solution_index")).alias("solutions"), F.count("*").alias("n"))
    return problems.join(s, "id", "left").select("id", "solutions", F.coalesce("n", F.lit(0)).alias("n"))


@query("j03_anti", "J-03", "SELECT id FROM problems p WHERE NOT EXISTS (SELECT 1 FROM solutions s WHERE s.problem_id = p.id AND votes > 10)")
def j03(spark, d):
    s = C.solutions(spark, d).where("votes > 10").select(F.col("problem_id").alias("id"))
    return C.problems(spark, d).join(s, "id", "left_anti").select("id")


@query("j04_null_aware_anti", "J-04", "SELECT count(*) AS n FROM problems WHERE id NOT IN (SELECT CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id END FROM labels)")
def j04(spark, d):
    keys = C.read_table(spark, d, "labels").select(F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")).alias("id"))
    return filters.not_in(C.problems(spark, d).select("id"), keys, "id").agg(F.count("*").alias("n"))


@query("j04b_not_in_keys", "J-04", "SELECT id FROM problems WHERE id NOT IN (SELECT doc_id FROM labels)")
def j04b(spark, d):
    return filters.not_in(C.problems(spark, d).select("id"), C.read_table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id")


@query("j05_cached_map", "J-05 J-15", "SELECT id, username, n_name, r_name FROM users LEFT JOIN nation ON nation = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j05(spark, d):
    n, r = C.read_table(spark, d, "nation"), C.read_table(spark, d, "region")
    # nation and region are fixed lists of 25 and 5 rows
    dim = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left")
    return C.users(spark, d).join(F.broadcast(dim), F.col("nation") == F.col("n_nationkey"), "left").select("id", "username", "n_name", "r_name")


@query("j06_hydration", "J-06", "SELECT k.id, coalesce(title, '') AS title, coalesce(tags, []) AS tags FROM (SELECT doc_id AS id FROM labels) k LEFT JOIN problems p ON k.id = p.id")
def j06(spark, d):
    keys = C.read_table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return keys.join(C.problems(spark, d), "id", "left").select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


@query("j07_fallback_resolution", "J-07", """SELECT s.l_orderkey AS k, s.l_linenumber AS line, coalesce(a.id, b.id, c.id) AS problem FROM lineitem s LEFT JOIN problems a ON a.id = s.l_orderkey
LEFT JOIN problems b ON b.id = s.l_suppkey LEFT JOIN problems c ON c.source_id = 'P' || (s.l_partkey % 1000)""")
def j07(spark, d):
    return _resolved(C.read_table(spark, d, "lineitem"), C.problems(spark, d))


def _resolved(li, problems):
    p = problems.select("id", "source_id")
    a, b, c = p.select(F.col("id").alias("ka"), F.col("id").alias("a")), p.select(F.col("id").alias("kb"), F.col("id").alias("b")), p.select("source_id", F.col("id").alias("c"))
    out = li.join(a, F.col("l_orderkey") == F.col("ka"), "left").join(b, F.col("l_suppkey") == F.col("kb"), "left")
    out = out.join(c, F.concat(F.lit("P"), (F.col("l_partkey") % 1000).cast("string")) == F.col("source_id"), "left")
    return out.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.coalesce("a", "b", "c").alias("problem"))


@query("j08_nickname", "J-08 W-01", """SELECT user_id, ac, name, row_number() OVER (ORDER BY ac DESC, user_id) AS place FROM (SELECT r.user_id, count(*) FILTER (verdict = 'OK') AS ac, coalesce(any_value(nickname), 'user_' || left(CAST(r.user_id AS VARCHAR), 8)) AS name
FROM records r LEFT JOIN users u ON r.user_id = u.id GROUP BY r.user_id) QUALIFY place <= 10""")
def j08(spark, d):
    ac = C.practice_records(spark, d).groupBy("user_id").agg(F.count_if(F.col("verdict") == "OK").alias("ac"))
    named = ac.join(C.users(spark, d).select(F.col("id").alias("user_id"), "nickname"), "user_id", "left")
    top = named.orderBy(F.col("ac").desc(), "user_id").limit(10)
    name = F.coalesce("nickname", F.concat(F.lit("user_"), F.left(F.col("user_id").cast("string"), F.lit(8))))
    return top.select("user_id", "ac", name.alias("name"), F.row_number().over(Window.orderBy(F.col("ac").desc(), "user_id")).cast("long").alias("place"))


@query("j13_unique_check", "J-13", "SELECT c_custkey AS id FROM customer WHERE (c_nationkey, c_mktsegment) IN (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 60 = 7) AND c_custkey % 60 <> 7")
def j13(spark, d):
    c = C.read_table(spark, d, "customer")
    return c.where("c_custkey % 60 <> 7").join(c.where("c_custkey % 60 = 7"), ["c_nationkey", "c_mktsegment"], "left_semi").select(F.col("c_custkey").alias("id"))


@query("j14_fill_from_list", "J-14", "SELECT p.id, coalesce(CASE WHEN p.id % 2 = 0 THEN p.lang END, l.source) AS v FROM problems p LEFT JOIN problems l ON p.id = l.id")
def j14(spark, d):
    p = C.problems(spark, d)
    return p.join(p.select("id", F.col("source").alias("listed")), "id", "left").select("id", F.coalesce(F.when(F.col("id") % 2 == 0, F.col("lang")), "listed").alias("v"))


@query("j16_preferred_match", "J-16", "SELECT source, coalesce(max(CASE WHEN lang = 'en' THEN title END), arg_min(title, id)) AS title FROM problems GROUP BY source")
def j16(spark, d):
    return C.problems(spark, d).groupBy("source").agg(F.coalesce(F.max(F.when(F.col("lang") == "en", F.col("title"))), F.min_by("title", "id")).alias("title"))


# --- aggregates ----------------------------------------------------------------------------------


@query("a01_user_stats", "A-01 A-02 A-05", """SELECT user_id, count(*) AS total, count(*) FILTER (verdict = 'OK') AS accepted, CAST(sum(CAST(difficulty AS DECIMAL(20, 6))) AS DOUBLE) / count(*) AS mean_difficulty, avg(CAST(first_ac AS INTEGER)) AS first_rate, avg(retries) AS mean_retries,
coalesce(any_value(n), 0) AS n_tags FROM records LEFT JOIN (SELECT user_id, count(DISTINCT tag) AS n FROM (SELECT user_id, unnest(tags) AS tag FROM records) GROUP BY user_id) USING (user_id) GROUP BY user_id""")
def a01(spark, d):
    from marlow.operators.reports import user_stats

    return user_stats(C.practice_records(spark, d))


@query("a03_histograms", "A-03", """SELECT 'tag' AS kind, key, count(*) AS n FROM (SELECT unnest(tags) AS key FROM problems) GROUP BY key UNION ALL SELECT 'platform', coalesce(source_platform, 'unknown'), count(*) FROM problems GROUP BY ALL
UNION ALL SELECT 'difficulty', CAST(CAST(difficulty AS BIGINT) // 500 AS VARCHAR), count(*) FROM problems GROUP BY ALL""")
def a03(spark, d):
    p = C.problems(spark, d)
    one = lambda kind, key: p.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
    tags = p.select(F.explode("tags").alias("key")).groupBy("key").agg(F.count("*").alias("n")).select(F.lit("tag").alias("kind"), "key", "n")
    return tags.union(one("platform", F.coalesce("source_platform", F.lit("unknown")))).union(one("difficulty", F.expr("cast(cast(difficulty as bigint) div 500 as string)")))


@query("a04_top_tags", "A-04", "SELECT user_id, tag, n FROM (SELECT user_id, tag, count(*) AS n FROM (SELECT user_id, unnest(tags) AS tag FROM records) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, tag) <= 5")
def a04(spark, d):
    n = C.practice_records(spark, d).select("user_id", F.explode("tags").alias("tag")).groupBy("user_id", "tag").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.col("n").desc(), "tag")
    return n.withColumn("k", F.row_number().over(w)).where("k <= 5").drop("k")


@query("a10_daily_report", "A-10", f"SELECT count(*) AS submits, count(*) FILTER (verdict = 'OK') AS accepted, CASE WHEN count(*) = 0 THEN '0%' ELSE printf('%.1f%%', 100.0 * count(*) FILTER (verdict = 'OK') / count(*)) END AS rate FROM records WHERE stat_date = DATE '{AS_OF}' - 1")
def a10(spark, d):
    from marlow.operators.reports import daily_report

    return daily_report(C.practice_records(spark, d), AS_OF)


@query("a11_weekly_report", "A-11 A-05", f"""SELECT CAST(sum(submit_count) AS BIGINT) AS submits, CAST(sum(ac_count) AS BIGINT) AS accepted, count(DISTINCT user_id) AS active_users FROM stats WHERE stat_date >= DATE '{AS_OF}' - 7""")
def a11(spark, d):
    from marlow.operators.reports import weekly_report

    return weekly_report(C.daily_stats(C.practice_records(spark, d)), AS_OF)


@query("a11b_weekly_top_rows", "A-11", f"SELECT user_id, platform, stat_date, ac_count FROM stats WHERE stat_date >= DATE '{AS_OF}' - 7 ORDER BY ac_count DESC, user_id, platform, stat_date LIMIT 5")
def a11b(spark, d):
    from marlow.operators.reports import weekly_top_rows

    return weekly_top_rows(C.daily_stats(C.practice_records(spark, d)), AS_OF)


@query("a11c_weekly_leaderboard", "A-11", f"SELECT user_id, CAST(sum(ac_count) AS BIGINT) AS ac FROM stats WHERE stat_date >= DATE '{AS_OF}' - 7 GROUP BY user_id ORDER BY ac DESC, user_id LIMIT 5")
def a11c(spark, d):
    from marlow.operators.reports import weekly_leaderboard

    return weekly_leaderboard(C.daily_stats(C.practice_records(spark, d)), AS_OF)


@query("a12_daily_rollup", "A-12", "SELECT user_id, platform, stat_date, submit_count, ac_count, wa_count, tle_count, other_count, new_problems_solved, round(hardest_difficulty, 6) AS hardest_difficulty, round(avg_difficulty, 6) AS avg_difficulty FROM stats")
def a12(spark, d):
    s = C.daily_stats(C.practice_records(spark, d))
    return s.select(*[F.round(c, 6).alias(c) if "difficulty" in c else c for c in s.columns]).withColumn("new_problems_solved", F.coalesce("new_problems_solved", F.lit(0)))


@query("a13_first_accept", "A-13", "SELECT user_id, problem_id, min(CASE WHEN verdict = 'OK' THEN k END) AS first_ok, count(*) AS attempts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, problem_id ORDER BY submit_time, id) AS k FROM records) GROUP BY user_id, problem_id")
def a13(spark, d):
    w = Window.partitionBy("user_id", "problem_id").orderBy("submit_time", "id")
    r = C.practice_records(spark, d).withColumn("k", F.row_number().over(w).cast("long"))
    return r.groupBy("user_id", "problem_id").agg(F.min(F.when(F.col("verdict") == "OK", F.col("k"))).alias("first_ok"), F.count("*").alias("attempts"))


@query("a14_having", "A-14", "SELECT problem_id, count(*) AS n FROM solutions s JOIN problems p ON s.problem_id = p.id GROUP BY problem_id HAVING count(*) > 1")
def a14(spark, d):
    p = C.problems(spark, d).select(F.col("id").alias("problem_id"))
    return C.solutions(spark, d).join(p, "problem_id").groupBy("problem_id").agg(F.count("*").alias("n")).where("n > 1")


@query("a15_md5_groups", "A-15 D-07", "SELECT problem_id, md5(content) AS digest, count(*) AS n FROM solutions WHERE problem_id IN (SELECT doc_id FROM documents) GROUP BY ALL HAVING count(*) > 1")
def a15(spark, d):
    from marlow.operators.dedup import exact_groups

    ids = C.read_table(spark, d, "documents").select(F.col("doc_id").alias("problem_id"))
    return exact_groups(C.solutions(spark, d).join(ids, "problem_id", "left_semi"), ["problem_id"], "content")


@query("a16_filtered_counts", "A-16 A-17", r"""SELECT source_platform, count(*) FILTER (regexp_matches(content, 'the')) AS a, count(*) FILTER (regexp_matches(content, '!!')) AS b, count(*) FILTER (regexp_matches(content, '\|')) AS c,
min(length(content)) AS shortest, max(length(content)) AS longest, round(avg(length(content)), 2) AS mean FROM problems GROUP BY source_platform""")
def a16(spark, d):
    c, n = F.col("content"), F.length("content").cast("long")
    return C.problems(spark, d).groupBy("source_platform").agg(F.count_if(c.rlike("the")).alias("a"), F.count_if(c.rlike("!!")).alias("b"), F.count_if(c.rlike(r"\|")).alias("c"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 2).alias("mean"))


@query("a18_exists_flags", "A-18", "SELECT source_platform, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM solutions s WHERE s.problem_id = p.id)) AS solved FROM problems p GROUP BY source_platform")
def a18(spark, d):
    have = C.solutions(spark, d).select(F.col("problem_id").alias("id")).distinct().withColumn("has", F.lit(True))
    return C.problems(spark, d).join(have, "id", "left").groupBy("source_platform").agg(F.count("*").alias("n"), F.count_if(F.col("has")).alias("solved"))


@query("a19_left_group_having", "A-19", "SELECT u.id, count(o_orderkey) AS orders, count(*) FILTER (o_orderstatus = 'F') AS done FROM users u LEFT JOIN orders o ON u.id = o_custkey GROUP BY u.id HAVING count(o_orderkey) > 5 ORDER BY orders DESC, u.id LIMIT 10")
def a19(spark, d):
    o = C.read_table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_orderstatus")
    g = C.users(spark, d).join(o, "id", "left").groupBy("id").agg(F.count("o_orderkey").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return g.where("orders > 5").orderBy(F.col("orders").desc(), "id").limit(10)


@query("a20_vector_coverage", "A-20", "SELECT source_platform, count(*) AS n, count(v.vec_id) AS vectors FROM problems p LEFT JOIN embeddings v ON p.id = v.vec_id GROUP BY source_platform")
def a20(spark, d):
    v = C.read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("v"))
    return C.problems(spark, d).join(v, "id", "left").groupBy("source_platform").agg(F.count("*").alias("n"), F.count("v").alias("vectors"))


@query("a21_status_matrix", "A-21 A-25", "SELECT o_orderpriority AS stage, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL ORDER BY stage, status")
def a21(spark, d):
    return C.read_table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).orderBy("stage", "status")


@query("a22_platform_counts", "A-22 A-23", "SELECT source_platform, count(*) AS n, max(coalesce(top, 0)) AS top FROM problems p JOIN (SELECT problem_id, max(solution_index) AS top FROM solutions GROUP BY problem_id) s ON p.id = s.problem_id GROUP BY source_platform")
def a22(spark, d):
    s = C.solutions(spark, d).groupBy(F.col("problem_id").alias("id")).agg(F.max("solution_index").alias("top"))
    return C.problems(spark, d).join(s, "id").groupBy("source_platform").agg(F.count("*").alias("n"), F.max(F.coalesce("top", F.lit(0))).alias("top"))


@query("a24_team_sizes", "A-24 U-07", "SELECT s_suppkey AS team, count(c_custkey) AS members, count(c_custkey) >= 3 AS is_full FROM supplier LEFT JOIN customer ON c_custkey % 100 = s_suppkey GROUP BY s_suppkey")
def a24(spark, d):
    return _team_sizes(C.read_table(spark, d, "supplier"), C.read_table(spark, d, "customer"))


def _team_sizes(supplier, customer):
    m = customer.groupBy((F.col("c_custkey") % 100).alias("team")).agg(F.count("*").alias("members"))
    g = supplier.select(F.col("s_suppkey").alias("team")).join(m, "team", "left").withColumn("members", F.coalesce("members", F.lit(0)))
    return g.withColumn("is_full", F.col("members") >= 3)


@query("a26_crawl_summary", "A-26 W-07", "SELECT user_id, count(*) FILTER (verdict = 'RE') AS errors, CAST(floor(epoch(max(submit_time))) - floor(epoch(min(submit_time))) AS BIGINT) AS seconds, max(submit_time) < TIMESTAMP '2024-01-29 23:30:00' AS stale FROM records GROUP BY user_id")
def a26(spark, d):
    from marlow.operators.reports import job_summary

    return job_summary(C.practice_records(spark, d), "2024-01-30 00:00:00")


@query("a27_regex_groups", "A-27", "SELECT regexp_extract(url, '/([0-9]+)', 1) AS contest, count(*) AS n, min(page_id) AS first, max(page_id) AS last, list(page_id ORDER BY page_id) AS pages FROM pages WHERE regexp_extract(url, '/([0-9]+)', 1) <> '' GROUP BY contest")
def a27(spark, d):
    from marlow.operators.reports import by_pattern

    return by_pattern(C.read_table(spark, d, "pages"), "url", "/([0-9]+)", "page_id").withColumnsRenamed({"key": "contest", "ids": "pages"})


@query("a28_heat_map", "A-28", """SELECT CAST(date_trunc('week', day) AS DATE) AS week, day, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 0 WHEN n * 4 <= m THEN 1 WHEN n * 4 <= 2 * m THEN 2 WHEN n * 4 <= 3 * m THEN 3 ELSE 4 END AS shade
FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 1 DAY)) AS DATE) AS day) LEFT JOIN (SELECT stat_date, count(*) AS n FROM records WHERE verdict = 'OK' GROUP BY stat_date) s ON s.stat_date = day
CROSS JOIN (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM records WHERE verdict = 'OK' GROUP BY stat_date))""")
def a28(spark, d):
    from marlow.operators.reports import heat_map

    return heat_map(C.practice_records(spark, d).where("verdict = 'OK'"), "2024-01-01", "2024-02-10")


@query("a29_share", "A-29 F-09", "SELECT CASE WHEN difficulty <= 999 THEN '入门' WHEN difficulty <= 1699 THEN '普及' WHEN difficulty <= 2399 THEN '提高' WHEN difficulty <= 3499 THEN '省选' ELSE 'NOI' END AS band, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM problems GROUP BY band")
def a29(spark, d):
    from marlow.functions.difficulty import elo_band

    g = C.problems(spark, d).groupBy(elo_band(F.col("difficulty")).alias("band")).agg(F.count("*").alias("n"))
    # at most five bands
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("a30_trend_tail", "A-30", "SELECT user_id, stat_date, n FROM (SELECT user_id, stat_date, count(*) AS n FROM records GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY stat_date DESC) <= 7")
def a30(spark, d):
    g = C.practice_records(spark, d).groupBy("user_id", "stat_date").agg(F.count("*").alias("n"))
    return g.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("stat_date").desc()))).where("k <= 7").drop("k")


@query("a31_streaks", "A-31 W-08", """SELECT user_id, max(n) AS longest, max(CASE WHEN last >= DATE '2024-01-29' THEN n ELSE 0 END) AS current_streak FROM (SELECT user_id, g, count(*) AS n, max(stat_date) AS last FROM
(SELECT user_id, stat_date, stat_date - CAST(row_number() OVER (PARTITION BY user_id ORDER BY stat_date) AS INTEGER) AS g FROM (SELECT DISTINCT user_id, stat_date FROM records WHERE verdict = 'OK')) GROUP BY user_id, g) GROUP BY user_id""")
def a31(spark, d):
    from marlow.operators.reports import streaks

    return streaks(C.practice_records(spark, d).where("verdict = 'OK'"), AS_OF)


@query("a31b_summary", "A-31", """SELECT user_id, round(count(*) FILTER (verdict = 'OK') / count(*), 6) AS acceptance, count(DISTINCT CASE WHEN verdict = 'OK' THEN problem_id END) AS solved, count(DISTINCT problem_id) AS attempted,
round(percent_rank() OVER (ORDER BY count(DISTINCT CASE WHEN verdict = 'OK' THEN problem_id END)), 6) AS percentile FROM records GROUP BY user_id""")
def a31b(spark, d):
    from marlow.operators.reports import summary

    return summary(C.practice_records(spark, d))


@query("a34_chunks", "A-34", "SELECT source, CAST((rn - 1) // 7 AS BIGINT) AS week, list(id ORDER BY rn) AS tasks FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY id) AS rn FROM problems) GROUP BY source, week")
def a34(spark, d):
    from marlow.operators.reports import chunks

    return chunks(C.problems(spark, d).select("source", "id"), "source", ["id"], 7).select("source", F.col("chunk").alias("week"), F.col("items.id").alias("tasks"))


@query("a35_round_summary", "A-35", "SELECT platform, count(*) FILTER (verdict = 'OK') AS fetched, count(*) FILTER (verdict = 'RE') AS errors, count(*) FILTER (verdict NOT IN ('OK', 'RE')) AS skipped FROM records GROUP BY platform")
def a35(spark, d):
    kind = F.when(F.col("verdict") == "OK", "fetched").when(F.col("verdict") == "RE", "errors").otherwise("skipped")
    return C.practice_records(spark, d).withColumn("kind", kind).groupBy("platform").pivot("kind", ["fetched", "errors", "skipped"]).agg(F.count(F.lit(1))).na.fill(0)


# --- windows, sorts, sets ------------------------------------------------------------------------


@query("w04_keep_newest_oldest", "W-04 D-05", """SELECT author AS a, max_by(problem_id, (created_at, problem_id, solution_index)) AS newest, min_by(problem_id, (created_at, problem_id, solution_index)) AS oldest FROM solutions GROUP BY author""")
def w04(spark, d):
    from marlow.operators.dedup import keep_one

    s = C.solutions(spark, d)
    order = ["created_at", "problem_id", "solution_index"]
    new = keep_one(s, ["author"], [F.col(c).desc() for c in order]).select(F.col("author").alias("a"), F.col("problem_id").alias("newest"))
    old = keep_one(s, ["author"], [F.col(c).asc() for c in order]).select(F.col("author").alias("a"), F.col("problem_id").alias("oldest"))
    return new.join(old, "a")


@query("w09_failure_runs", "W-09", """SELECT user_id, max(n) AS longest_failure FROM (SELECT user_id, g, count(*) FILTER (verdict <> 'OK') AS n FROM (SELECT user_id, verdict, sum(CASE WHEN verdict = 'OK' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY submit_time, id ROWS UNBOUNDED PRECEDING) AS g FROM records) GROUP BY user_id, g) GROUP BY user_id""")
def w09(spark, d):
    w = Window.partitionBy("user_id").orderBy("submit_time", "id").rowsBetween(Window.unboundedPreceding, 0)
    r = C.practice_records(spark, d).withColumn("g", F.sum((F.col("verdict") == "OK").cast("int")).over(w))
    return r.groupBy("user_id", "g").agg(F.count_if(F.col("verdict") != "OK").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest_failure"))


@query("k04_first_active", "K-04", "SELECT id, username FROM users WHERE NOT deleted AND role = 'observed' ORDER BY rating DESC NULLS LAST, id LIMIT 1")
def k04(spark, d):
    return C.live(C.users(spark, d)).where("role = 'observed'").orderBy(F.col("rating").desc_nulls_last(), "id").limit(1).select("id", "username")


@query("k07_sort_toggle", "K-07 K-08", "SELECT id, nickname FROM users ORDER BY nickname DESC NULLS LAST, id LIMIT 25")
def k07(spark, d):
    return C.users(spark, d).orderBy(F.col("nickname").desc_nulls_last(), "id").limit(25).select("id", "nickname")


@query("d01_tag_sets", "D-01 D-03", "SELECT id, len(list_intersect(tags, ['tag_1', 'tag_2', 'tag_7'])) AS both, len(list_distinct(list_concat(tags, ['tag_1', 'tag_2', 'tag_7']))) AS either FROM problems")
def d01(spark, d):
    other = F.array(*map(F.lit, ["tag_1", "tag_2", "tag_7"]))
    return C.problems(spark, d).select("id", F.size(F.array_intersect("tags", other)).cast("long").alias("both"), F.size(F.array_union("tags", other)).cast("long").alias("either"))


@query("d02_union_by_name", "D-02 S-25", "SELECT id, 'problem' AS kind, lang, NULL::DOUBLE AS votes FROM problems UNION ALL SELECT problem_id, 'solution', NULL, votes FROM solutions")
def d02(spark, d):
    p = C.problems(spark, d).select("id", F.lit("problem").alias("kind"), "lang")
    return p.unionByName(C.solutions(spark, d).select(F.col("problem_id").alias("id"), F.lit("solution").alias("kind"), "votes"), allowMissingColumns=True)


@query("d07_prefix_groups", "D-07", "SELECT left(content, 100) AS head, count(*) AS n, min(id) AS first_id FROM problems GROUP BY head HAVING count(*) > 1")
def d07(spark, d):
    from marlow.operators.dedup import prefix_groups

    return prefix_groups(C.problems(spark, d), "content", 100)
