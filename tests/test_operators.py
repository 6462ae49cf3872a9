"""Operators over small frames: upserts, inserts, plans, providers, sources, streaming."""

import json
import time

import pytest
from pyspark.sql import functions as F

from marlow.functions import scores
from marlow.operators import providers, retrieval, training, upsert
from marlow.sources import catalog, landing, shared
from marlow.streaming import practice


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (3, "D")], "k int, v string")
    once = upsert.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, upsert.upsert(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect()))


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "k int")
    upsert.commit_snapshot(df, str(tmp_path))
    upsert.commit_snapshot(df.union(df), str(tmp_path))
    assert upsert.read_snapshot(spark, str(tmp_path)).count() == 2


def test_conditional_insert(spark):
    members = spark.createDataFrame([(1, 10), (1, 11)], "team int, user int")
    wanted = spark.createDataFrame([(1, 10, 1), (1, 12, 2), (1, 13, 3), (2, 14, 4), (2, 14, 5)], "team int, user int, seq int")
    yes, no = upsert.conditional_insert(members, wanted)
    assert sorted(map(tuple, yes.collect())) == [(1, 12), (2, 14)]
    assert sorted(map(tuple, no.collect())) == [(1, 10, "duplicate"), (1, 13, "full"), (2, 14, "duplicate")]


def test_fusion(spark):
    hits = lambda *rows: spark.createDataFrame(list(rows), "id int, score double")
    got = {r.id: r for r in retrieval.fuse({"content": hits((1, 0.9), (2, 0.5)), "keyword": hits((2, 3.0))}, retrieval.WEIGHTS["problem_semantic"]).collect()}
    assert got[1].rough_score == pytest.approx(0.6) and got[1].sources == ["content"]
    assert got[2].content_score == 0 and got[2].keyword_score == 1 and got[2].sources == ["content", "keyword"]
    flat = retrieval.rerank(retrieval.fuse({"content": hits((1, 0.9), (2, 0.5))}, retrieval.WEIGHTS["problem_semantic"]), lambda c: c.select("id", F.lit(0.3).alias("rerank_score")))
    assert all(r.final_score == r.rough_score for r in flat.collect())


def test_week_plan_has_no_repeats(spark):
    c = spark.createDataFrame([(1, i, ["a" if i % 2 else "b"], float(i % 10), i / 100) for i in range(60)], "user_id long, problem_id long, tags array<string>, difficulty double, score double")
    p = spark.createDataFrame([(1, ["a"], ["b"], [], [2.0, 3.0, 4.0])], "user_id long, primary array<string>, secondary array<string>, explore array<string>, curve array<double>")
    rows = training.arrange(c, p).collect()
    assert len({r.problem_id for r in rows}) == len(rows) == 15
    first = [r.problem_id for r in rows if r.day == 1 and r.slot == "primary"]
    assert sorted(first) == [57, 59]


def test_providers(spark):
    df = spark.createDataFrame([("a b c",), (None,), ("",)], "t string")
    got = df.select(providers.column(providers.hashed_words(8), "array<double>")(F.col("t")).alias("v")).collect()
    assert sum(x * x for x in got[0].v) == pytest.approx(1) and got[1].v == [0.0] * 8
    safe = providers.column(providers.safe(lambda t: str(1 / len(t))), "struct<value:string,error:string>")
    assert df.select(safe(F.col("t")).alias("s")).collect()[2].s.error
    with pytest.raises(Exception, match="entries"):
        providers.check_dimension(spark.createDataFrame([([1.0],)], "v array<double>"), "v", 2).collect()


def test_json_landing(spark, tmp_path):
    folder = tmp_path / "luogu" / "problems"
    folder.mkdir(parents=True)
    (folder / "2026-06-14_P1.json").write_text(json.dumps({"pid": "P1", "title": "x"}))
    (folder / "2026-06-15_P2.json").write_text(json.dumps([{"pid": "P2"}, {"pid": "P3"}]))
    (folder / "bulk_list_1.json").write_text("[]")
    (folder / "2026-06-15_bad.json").write_text("{oops")
    df = landing.read_json_files(spark, str(folder), "pid string, title string")
    assert sorted((r.pid, r.file_key) for r in df.collect()) == [("P1", "P1"), ("P2", "P2"), ("P3", "P2")]
    assert landing.read_json_files(spark, str(folder), "pid string", "2026-06-14").count() == 1
    kinds = landing.read_kinds(spark, str(tmp_path), "luogu", "pid string")
    assert {r.kind for r in kinds.collect()} == {"problems"}
    done = spark.createDataFrame([("2026-06-14_P1.json",)], "file_name string")
    assert landing.unprocessed(df, done).count() == 2


def test_adapters(spark):
    raw = spark.createDataFrame([('{"status": "OK", "result": [{"id": 1}, {"id": 2}]}',), ('{"status": "FAILED"}',)], "value string")
    assert [r.id for r in landing.codeforces_envelope(raw, "id: int").collect()] == [1, 2]
    page = spark.createDataFrame([('<script id="lentille-context" type="x">{"a": 5}</script>',)], "html string")
    assert landing.luogu_island(page, "a int").first().island.a == 5
    now = spark.createDataFrame([("<script>window.__INITIAL_STATE__={\"a\": 6};</script>",)], "html string")
    assert landing.nowcoder_island(now, "a int").first().island.a == 6
    common = landing.as_common(spark.createDataFrame([("t", "1")], "name string, pid string"), "luogu", {"title": "name", "source_id": "pid"})
    assert common.first().title == "t" and common.columns == list(landing.COMMON)


def test_html_tables(spark):
    spark.udtf.register("html_rows", landing.HtmlTableRows)
    subs = "<table><tr><th>id</th></tr><tr><td>7</td><td>P1</td><td>AC</td><td>C++</td><td>now</td></tr></table>"
    rows = spark.sql(f"SELECT * FROM html_rows('{subs}')")
    assert landing.submission_table(rows).first().submission_id == 7
    page = '<table><tr><th>题目</th><th>难度</th><th>标签</th></tr><tr><td><a href="/acm/problem/12">A</a></td><td>3</td><td>dp，graph</td></tr><tr><td><a href="/acm/problem/12">A</a></td><td>3</td><td>x</td></tr></table>'
    got = landing.problem_table(spark.sql(f"SELECT * FROM html_rows('{page}')")).collect()
    assert [(r.id, r.difficulty, r.tags) for r in got] == [("12", "3", ["dp", "graph"])]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("luogu", "2026-06-14", 1)], "platform string, date string, x int")
    landing.write_enriched(df, str(tmp_path / "e"))
    assert landing.read_problems(spark, str(tmp_path / "e"), "luogu", "2026-06-14", "x int").count() == 1
    landing.append_failures(df, str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).count() == 1
    landing.to_sink(df, print)
    assert landing.first_filled_source(df.where("false"), df).count() == 1


def test_streaming(spark, tmp_path):
    rows = [(i, 1 + i % 2, "luogu", f"2024-01-0{1 + i // 4} 10:0{i % 10}:00", "OK") for i in range(8)]
    df = spark.createDataFrame(rows, "id long, user_id long, platform string, t string, verdict string").withColumn("submit_time", F.col("t").cast("timestamp"))
    df.union(df).write.parquet(str(tmp_path / "in"))
    stream = practice.read_events(spark, str(tmp_path / "in"), df.schema, 100)
    for f, name, n in ((practice.distinct_submissions, "s_distinct", 8), (practice.daily_rollup, "s_daily", None), (practice.sessions, "s_sessions", None)):
        q = f(stream).writeStream.outputMode("append").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        if n:
            assert spark.table(name).count() == n


def test_live_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "2024-01-01")], "id int, deleted_at string")
    assert catalog.live(df).count() == 1 and catalog.live(df, include_deleted=True).count() == 2


def test_scratch_folder_must_be_shared_on_a_cluster(spark):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda name, default: default)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "applicationId": "x"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)
    assert shared.shared_dir(spark)


def test_snapshots_replace_each_other(spark, tmp_path):
    root = str(tmp_path / "table")
    for n in (3, 5, 7):
        upsert.commit_snapshot(spark.range(n), root)
        assert upsert.read_snapshot(spark, root).count() == n
    assert [f.name for f in (tmp_path / "table").iterdir() if f.name.startswith("CURRENT")] == ["CURRENT"]


def test_paths_that_fail_or_are_late_are_left_out(spark):
    hits = lambda: spark.createDataFrame([(1, 0.5)], "id long, score double")

    def late():
        time.sleep(4)
        return hits()

    def broken():
        return hits().select(F.raise_error(F.lit("gone")).alias("id"))

    began = time.monotonic()
    got = retrieval.answered({"content": hits, "solution": late, "keyword": broken}, seconds=3)
    assert set(got) == {"content"} and got["content"].first().score == 0.5 and time.monotonic() - began < 4
    fused = retrieval.fuse(got, retrieval.WEIGHTS["problem_semantic"]).first()
    assert (fused.content_score, fused.solution_score, fused.keyword_score, fused.sources) == (1.0, 0.0, 0.0, ["content"])


def test_cosine_to_equals_cosine(spark):
    rows = [([1.0, 2.0, 2.0],), ([0.0, 0.0, 0.0],), ([1.0],), (None,), ([-1.0, 0.5, 3.0],)]
    df = spark.createDataFrame(rows, "v array<float>")
    for q in ([0.5, -1.0, 2.0], [0.0, 0.0, 0.0]):
        a, b = scores.cosine(F.col("v"), F.array(*map(F.lit, q))), scores.cosine_to(F.col("v"), q)
        assert all(abs(r.a - r.b) < 1e-12 for r in df.select(a.alias("a"), b.alias("b")).collect())


def test_every_attempt_is_logged(spark):
    def send(row):
        if row["id"] == 2:
            raise TimeoutError("late")

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, text string")
    assert sorted(tuple(r) for r in landing.send_and_log(df, send, "id").collect()) == [(1, True, None), (2, False, "late"), (3, True, None)]


def test_accounts_and_settings(spark):
    a = spark.createDataFrame([(1, "luogu", "x", "x")], "user long, platform string, uid string, name string")
    users = spark.createDataFrame([(1,), (2,)], "user long")
    asked = spark.createDataFrame([(2, "luogu", "x", None, 1), (9, "luogu", "y", None, 2), (2, "luogu", "y", None, 3), (1, "luogu", "y", None, 4)], "user long, platform string, uid string, name string, seq int")
    bound, rejected = upsert.bind_accounts(a, users, asked)
    assert sorted(tuple(r) for r in bound.collect()) == [(1, "luogu", "x", "x"), (2, "luogu", "y", "y")]
    assert sorted((r.user, r.uid, r.reason) for r in rejected.collect()) == [(1, "y", "bound"), (2, "x", "bound"), (9, "y", "no user")]
    s = spark.createDataFrame([(1, "qq", "old", True)], "user long, channel string, url string, enabled boolean")
    new = spark.createDataFrame([(1, "qq", None, False), (2, "qq", "u", None)], s.schema)
    assert sorted(tuple(r) for r in upsert.upsert_settings(s, new, ["user", "channel"]).collect()) == [(1, "qq", "old", False), (2, "qq", "u", None)]
    records = spark.createDataFrame([("7", 1, 5), (None, 1, 5), ("", 2, 6), (None, None, 5)], "id string, uid long, timestamp long")
    assert sorted(r.submission_id for r in upsert.with_submission_id(records).collect()) == ["1_5", "2_6", "7"]
