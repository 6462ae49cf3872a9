"""Snapshot log, upserts of problems and solutions, keyed state, paged source, units, tags, languages."""

import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from marlow.functions import identity, text
from marlow.operators import dedup, filters, snapshots, training, upsert
from marlow.sources import paged
from marlow.streaming import reviews


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "log")
    assert snapshots.commit(spark.range(1), root, 0) == 1
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark.range(5), root, 0)
    assert [r.id for r in snapshots.read(spark, root).collect()] == [0]
    failed = []

    def writer(name):
        try:
            for i in range(3):
                snapshots.update(spark, root, lambda df, i=i: df.unionByName(spark.createDataFrame([(name * 10 + i,)], "id long")), tries=30)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=writer, args=(n,)) for n in (1, 2, 3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and snapshots.version(spark, root) == 10
    assert sorted(r.id for r in snapshots.read(spark, root).collect()) == [0, 10, 11, 12, 20, 21, 22, 30, 31, 32]
    # each version is still there, and what lost a race is not
    assert snapshots.read(spark, root, 1).count() == 1 and snapshots.read(spark, root, 4).count() == 4
    assert len([n for n in os.listdir(root) if n.startswith("v-")]) == 10 and not [n for n in os.listdir(f"{root}/log") if n.startswith(".v")]


def test_restored_twins(spark):
    old = spark.createDataFrame(
        [(1, "luogu", "P1", "a", "v1", "2024-01-01"), (2, "luogu", "P2", "b", "v2", None), (3, "luogu", "P3", "c", "v3", None), (4, "atcoder", "P2", "d", "v4", None)],
        "id long, source_platform string, source_id string, title string, vector string, deleted string",
    ).select("id", "source_platform", "source_id", "title", "vector", F.col("deleted").cast("timestamp").alias("deleted_at"))
    new = spark.createDataFrame([("luogu", "P1", "new a", 1), ("luogu", " P2 ", "x", 2), ("luogu", "P2", "new b", 3), ("luogu", "x" * 60, "long", 4), ("luogu", " ", "none", 5), (None, "P9", "none", 6), ("luogu", None, "none", 7)], "source_platform string, source_id string, title string, seq long")
    got = {(r.source_platform, r.source_id): (r.id, r.title, r.vector, r.deleted_at) for r in upsert.upsert_problems(old, new, F.col("seq") + 100).collect()}
    assert got == {("luogu", "P1"): (101, "new a", None, None), ("luogu", "P2"): (2, "new b", "v2", None), ("luogu", "P3"): (3, "c", "v3", None), ("atcoder", "P2"): (4, "d", "v4", None), ("luogu", "x" * 50): (104, "long", None, None)}


def test_one_solution_for_two_judges(spark):
    problems = spark.createDataFrame([(1, "codeforces", "1A"), (2, "atcoder", "abc_a"), (3, "luogu", "P3"), (4, "codeforces", "4D")], "id long, source_platform string, source_id string").withColumn("deleted_at", F.when(F.col("id") == 4, F.current_timestamp()))
    old = spark.createDataFrame([(1, 7, "old", "x"), (1, 8, "old", "x"), (2, 5, "old", "x"), (3, 5, "old", "x"), (4, 1, "kept", "x")], "problem_id long, solution_index long, content string, author string")
    inc = [
        ("codeforces", "1A", "first", "u", 3, 1), ("codeforces", "1A", "second", None, None, 2), ("atcoder", "abc_a", "one", "", None, 3), ("atcoder", "abc_a", "two", "w", None, 4), ("luogu", "P3", "p", "u", 9, 5), ("luogu", "P3", "q", "u", 9, 6),
        ("luogu", "P3", "p", "again", None, 7), ("luogu", "P3", "", "u", None, 8), ("luogu", "P0", "no problem", "u", None, 9), ("codeforces", "4D", "gone", "u", 0, 10),
    ]
    df = spark.createDataFrame(inc, "source_platform string, source_id string, content string, author string, solution_index long, seq long")
    h = lambda c: sum(ord(x) * 31 ** (len(c) - 1 - i) for i, x in enumerate(c)) % 100_000  # noqa: E731  short ones don't overflow
    got = sorted(tuple(r) for r in upsert.upsert_solutions(old, problems, df).collect())
    assert got == sorted([(1, 0, "second", "匿名"), (2, h("two"), "two", "w"), (3, 5, "old", "x"), (3, h("p"), "p", "again"), (3, h("q"), "q", "u"), (4, 1, "kept", "x")])


def replay(qualities):
    ease, interval = 2.5, 1
    for q in qualities:
        ease, interval = (max(1.3, ease + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)), min(interval * 2, 1 << 30)) if q >= 3 else (max(1.3, ease - 0.15), 1)
    return round(ease, 9), min(interval, 365)


def test_long_histories_are_folded_in_runs(spark):
    rng = random.Random(3)
    said = {k: [rng.choice([0, 3, 4, 4, 5, 5]) for _ in range(n)] for k, n in ((1, 1), (2, 40), (3, 1500), (4, 256), (5, 257))} | {6: [5] * 700, 7: [1] * 300}
    rows = [(k, i, q) for k, qs in said.items() for i, q in enumerate(qs)]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (8, 0, None)], "key long, at long, quality int")
    got = {r.key: (round(r.ease, 9), r.interval) for r in training.review_states(df, "key", "at", "quality").collect()}
    assert got == {k: replay(qs) for k, qs in said.items()}


def test_stream_of_reviews_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    said = {k: [rng.choice([0, 2, 3, 4, 5]) for _ in range(rng.randrange(1, 30))] for k in range(12)}
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    reviews.with_state_store(spark)

    def arrive(low, high):
        rows = [(k, i, q) for k, qs in said.items() for i, q in enumerate(qs) if low <= i < high]
        rng.shuffle(rows)
        spark.createDataFrame(rows, "key long, at long, quality int").coalesce(1).write.mode("append").parquet(source)
        # each call is a new query that goes on from the checkpoint
        stream = reviews.review_stream(spark.readStream.schema("key long, at long, quality int").parquet(source))
        q = stream.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).start()
        q.awaitTermination(120)
        assert q.exception() is None

    try:
        for low, high in ((0, 8), (8, 9), (9, 30)):
            arrive(low, high)
        arrive(0, 2)  # what has come before changes nothing
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old) if old else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.key: r.r for r in spark.read.parquet(out).groupBy("key").agg(F.max_by(F.struct("ease", "interval", "late"), "batch").alias("r")).collect()}
    assert {k: (round(r.ease, 9), r.interval) for k, r in got.items()} == {k: replay(qs) for k, qs in said.items()}
    assert all(r.late == min(2, len(said[k])) for k, r in got.items())


def test_pages(spark, tmp_path):
    root = str(tmp_path / "pages")
    rows = [("luogu" if u % 2 else "atcoder", u, u * 1000 + i, "OK", "FAILED" if (u, i) == (3, 149) else "OK", "why") for u in range(6) for i in range(150)]
    paged.land_pages(spark.createDataFrame(rows, "platform string, uid long, id long, verdict string, status string, comment string"), root)
    with open(f"{root}/platform=luogu/page=2/extra.txt", "w") as f:
        f.write("no json\n[1]\n" + json.dumps({"uid": 9, "status": "OK", "result": "none"}) + "\n" + json.dumps({"uid": 9, "status": "OK", "result": [{"id": k} for k in range(30)]}) + "\n")
    df = paged.read_pages(spark, root)
    good = df.where("ok and uid < 6").collect()
    # five pages of twenty, the newest first; the first page of user 3 has failed
    assert {(r.uid, r.id) for r in good} == {(u, u * 1000 + i) for u in range(6) for i in range(50, 150) if not (u == 3 and i >= 130)}
    bad = [(r.platform, r.page, r.uid, r.comment) for r in df.where("not ok").collect()]
    assert sorted(bad, key=str) == sorted([("luogu", 1, 3, "why"), ("luogu", 2, None, "no envelope"), ("luogu", 2, None, "no envelope"), ("luogu", 2, 9, None)], key=str)
    assert df.where("uid = 9 and ok").count() == 20 and paged.read_pages(spark, root, pages=1, rows=3).where("ok").count() == 15
    files = lambda d: d.rdd.getNumPartitions()
    assert files(df) > files(df.where("page <= 2 and platform = 'luogu'")) >= 3 and files(df.where("page = 77")) == 1
    assert df.where("page = 77").count() == 0 and df.where("page in (1, 3) and platform = 'atcoder'").select("page").distinct().count() == 2
    with pytest.raises(Exception, match="mounted"):
        paged.read_pages(spark, "hdfs://there/pages").count()


def test_utf16_units(spark):
    texts = ["", "a", "abc", "\U0001f600b", "a\U0001f600", "ab\U0001f600c", "x" * 300, "\U0001f600" * 150, "a" + "\U0001f600" * 150, "é日本" * 100]
    cut = lambda t, n: t.encode("utf-16-be")[:2 * n].decode("utf-16-be", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def fingerprint(t):
        b, h = t.encode("utf-16-be")[:400], 0
        for i in range(0, len(b), 2):
            h = (h * 31 + b[i] * 256 + b[i + 1]) % 2**32
        return abs(h - 2**32 if h >= 2**31 else h) % 100_000

    df = spark.createDataFrame([*enumerate(texts), (99, None)], "id int, t string")
    widths = (1, 2, 3, 4, 200)
    for r in df.select("id", "t", dedup.rolling_hash(F.col("t")).alias("h"), *(text.utf16_left(F.col("t"), n).alias(f"c{n}") for n in widths)).collect():
        if r.t is None:
            assert r.h is None and r.c4 is None
        else:
            assert r.h == fingerprint(r.t) and [r[f"c{n}"] for n in widths] == [cut(r.t, n) for n in widths]


def test_tags_of_two_forms(spark):
    cases = {
        '["a", {"name": "动态规划", "slug": "x"}, {"slug": "s t"}, {"name": "", "slug": ""}, {"id": 1}, 5, null, true]': ["a", "动态规划", "s t", "[object Object]", "[object Object]", "5", "null", "true"],
        "[]": [], '{"name": "a"}': [], "[broken": [], "": [], '"text"': [], None: [],
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, c string").select("id", identity.raw_tags(F.col("c")).alias("t"))
    assert [r.t for r in df.orderBy("id").collect()] == list(cases.values())
    slugs = spark.createDataFrame([("动态规划",), ("Two Words",), ("x",)], "t string").select(identity.english_slug(F.col("t")).alias("s"))
    assert [r.s for r in slugs.collect()] == ["dynamic-programming", "two-words", "x"]


def test_statement_language(spark):
    page = lambda s: f'<html><title>x</title><div id="task-statement">{s}</div>'
    ja, en = '<span class="lang-ja">問題文です</span>', '<span class="lang-en">'
    cases = [
        ("abc1", page("<h3>Problem Statement</h3><p>Add two numbers.</p>"), None), ("abc2", page("<h3> <b>問題文</b></h3>"), "headings"), ("dp_a", page("<h3>問題文</h3>"), None), ("tdpc_a", page(ja), None), ("abc3", page(ja), "no english"),
        ("abc4", page(ja + en + "Too short</span>"), "short english"), ("abc5", page(ja + en + "Long enough to be an English statement</span>"), None), ("abc6", page(en + "Short</span>"), None), ("abc7", page("<p>整数</p>" + "plain words " * 20), "text"),
        ("abc8", page("<h3>Input</h3> 整数 " + "plain words " * 20), None), ("abc9", page("Input 整数が与えられる"), "text"), ("abc10", "<html>no statement 問題文</html>", None), ("abc11", None, None),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "i string, h string").select("i", filters.statement_language(F.col("i"), F.col("h")).alias("why"))
    assert {r.i: r.why for r in df.collect()} == {a: c for a, _, c in cases}
