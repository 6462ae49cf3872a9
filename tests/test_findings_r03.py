"""What the findings of round 3 named, on small inputs."""

import random
import re
import zlib

from oracle import assert_equal, duck

from marlow.operators import fulltext, matching, training
from marlow.plans.all_queries import REGISTER
from marlow.sources import catalog


def test_reviews_add_in_the_order_of_the_loop(spark):
    """the last digits of an ease are those of the steps taken one by one."""
    rng = random.Random(5)
    said = {k: [rng.randrange(6) for _ in range(n)] for k, n in enumerate([1, 8, 40, 255, 256, 257, 700] * 4)}
    want = {}
    for k, qs in said.items():
        ease = 2.5
        for q in qs:
            ease = max(1.3, ease + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)) if q >= 3 else max(1.3, ease - 0.15)
        want[k] = ease
    rows = [(k, i, q) for k, qs in said.items() for i, q in enumerate(qs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key long, at long, quality int")
    assert {r.key: r.ease for r in training.review_states(df, "key", "at", "quality").collect()} == want


def test_review_schedule_of_odd_rows(spark, tmp_path):
    """halves as the SQL rounds them; turns without text, conversation or number."""
    rng = random.Random(6)
    rows = [(c, t, "user", "x" * rng.randrange(12)) for c in range(300) for t in range(8)]
    rows += [(1000, 0, "user", None), (1000, 1, "user", "abcde"), (1001, None, "user", "abcde"), (1001, 3, "user", "abc"), (None, 0, "user", "abcde"), (None, 1, "user", None), (1002, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    q = REGISTER["w10_review_schedule"]
    con = duck("/root/testdata/sf0.001")
    con.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert_equal(q.run(spark, str(tmp_path)), q.sql, con)


def test_groups_hold_all_their_pages(spark, tmp_path):
    """every page is in the list of its contest, not only the first and the last."""
    rows = [(i, u, "") for i, u in enumerate(["h://a/7/x", "h://a/7", "h://b/8", None, "h://a", "h://c/7?x", "h://a/07", "h://a/12345678901/2"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.contest: r.pages for r in REGISTER["a27_regex_groups"].run(spark, str(tmp_path)).collect()}
    assert got == {"7": [0, 1, 5], "8": [2], "07": [6], "12345678901": [7]}


def test_postings_are_made_where_texts_are(spark):
    """no word is sent to be put in order; more texts than are taken at a time."""
    texts = [None, "", "a b a", "ä_1 ß-A", "the " * 500] + [f"w{i % 7} w{i % 3} W{i % 7}" for i in range(2500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    found = fulltext.postings(df, 5)
    assert "Exchange" not in found._jdf.queryExecution().toString()
    want = []
    for i, t in enumerate(texts):
        at = {}
        for k, w in enumerate(re.findall(r"\w+", (t or "").lower())):
            at.setdefault(w, []).append(k)
        want += [(zlib.crc32(w.encode()) % 5, w, i, len(t), p) for w, p in at.items()]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert fulltext.postings(df.where("id < 2"), 5).count() == 0 and fulltext.postings(df.limit(0), 5).count() == 0


SF = "/root/testdata/sf0.001"


def test_no_window_over_all_candidates(spark):
    """candidates are counted by tag and score, not ranked in one task a tag."""
    rows = [(i, ["a"] if i % 3 else ["a", "b"], i % 7 / 1.0, 0.5 if i % 2 else i % 5 / 10) for i in range(400)]
    c = spark.createDataFrame(rows, "problem_id long, tags array<string>, difficulty double, score double")
    p = spark.createDataFrame([(1, ["a"], ["b"], [], [2.0, 5.0]), (2, ["b"], [], ["a"], [3.0])], "user_id long, primary array<string>, secondary array<string>, explore array<string>, curve array<double>")
    assert " rank(" not in training.pools(c, p)._jdf.queryExecution().optimizedPlan().toString()
    want = training.arrange(c.crossJoin(p.select("user_id")), p)
    assert sorted(map(tuple, training.arrange_all(c, p).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_submission_pages_are_dealt_to_all_cores(spark):
    """a small file is one task, however many rows it has."""
    out = REGISTER["s16_submission_table"].run(spark, SF)
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert catalog.spread_rows(spark.range(1000), 10).rdd.getNumPartitions() == 100


def test_raw_detail_is_read_once(spark):
    """the JSON of a problem is parsed once, not for each place where a part of it stands."""
    plan = REGISTER["t18_rebuilt_content"].run(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_few_pairs_are_scored(spark):
    """F6, F8, F10: the bound of a cell knows its skills, so that few of the pairs are scored, and the best are all found."""
    rng = random.Random(8)
    cats = [f"c{i}" for i in range(5)]
    rows = [(i, rng.sample(cats, 2), rng.sample(cats, 2), rng.choice([None, float("nan")]) if i % 50 == 7 else rng.randrange(60) / 60, rng.choice(["grinder", "balanced", "else", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "user_id long, strong array<string>, weak array<string>, score double, style string")
    asks = df.where("user_id % 50 in (0, 7)")
    u, c = asks.toPandas(), df.toPandas()
    pair = matching.block_scores(u, c)
    want = {}
    for i, me in enumerate(u.user_id):
        pair[i, c.user_id == me] = -1
        want[me] = [int(x) for x in c.user_id.to_numpy()[sorted(range(len(c)), key=lambda j: (-pair[i, j], c.user_id[j]))[:10]]]
    for rows_ in (1000, 1):
        got = {}
        for r in sorted(matching.best_pairs(asks, df, rows=rows_).collect(), key=lambda r: r.rk):
            got.setdefault(r.u_id, []).append(r.c_id)
        assert got == want
    # 409,431 of 4,500,000; before, 2,532,597
    seen = REGISTER["r15b_pairs_looked_at"].run(spark, "/root/testdata/sf0.1").first()
    assert seen.pairs == 4_500_000 and seen.looked_at < seen.pairs / 4
