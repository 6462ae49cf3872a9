"""Indexes, joins with bounds and what goes with them, against brute force."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from marlow.operators import filters, fulltext, matching, reports, training, vector_index
from marlow.sources.shared import kept

TEXTS = ["The cat, the CAT!", "de la mer de la", "la de", None, "", "un_der 42 the", "the " * 3000 + "end", "cat's", "été là-bas ÉTÉ", "mer the"]


def found_by_force(terms):
    out = {}
    for i, text in enumerate(TEXTS):
        w = [x.lower() for x in re.findall(r"\w+", text or "")]
        asked = [t for t in (re.findall(r"\w+", t.lower()) for t in terms) if t]
        tf = sum(sum(w[k:k + len(t)] == t for k in range(len(w))) for t in asked)
        if tf:
            out[i] = tf
    return out


def test_postings(spark, tmp_path):
    path = str(tmp_path / "postings")
    fulltext.write_index(spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string"), path, 16)
    index = fulltext.open_index(spark, path)
    for terms in (["the"], ["the", "cat"], ["de la"], ["'de la'", "the"], ["CAT'S"], ["été"], ["none"], ["la mer la"], ["the the"], ["", "'"], []):
        assert {r.id: r.tf for r in fulltext.matches(index, terms, 16).collect()} == found_by_force(terms), terms
    best = fulltext.search(index, ["the", "de la"], 3, 16).collect()
    score = {i: tf / (1 + math.log(len(TEXTS[i]))) for i, tf in found_by_force(["the", "de la"]).items()}
    assert [(r.id, round(r.score, 9)) for r in best] == [(i, round(score[i], 9)) for i in sorted(score, key=lambda i: (-score[i], i))[:3]]
    plan = fulltext.matches(index, ["mer"], 16)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_inverted_file(spark, tmp_path):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 8))
    v = np.concatenate([c + rng.normal(0, 0.15, (40, 8)) for c in centers])
    rows = [(i, [float(x) for x in r], i % 4) for i, r in enumerate(v)] + [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [float("nan")] * 8, 0), (1003, [1.0] * 8, 1), (1004, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    path = str(tmp_path / "ivf")
    vector_index.write_index(df, path)
    index = vector_index.VectorIndex.open(spark, path)
    assert index.vectors.count() == 482 and len(index.cells) == 22
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    exact = index.search_all(df.where("id % 50 = 0 and id < 1000").withColumnRenamed("id", "query_id"), 10, None)
    got = {}
    for r in exact.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    for q in range(0, 480, 50):
        s = np.append(unit @ unit[q], [unit[q].sum() / math.sqrt(8)] * 2)
        ids = np.append(np.arange(480), [1003, 1004])
        assert [i for _, i in sorted(got[q])] == ids[np.lexsort((ids, -s.round(12)))][:10].tolist()
    # one query: the same; a filter stands before the top-k; few probes find nearly all here, where vectors lie in clusters
    one = [r.id for r in index.search(v[50].tolist(), 10, None).collect()]
    assert one == [i for _, i in sorted(got[50])]
    some = [r.id for r in index.search(v[50].tolist(), 10, None, F.col("label") == 1).collect()]
    assert len(some) == 10 and all(i % 4 == 1 or i > 1000 for i in some)
    asked = df.where("id % 50 = 0 and id < 1000").withColumnRenamed("id", "query_id")
    assert vector_index.recall(index.search_all(asked, 10, 4), exact).first().recall >= 0.9
    assert vector_index.recall(exact, exact).first().recall == 1.0
    # other cells' files are not read
    plan = index.search(v[50].tolist(), 10, 2)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)
    vector_index.write_index(df.limit(0), str(tmp_path / "none"))
    none = vector_index.VectorIndex.open(spark, str(tmp_path / "none"))
    assert none.search([1.0] * 8).count() == 0 and none.search_all(asked).count() == 0


def test_index_is_kept_until_files_change(spark, tmp_path):
    table, built = str(tmp_path / "t"), []
    spark.range(5).write.parquet(table)
    build = lambda path: (built.append(path), spark.range(1).write.parquet(path))
    assert kept(spark, table, "x", build) == kept(spark, table, "x", build) and len(built) == 1
    spark.range(7).write.mode("append").parquet(table)
    assert kept(spark, table, "x", build) != built[0] and len(built) == 2


def test_pairs_with_bounds_equal_all_pairs(spark):
    rng = random.Random(8)
    style = ["grinder", "deep_diver", "specialist", "balanced", "Other", None]
    rows = [(i, rng.sample("abcdef", rng.randrange(4)), rng.sample("abcdef", rng.randrange(3)), 0.5 if i % 3 == 0 else rng.random() if i % 11 else None, rng.choice(style)) for i in range(400)]
    df = spark.createDataFrame(rows, "user_id long, strong array<string>, weak array<string>, score double, style string")
    asks = df.where("user_id % 40 = 0")
    pairs = asks.select("user_id").join(df.select(F.col("user_id").alias("other_id")), F.col("user_id") != F.col("other_id"))
    every = sorted((r.user_id, -r.total, r.other_id) for r in matching.pair_detail(df, pairs).collect())
    want = [x for i in range(0, 400, 40) for x in [e for e in every if e[0] == i][:10]]
    got = matching.pair_scores(asks, df, rows=30, levels=12)
    assert [(r.u_id, -r.pair, r.c_id) for r in got.orderBy("u_id", "rk").collect()] == want
    seen = matching.looked_at(asks, df, rows=30, levels=12).first()
    assert seen.pairs == 4000 and seen.looked_at < seen.pairs


def test_weeks_of_different_plans(spark):
    rng = random.Random(5)
    tags = [f"t{i}" for i in range(9)]
    rows = [(i, rng.sample(tags, rng.randrange(4)), rng.randrange(100) / 10, rng.choice([0.1, 0.2, 0.9, rng.random()])) for i in range(500)]
    c = spark.createDataFrame([*rows, (900, None, 5.0, 0.9)], "problem_id long, tags array<string>, difficulty double, score double")
    plans = [(u, rng.sample(tags, rng.randrange(3)), rng.sample(tags, rng.randrange(3)), rng.sample(tags, rng.randrange(2)), [rng.randrange(100) / 10 for _ in range(rng.choice([2, 4]))]) for u in range(12)]
    p = spark.createDataFrame(plans, "user_id long, primary array<string>, secondary array<string>, explore array<string>, curve array<double>")
    want = training.arrange(c.where("tags is not null").crossJoin(p.select("user_id")), p)
    got = training.arrange_all(c.where("tags is not null"), p).select(*want.columns)
    assert got.orderBy(*want.columns).collect() == want.orderBy(*want.columns).collect()
    plan = training.pools(c, p)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "WindowGroupLimit" in plan
    assert training.arrange_all(c.limit(0), p).count() == 0


def test_not_in(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    keys = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert [r.id for r in filters.not_in(df, keys(2, 9, 9), "id").collect()] == [1]
    assert filters.not_in(df, keys(9, None), "id").count() == 0
    assert filters.not_in(df, keys(), "id").count() == 3


def test_user_stats_count_records_once(spark):
    rows = [(1, "OK", 4.0, True, 1, ["a", "b", "c"]), (1, "WA", 6.0, False, 3, ["a"]), (2, "OK", 2.0, True, 0, []), (3, "WA", None, False, 2, None)]
    df = spark.createDataFrame(rows, "user_id long, verdict string, difficulty double, first_ac boolean, retries int, tags array<string>")
    got = {r.user_id: tuple(r)[1:] for r in reports.user_stats(df).collect()}
    assert got == {1: (2, 1, 5.0, 0.5, 2.0, 3), 2: (1, 1, 2.0, 1.0, 0.0, 0), 3: (1, 0, None, 0.0, 2.0, 0)}


def test_chunks(spark):
    rows = [("a", i) for i in range(50)] + [("b", 3), (None, 1), (None, 2)]
    random.Random(1).shuffle(rows)
    got = {(r.g, r.chunk): [x.id for x in r["items"]] for r in reports.chunks(spark.createDataFrame(rows, "g string, id long"), "g", ["id"], 7).collect()}
    want = {("a", i // 7): list(range(i, min(i + 7, 50))) for i in range(0, 50, 7)} | {("b", 0): [3], (None, 0): [1, 2]}
    assert got == want
