"""Mined URL rules of any length, and how they are matched, against brute force."""

import random
from itertools import combinations

from marlow.llm import urlfilter


def smallest(rows, need=12, confidence=0.5, lift=1.2, errors=3.0):
    """All sets of tokens that hold, the smallest of them; of sets on the same pages, those of least tokens stand for all."""
    lists = [(frozenset(urlfilter.url_tokens(u)), bad) for u, bad in rows]
    base = sum(bad for _, bad in rows) / len(rows)
    on = {}
    for t in sorted({t for items, _ in lists for t in items}):
        on.setdefault(tuple(t in items for items, _ in lists), t)
    lists = [(items & set(on.values()), bad) for items, bad in lists]
    out = {}
    sets = sorted({frozenset(c) for items, bad in set(lists) if bad for n in range(1, len(items) + 1) for c in combinations(sorted(items), n)}, key=len)
    for s in sets:
        hits = [bad for items, bad in lists if s <= items]
        sure = sum(hits) / len(hits)
        holds = sum(hits) >= need and sure >= confidence and sure - errors * (sure * (1 - sure) / len(hits)) ** 0.5 >= lift * base
        if holds and not any(r <= s for r in out):
            out[s] = sure
    return out


def test_four_tokens_together(spark):
    rows = [("http://h/a/b/c/d", True)] * 40 + [(f"http://h/{'/'.join(t)}", False) for t in combinations("abcd", 3) for _ in range(60)]
    got = urlfilter.mine(spark.createDataFrame(rows, "url string, bad boolean"))
    assert got == [(frozenset({"p=a", "p=b", "p=c", "p=d"}), 1.0)]


def test_smallest_rules(spark):
    r = random.Random(5)
    rows = []
    for _ in range(500):
        parts = [x for x in "abcdef" if r.random() < 0.6]
        rows.append((f"http://h{r.randrange(3)}/{'/'.join(parts)}", len({"a", "b", "c", "d"} & set(parts)) == 4 and "e" not in parts or r.random() < 0.25))
    got = urlfilter.mine(spark.createDataFrame(rows, "url string, bad boolean"))
    assert {k: round(v, 9) for k, v in got} == {k: round(v, 9) for k, v in smallest(rows).items()} and len(got) == len(dict(got))
    assert max(len(s) for s, _ in got) >= 4


def test_chance_patterns_do_not_block(spark):
    r = random.Random(6)
    rows = [(f"http://h{r.randrange(20)}.com/{r.choice('abc')}/{i}", r.random() < 0.25) for i in range(1500)]
    assert urlfilter.mine(spark.createDataFrame(rows, "url string, bad boolean")) == []


def test_index_finds_all_rules_that_fit():
    r = random.Random(7)
    tokens = [f"t{i}" for i in range(12)]
    sets = [frozenset(r.sample(tokens, r.randrange(1, 5))) for _ in range(60)]
    index = urlfilter.inverted_index([(s, 0.5) for s in sets])
    for _ in range(200):
        has = set(r.sample(tokens, r.randrange(0, 9)))
        assert sorted(urlfilter.fitting(has, sets, index)) == [k for k, s in enumerate(sets) if s <= has]


def test_judged_by_mined_rules(spark):
    rows = [(f"http://{'casino' if i % 5 == 0 else 'h' + str(i % 7)}.com/{i}", i % 5 == 0) for i in range(500)]
    rules = urlfilter.mine(spark.createDataFrame(rows, "url string, bad boolean"))
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)] * 2 + [(900, "http://casino.com/" + "x" * 200_000), (None, None)], "page_id long, url string")
    got = urlfilter.judge(pages, rules).collect()
    assert len(got) == 1002 and all((x.verdict == "block") == (x.page_id == 900 or x.page_id is not None and rows[x.page_id][1]) for x in got)
    assert urlfilter.judge(pages.where("false"), rules).count() == 0


def test_longest_rule_wins_and_ties(spark):
    rules = (("a.net", "/x/", "block"), ("net", "/xxx/", "allow"), ("b.a.net", "/", "allow"), ("org", "/", "block"))
    df = spark.createDataFrame([("a.net", "/x/1"), ("c.net", "/xxx/"), ("b.a.net", "/x/"), ("z.org", "/"), ("porg", "/")], "host string, path string")
    name, verdict = urlfilter.host_rule(df.host, df.path, rules)
    # a.net/x/ and b.a.net/ both fit the third row at eight characters: the longer host decides
    assert [tuple(r) for r in df.select(name, verdict).collect()] == [("a.net/x/", "block"), ("net/xxx/", "allow"), ("b.a.net/", "allow"), ("org/", "block"), (None, None)]
