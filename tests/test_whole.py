"""Queries over whole tables at a larger scale: equal to their SQL or to brute force, on all rows."""

import os
import re

import pytest
from oracle import assert_equal, duck

from marlow.operators import matching, training
from marlow.plans.all_queries import REGISTER
from marlow.sources import landing

SF = os.environ.get("MARLOW_TEST_SF_WHOLE", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


ALL = (
    "a24_team_sizes", "a32_strengths", "f22_query_analysis", "f36_imputed_difficulty", "j01_include_many", "j06_hydration", "j07_fallback_resolution", "r15_pair_scores", "r17_teammates",
    "s16_submission_table", "s23_problem_table", "t08_unicode", "t14_whitespace", "w11_sections",
)


@pytest.mark.parametrize("name", ALL)
def test_all_rows(spark, con, name):
    assert_equal(REGISTER[name].run(spark, SF), REGISTER[name].sql, con)


def test_unicode_marks(spark, tmp_path):
    text = "caf\u00e9 \u2018a\u2019 `b` c\u2032\u200b \u2003\u00a0d\ufeff"
    spark.createDataFrame([(500, text, "fr")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = REGISTER["t08_unicode"].run(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.text) for r in got] == [(500, "caf\u00e9 'a' 'b' c'   d")]


def test_pairs_in_blocks(spark):
    """Blocks in numpy against the column expressions, pair by pair."""
    rows = [(i, [f"c{i % 3}", f"c{i % 3}"] if i % 4 else None, [f"c{i % 2}"], i % 7 / 7 if i % 9 else None, [" Grinder", "balanced", None, "specialist"][i % 4]) for i in range(40)]
    df = spark.createDataFrame([*rows, (None, ["c1"], ["c1"], 0.5, "balanced")], "user_id long, strong array<string>, weak array<string>, score double, style string")
    pairs = spark.createDataFrame([(i, k) for i in range(40) for k in range(40) if i != k], "user_id long, other_id long")
    every = sorted(((r.user_id, -r.total, r.other_id) for r in matching.pair_detail(df, pairs).collect()))
    asks = [i for i in range(40) if i % 5 == 0]
    skipped = {(0, every[0][2]), (0, every[1][2]), (5, 39)}
    gone = spark.createDataFrame([*skipped], "user_id long, other_id long")
    for exclude, left in ((None, every), (gone, [x for x in every if (x[0], x[2]) not in skipped])):
        want = [[x for x in left if x[0] == i][:10] for i in asks]
        got = matching.pair_scores(df.where("user_id % 5 = 0"), df, exclude, rows=7).orderBy("u_id", "rk").collect()
        assert [(r.u_id, -r.pair, r.c_id) for r in got] == [x for w in want for x in w]


def test_week_of_all_problems(spark):
    rows = [(i, [f"t{i % 5}"] if i % 3 else [f"t{i % 4}", "t9"], i * 37 % 101 / 10, i * 7 % 11 / 10) for i in range(600)]
    c = spark.createDataFrame(rows, "problem_id long, tags array<string>, difficulty double, score double")
    plans = [(1, ["t1"], ["t2"], ["t9"], [2.0, 5.0, 8.0]), (2, ["t1"], ["t2"], ["t9"], [2.0, 5.0, 8.0]), (3, ["none"], [], ["t3"], [4.0, 4.0])]
    p = spark.createDataFrame(plans, "user_id long, primary array<string>, secondary array<string>, explore array<string>, curve array<double>")
    want = training.arrange(c.crossJoin(p.select("user_id")), p)
    got = training.arrange_all(c, p)
    assert got.select(*want.columns).orderBy(*want.columns).collect() == want.orderBy(*want.columns).collect()
    assert got.where("problem_id >= 400").count() and got.select("user_id").distinct().count() == 3


def test_week_plan_reads_all(spark, con):
    got = REGISTER["r21_week_plan"].run(spark, SF).cache()
    assert got.select("user_id").distinct().count() == con.sql("SELECT count(*) FROM customer").fetchall()[0][0]
    assert got.where("problem_id >= 400").count()


def test_pages_meet_their_own_header(spark):
    link = lambda i: f"/acm/problem/{i}"
    rows = [
        (1, 0, ["题目", "难度", "标签"], ["", "", ""]), (1, 1, ["a", "3", "dp,x"], [link(7), "", ""]), (1, 2, ["b", "4", "y"], [link(8), "", ""]),
        (2, 0, ["标签", "题目", "难度"], ["", "", ""]), (2, 1, ["graph", "c", "5"], ["", link(9), ""]), (2, 2, ["z", "a", "6"], ["", link(7), ""]),
    ]
    df = spark.createDataFrame(rows, "page int, row int, cells array<string>, links array<string>")
    got = landing.problem_table(df, page="page").collect()
    assert [(r.id, r.difficulty, r.tags) for r in got] == [("7", "3", ["dp", "x"]), ("8", "4", ["y"]), ("9", "5", ["graph"])]
    assert [r.id for r in landing.problem_table(df.where("page = 2")).collect()] == ["9", "7"]


def spaces(t):
    """T-14, row by row."""
    for pattern, to in ((r"\r\n|\r", "\n"), (r"\n{3,}", "\n\n"), (r"\n[ \t]+\n", "\n\n"), (r"[ \t]{2,}", " ")):
        t = re.sub(pattern, to, t)
    if "$" not in t:
        t = re.sub(r"(\\[a-zA-Z\s](?:\{[^}]*\})*)", r"$\g<1>$", t, flags=re.ASCII)
        t = re.sub(r"([A-Za-z0-9]+[_^]\s*(?:\{[^}]*\}|[A-Za-z0-9]+))", r"$\g<1>$", t, flags=re.ASCII)
    return t.strip(" ")


def test_whitespace_of_all_texts(spark, con):
    whole = REGISTER["t14_whitespace"].run(spark, SF)
    assert whole.count() == con.sql("SELECT count(*) FROM documents WHERE doc_id % 17 <> 0").fetchall()[0][0]
    content = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    assert all(r.body == spaces(content[r.id]) for r in whole.collect())


def test_whitespace_wraps_latex(spark, tmp_path):
    texts = [r"A_i and x^{2}  \ldots{a} \, z", "a $x_1$\r\n\r\n\r\nb_2", "x_ {ab}\\ y\n \t\nq", "n\rm^2_k", r"\frac{a}{b}_c"]
    df = spark.createDataFrame([(i + 1, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.id: r.body for r in REGISTER["t14_whitespace"].run(spark, str(tmp_path)).collect()}
    assert got == {i + 1: spaces(t) for i, t in enumerate(texts)} and "$A_i$" in got[1]


@pytest.fixture(scope="module")
def content(con):
    return dict(con.sql("SELECT doc_id, text FROM documents WHERE doc_id % 17 <> 0").fetchall())


def bodies(spark, name):
    return {r.id: r.body for r in REGISTER[name].run(spark, SF).collect()}


def test_spacing(spark, content):
    def brute(t):
        lines = [x for x in re.sub(r"\\[,!;:]", "", t).split("\n") if not re.match(r"\$?\$?\\[hv]space\{", x.strip(" "))]
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip(" ")

    assert bodies(spark, "t16_spacing") == {i: brute(f"ab\n{t}") for i, t in content.items()}


def test_metadata_header(spark, content):
    assert bodies(spark, "t17_metadata_header") == {i: t.strip(" \t\n\x0b\f\r") for i, t in content.items()}


def test_rebuilt_content(spark, con):
    def brute(i, t, lang, source):
        block = lambda *io: "[样例]\n" + "\n\n".join(f"{n} #1\n```\n{x}\n```" for n, x in zip(("输入", "输出"), io, strict=True))
        leetcode = i % 5 == 1
        parts = [f"[背景]\n{lang}", f"[描述]\n{t}" if t else "", "" if leetcode or not t[:40] else f"[输入]\n{t[:40]}", block(lang, source) if i % 2 == 0 else block("", source) if leetcode else ""]
        return "\n\n".join(x for x in parts if x)

    rows = con.sql("SELECT doc_id, text, lang, source FROM documents WHERE doc_id % 17 <> 0").fetchall()
    fold = lambda t: re.sub(r"\n\n([a-zA-Z0-9]{1,3})\n\n\1\n\n\1(\n|$)", r"\n\1\2", t).replace("\n\n\n", "\n\n")
    assert bodies(spark, "t18_rebuilt_content") == {i: brute(i, fold(t), lang, source) for i, t, lang, source in rows}


def test_repeats(spark, content):
    found = lambda t: re.findall(r"\$[^$\n]+\$", t)
    more = {i: f"{t}\n$a_1$\n$a_1$\n$a_1$\n$b$" for i, t in content.items()}
    want = {i: (len(found(t)), len(set(found(t))), len(re.findall(r"(?m)^(.+)\n\1\n\1$", t))) for i, t in more.items()}
    assert {r.id: (r.formulas, r.distinct_formulas, r.triple_lines) for r in REGISTER["t19_repeats"].run(spark, SF).collect()} == want


@pytest.mark.parametrize("name", ["t20_list_markers", "f39_titles"])
def test_text_steps(spark, con, name):
    assert_equal(REGISTER[name].run(spark, SF), REGISTER[name].sql, con)
