"""Worked examples and properties of expressions and row functions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlow.functions import difficulty, scores, scraped, text
from marlow.functions import identity as ident
from marlow.functions import queries as qa
from marlow.sources import dims


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_proficiency_worked(spark):
    got = one(spark, scores.proficiency(F.lit(30), F.lit(60), F.lit(5.0), F.lit(0.0)))[0]
    assert got == pytest.approx(0.4 * 0.5 + 0.3 * 0.5 + 0.2 * 1 + 0.1)


def test_compatibility_worked(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    a = {"strong": arr("x"), "weak": arr("y"), "score": F.lit(0.5), "style": F.lit(None).cast("string")}
    b = {"strong": arr("y"), "weak": arr("x"), "score": F.lit(0.5), "style": F.lit(None).cast("string")}
    assert one(spark, scores.compatibility(a, b))[0] == pytest.approx(0.9)
    assert one(spark, scores.style_match(F.lit(" Grinder"), F.lit("deep_diver")))[0] == 1.0


@pytest.mark.parametrize(("history", "ease", "days"), [([], 2.5, 1), ([5], 2.6, 2), ([5, 4, 3], 2.46, 8), ([5, 5, 1], 2.55, 1), ([0] * 12, 1.3, 1), ([5] * 12, 3.7, 365)])
def test_sm2(spark, history, ease, days):
    got = one(spark, scores.sm2(F.array(*map(F.lit, history)).cast("array<int>")).alias("s")).s
    assert (round(got.ease, 2), got.interval) == (ease, days)


def test_difficulty_scales(spark):
    rows = [("luogu", "入门", 1.0, 1500.0), ("luogu", "3", 5.0, 1400.0), ("luogu", "66.5", 5.0, 2700.0), ("leetcode", "Hard", 8.0, 2500.0), ("codeforces", "2000", 5.0, 2000.0), ("codeforces", "x", 5.0, 1500.0), ("nowcoder", "较难", 5.0, 2200.0), ("atcoder", "-50", 1.0, 0.0), ("?", None, 5.0, 1500.0)]
    df = spark.createDataFrame(rows, "p string, r string, ten double, elo double")
    for r in df.select("p", "r", "ten", "elo", difficulty.to_ten(F.col("p"), F.col("r")).alias("t"), difficulty.to_elo(F.col("p"), F.col("r")).alias("e")).collect():
        assert (r.t, r.e) == (r.ten, r.elo), r


def test_html_to_text(spark):
    html = "<p>3 &lt;= n &lt;= 10<sup>4</sup></p>\n\n\n<div>a<sub>i</sub> <= x &amp; <b>y</b></div><br/>end &#8217;"
    assert one(spark, text.html_to_text(F.lit(html)))[0] == "3 <= n <= $10^{4}$\n\n$a_{i}$ <= x & y\n\nend '"
    assert one(spark, text.html_to_text(F.lit("x<sup>2</sup>"), latex=False))[0] == "x^2"
    assert one(spark, text.html_to_text(F.lit(None).cast("string")))[0] == ""


def test_leetcode_samples(spark):
    old = "<pre>\n<strong>输入：</strong>n = 1\n<strong>输出：</strong>2\n<strong>解释：</strong>so\n</pre><pre><strong>Input:</strong> a\n<strong>Output:</strong> b</pre>"
    assert one(spark, text.leetcode_samples(F.lit(old)).alias("s")).s == [["n = 1", "2"], ["a", "b"]]
    new = '<div class="example-block"><p><strong>输入：</strong><span class="example-io">x</span></p><p><strong>输出：</strong><span class="example-io">y</span></p></div>'
    assert one(spark, text.leetcode_samples(F.lit(new)).alias("s")).s == [["x", "y"]]
    assert one(spark, text.sample_pairs(F.lit("输入：1 2\n输出：3\n输入：4\n输出：5")).alias("s")).s == [["1 2", "3"], ["4", "5"]]


def test_lines_and_commands(spark):
    assert one(spark, text.drop_repeated_lines(F.lit("a\na \n\nb\nb\na")))[0] == "a\n\nb\na"
    assert one(spark, text.drop_space_lines(F.lit("a\n$$\\hspace{1cm}$$\nb")))[0] == "a\nb"
    assert one(spark, text.drop_spacing_commands(F.lit(r"a\,b\!c\;d\:e")))[0] == "abcde"
    assert one(spark, text.repair_list_markers(F.lit("n:- one")))[0] == "n:\n- one"
    assert one(spark, text.title_after_dash(F.lit("A - x &amp; y")))[0] == "x & y"
    assert one(spark, text.limit_ms(F.lit("2.5 seconds")), text.limit_mb(F.lit("1 gigabyte")))[:] == (2500, 1024)


def test_clean_math():
    assert scraped.clean_math("f 是\n\nf\n\n(\n\nf(\\cdot)\n\n好") == "f 是\n\n$f(\\cdot)$\n\n好"
    fenced = "```\n5\n4 2\n111\n```"
    assert scraped.clean_math(fenced) == fenced
    assert scraped.clean_math(None) is None
    assert scraped.clean_ascii_clusters("题\nn\nn_i\nn\n尾") == "题\nn_i\n尾"
    assert scraped.merge_orphans("有一个\nn\n行\n\n输入\nx") == "有一个 n 行\n\n输入\nx"


def test_html_pieces():
    assert scraped.html_samples('<div class="input"><pre>1<br>2</pre></div><div class="output"><pre>3</pre></div>') == [["1\n2", "3"]]
    got = scraped.html_sections("<h3>Input</h3><p>Read <var>N</var></p><ul><li>a</li></ul><script>x</script><h3>Output</h3>done")
    assert got == [("Input", "Read $N$\n\n- a"), ("Output", "done")]
    assert scraped.refence_math("let $$$n$$$ be") == "let $n$ be"
    assert scraped.editorial_sections([("p", "A. one"), ("p", "more"), ("p", "B. two")]) == {"A": "A. one\nmore", "B": "B. two"}


def test_udf_columns(spark):
    df = spark.createDataFrame([("x\n\n1\n\n\\le x\n\nx",), (None,)], "t string")
    assert df.select(scraped.clean_math_col(F.col("t")).alias("c")).collect()[1].c is None
    page = spark.createDataFrame([("<pre>1</pre><pre>2</pre>",)], "t string")
    assert page.select(scraped.html_samples_col(F.col("t")).alias("s"), scraped.html_sections_col(F.col("t")).alias("x")).first().s == [["1", "2"]]


def test_query_analysis(spark):
    q = spark.createDataFrame([("单调栈DP题",), ("prime numbers",), ("use prim here",), ("为什么 dp 会 WA",), ("x",)], "q string")
    got = [r.a for r in q.select(qa.analyse(F.col("q"), dims.TERMS).alias("a")).collect()]
    assert got[0].terms == ["动态规划"] and got[0].query_type == "algorithm_intent"
    assert got[1].terms == [] and got[1].query_type == "problem_semantic"
    assert got[2].terms == ["最小生成树"]
    assert got[3].query_type == "error_reason" and "状态转移" in got[3].keywords
    assert got[4] is None


def test_identity(spark):
    row = one(spark, ident.contest_and_index(F.lit("1234B2")).alias("c"), ident.verdict(F.lit(" ac ")).alias("v"), ident.file_key(F.lit("2026-06-14_P1.json")).alias("k"), ident.atcoder_contest(F.lit("abc123_a")).alias("a"))
    assert (row.c["contest"], row.c["index"], row.v, row.k, row.a) == (1234, "B2", "OK", "P1", "abc123")


def test_taxonomy():
    tags = [t for ts in dims.CATEGORIES.values() for t in ts]
    assert len(tags) == len(set(tags)) == 138
    assert len(dims.PREREQUISITES) == 83


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab1_\\$ \n`x", max_size=60))
def test_clean_math_never_fails(s):
    out = scraped.clean_math(s)
    assert out == out.strip() or out == s


def test_rolling_hash(spark):
    from marlow.operators.dedup import rolling_hash

    def want(s):
        h = 0
        for c in s[:200]:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return abs(h - (1 << 32) if h >= 1 << 31 else h) % 100_000

    for s in ("hello", "动态规划 DP", "x" * 500, "a"):
        assert one(spark, rolling_hash(F.lit(s)))[0] == want(s)
    assert math.isfinite(want("x"))


def test_rendered_formulas():
    katex = '<span class="katex"><span class="katex-mathml"><math><mi>x</mi>{}</math></span><span class="katex-html">x</span></span>'
    mathjax = '<span class="MathJax_Preview">x</span><span class="MathJax">{}</span><script type="math/tex">x</script>'
    one = lambda formula: scraped.html_markdown(f"<p>let {formula} be</p>")
    assert one(katex.format("<annotation>\\hspace{3pt} x_1</annotation>")) == "let $x_1$ be"
    assert one(katex.format("<annotation>\\hspace{3pt}</annotation>")) == "let be"
    assert one(katex.format("")) == "let x be"
    assert one(mathjax.format("<nobr>a^{\\text{*}} \\le <b>1</b></nobr>")) == "let $a^{\\ast} \\le1$ be"
    assert one(mathjax.format("<nobr>n</nobr><script type='math/tex'>m</script>")) == "let n be"
    assert one(mathjax.format("<script type='math/tex'>p_{\\text{i}}</script>")) == "let $p_{i}$ be"
    assert one('<span class="katex">never closed') == "let"
    assert scraped.html_sections('<h3>Size <span class="MathJax"><nobr>n</nobr></span></h3><p>a</p>') == [("Size n", "a")]


def test_section_keys(spark):
    df = spark.createDataFrame([(t,) for t in ("Problem Statement", " 制約 ", "Sample Input 12", "Sample 1", "Notes", None)], "t string")
    assert [r.k for r in df.select(scraped.section_key(F.col("t")).alias("k")).collect()] == ["description", "constraints", "sample_input", "sample", None, None]
