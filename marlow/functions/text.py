"""Text and HTML transforms as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entities that are decoded, in this order.
ENTITIES = [
    ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&nbsp;", " "),
    ("&#8217;", "'"), ("&#8216;", "'"), ("&#8220;", '"'), ("&#8221;", '"'), ("&#8230;", "..."), ("&#xA0;", " "),
]
# Elements that end or begin a line.
BLOCK_END = "p|div|li|h[1-6]|pre|blockquote|section|article|main|aside|header|footer|nav|figure|figcaption|details|summary|fieldset|form|table|tr|ul|ol|dl"
BLOCK = "p|div|h[1-6]|pre|blockquote|li|tr|ul|ol|dl|table|section|article|main|aside|header|footer|nav"
# Characters that vanish, become a blank, become an apostrophe.
NO_WIDTH = "​⁡﻿⁠￼"
BLANKS = "          "
QUOTES = "‘’`′"


def regex_chain(c: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def decode_entities(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def strip_tags(c: Column) -> Column:
    """Block elements become line feeds, other tags go; a bare ``<`` is text."""
    return regex_chain(c, [
        (f"(?i)</(?:{BLOCK_END})>", "\n"), (r"(?i)<(?:br|hr)\b[^>]*/?>", "\n"), (rf"(?i)</?(?:{BLOCK})\b[^>]*>", "\n"),
        (r"<(?![a-zA-Z/])", "&lt;"), (r"<[^>]+>", ""),
    ])


def tidy_lines(c: Column) -> Column:
    out = regex_chain(c, [(r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n")])
    return F.regexp_replace(out, r"\A\s+|\s+\z", "")


def html_to_text(c: Column, latex: bool = True) -> Column:
    """Plain text; superscripts and subscripts become LaTeX, or ``^x`` and ``_x`` without ``latex``."""
    if latex:
        marks = [(r"(?i)([A-Za-z0-9.\-]+)<sup>([^<]+)</sup>", r"\$$1^{$2}\$"), (r"(?i)([A-Za-z0-9.\-]+)<sub>([^<]+)</sub>", r"\$$1_{$2}\$")]
    else:
        marks = [("(?i)<sup>([^<]+)</sup>", "^$1"), ("(?i)<sub>([^<]+)</sub>", "_$1")]
    return tidy_lines(decode_entities(strip_tags(regex_chain(F.coalesce(c, F.lit("")), marks))))


def normalise_unicode(c: Column) -> Column:
    """Zero-width characters go, odd blanks and quotes become plain ones."""
    return F.translate(c, BLANKS + QUOTES + NO_WIDTH, " " * len(BLANKS) + "'" * len(QUOTES))


def wrap_latex(c: Column) -> Column:
    wrapped = regex_chain(c, [(r"(\\[a-zA-Z\s](?:\{[^}]*\})*)", r"\$$1\$"), (r"([A-Za-z0-9]+[_^]\s*(?:\{[^}]*\}|[A-Za-z0-9]+))", r"\$$1\$")])
    return F.when(c.contains("$"), c).otherwise(wrapped)


def normalise_space(c: Column) -> Column:
    return F.trim(wrap_latex(regex_chain(c, [(r"\r\n|\r", "\n"), (r"\n{3,}", "\n\n"), (r"\n[ \t]+\n", "\n\n"), (r"[ \t]{2,}", " ")])))


def drop_spacing_commands(c: Column) -> Column:
    r"""Without ``\,`` ``\!`` ``\;`` ``\:``."""
    return F.regexp_replace(c, r"\\[,!;:]", "")


def drop_space_lines(c: Column) -> Column:
    r"""Without lines that begin with ``\hspace{`` or ``\vspace{``, alone or in math."""
    kept = F.filter(F.split(c, "\n"), lambda x: ~F.trim(x).rlike(r"^\$?\$?\\[hv]space\{"))
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def drop_repeated_lines(c: Column) -> Column:
    """A line that equals the last one with text (outer blanks aside) goes; blank lines stay."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("last"))

    def step(acc: Column, line: Column) -> Column:
        s = F.trim(line)
        again = (s != "") & (s == acc["last"])
        return F.struct(F.when(again, acc["out"]).otherwise(F.concat(acc["out"], F.array(line))).alias("out"), F.when(s != "", s).otherwise(acc["last"]).alias("last"))

    return F.array_join(F.aggregate(F.split(c, "\n"), start, step)["out"], "\n")


def repair_list_markers(c: Column) -> Column:
    return F.regexp_replace(c, "(?i)([a-z0-9:;])- ", "$1\n- ")


def section_headings(c: Column) -> Column:
    """``[name]`` on its own line becomes a heading."""
    return F.regexp_replace(c, r"(?m)^\[([^\]\n]{1,12})\]\s*$", "### $1")


def drop_metadata_header(c: Column) -> Column:
    """Without the limits and streams that head a Codeforces statement."""
    header = r"(?i)\A\d+\s*seconds?\s*\n+\s*memory limit per test\s*\n+\d+\s*megabytes\s*\n+\s*input\s*\n+\s*standard input\s*\n+\s*output\s*\n+\s*standard output\s*\n+"
    return regex_chain(c, [(header, ""), (r"\A\s+|\s+\z", "")])


def limit_ms(c: Column) -> Column:
    """"2 seconds" -> 2000."""
    return (F.regexp_extract(c, r"(?i)(\d+(?:\.\d+)?)\s*seconds?", 1).try_cast("double") * 1000).cast("int")


def limit_mb(c: Column) -> Column:
    """"256 megabytes" -> 256, "1 gigabyte" -> 1024."""
    mb = F.regexp_extract(c, r"(?i)(\d+(?:\.\d+)?)\s*megabytes?", 1).try_cast("double")
    gb = F.regexp_extract(c, r"(?i)(\d+(?:\.\d+)?)\s*gigabytes?", 1).try_cast("double") * 1024
    return F.coalesce(mb, gb).cast("int")


def chinese_limits(c: Column) -> Column:
    return F.struct(
        F.regexp_extract(c, r"时间限制[：:]\s*(?:C/C\+\+\s*)?(\d+)\s*秒", 1).try_cast("int").alias("seconds"), F.regexp_extract(c, r"空间限制[：:]\s*(?:C/C\+\+\s*)?(\d+)\s*[KM]", 1).try_cast("int").alias("memory"),
    )


def digits_only(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, "[^0-9]", "").try_cast("int"), F.lit(0))


def title_after_dash(c: Column) -> Column:
    return decode_entities(F.trim(F.regexp_replace(c, r"(?s)\A.*? - ", "")))


def samples_markdown(samples: Column) -> Column:
    """``[样例]`` block of an array of arrays (input, output, and perhaps an explanation)."""
    block = lambda name, i, x: F.concat(F.lit(f"{name} #"), i.cast("string"), F.lit("\n```\n"), F.coalesce(x, F.lit("")), F.lit("\n```"))

    def one(s: Column, i: Column) -> Column:
        note = F.trim(F.get(s, F.lit(2)))
        said = F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit("解释 #"), (i + 1).cast("string"), F.lit("\n\n"), note))
        return F.concat_ws("\n\n", block("输入", i + 1, F.get(s, F.lit(0))), block("输出", i + 1, F.get(s, F.lit(1))), said)

    return F.when(F.size(samples) > 0, F.concat(F.lit("[样例]\n"), F.array_join(F.transform(samples, one), "\n\n")))


def section(name: str, c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"[{name}]\n"), c))


def build_content(platform: Column, r: dict[str, Column]) -> Column:
    """The sections of a problem, those that have text, in order. ``r`` may have background, description,
    constraints, input_format, output_format, samples, hint, note, time_limit, memory_limit, content (HTML)."""
    none = F.lit(None).cast("string")
    get = lambda k: r.get(k, none)
    limits = F.when(
        get("time_limit").isNotNull() | get("memory_limit").isNotNull(),
        F.concat(F.lit("**时限**: "), F.coalesce(F.concat(get("time_limit"), F.lit("ms")), F.lit("?")), F.lit(" / **内存**: "), F.coalesce(F.concat(get("memory_limit"), F.lit("MB")), F.lit("?"))),
    )
    text = F.nullif(get("description"), F.lit(""))
    described = F.nullif(F.concat_ws("\n\n", limits, text), F.lit(""))
    html = F.when(F.coalesce(get("content"), F.lit("")).rlike(r"\A\s*<"), html_to_text(get("content"))).otherwise(get("content"))
    not_lc = lambda c: F.when(platform != "leetcode", c)
    return F.concat_ws(
        "\n\n", F.when(text.isNull(), section("描述", html)), section("背景", get("background")), section("描述", described), section("数据范围", get("constraints")),
        not_lc(section("输入", get("input_format"))), not_lc(section("输出", get("output_format"))), samples_markdown(r["samples"]) if "samples" in r else none,
        section("提示", get("hint")), section("注", get("note")),
    )


#: Fields of raw detail that content is built from.
RAW_DETAIL = ", ".join(f"{x} string" for x in "background description content constraints input_format output_format inputSpec outputSpec hint note time_limit memory_limit sampleTestCase exampleTestcases".split()) + ", samples array<array<string>>"


def once(c: Column) -> Column:
    """A short name that stands in three paragraphs is one line."""
    return F.replace(F.regexp_replace(c, r"\n\n([a-zA-Z0-9]{1,3})\n\n\1\n\n\1(\n|\z)", "\n$1$2"), F.lit("\n\n\n"), F.lit("\n\n"))


def rebuild_content(df: DataFrame, platform: str, raw: str, name: str = "body") -> DataFrame:
    """``df`` with ``build_content`` from a problem's stored raw detail (JSON) as ``name``; null where that is no JSON.

    The JSON and each of its parts are columns of a select of their own: each stands in several places of what follows,
    which would otherwise read the JSON anew for every one of them.
    """
    df = df.withColumn("__x", F.from_json(raw, RAW_DETAIL))
    x = F.col("__x")
    full = lambda *names: F.coalesce(*(F.nullif(x[n], F.lit("")) for n in names))
    r = {k: full(k) for k in ("background", "description", "constraints", "hint", "content", "note", "time_limit", "memory_limit")}
    r |= {"input_format": full("input_format", "inputSpec"), "output_format": full("output_format", "outputSpec"), "example": full("sampleTestCase", "exampleTestcases")}
    r["samples"] = F.transform(F.filter(x["samples"], lambda s: F.size(s) >= 2), lambda s: F.transform(s, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+\z", "")))
    df = df.withColumns({f"__{k}": c for k, c in r.items()})
    at = {k: F.col(f"__{k}") for k in r}
    bare = (F.col(platform) == "leetcode") & (F.coalesce(F.size(at["samples"]), F.lit(0)) <= 0) & at["example"].isNotNull()
    short = {f"__{k}": once(at[k]) for k in ("background", "description", "constraints", "hint", "input_format", "output_format")}
    df = df.withColumns(short | {"__samples": F.when(bare, F.array(F.array(x["sampleTestCase"], x["exampleTestcases"]))).otherwise(at["samples"])})
    at.pop("example")
    df = df.withColumn(name, F.when(x.isNotNull(), build_content(F.col(platform), at)))
    return df.drop("__x", *(f"__{k}" for k in r))


def format_summary(r: dict[str, Column]) -> Column:
    """Labelled parts of a summary, joined by blank lines; empty ones are left out."""
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    items = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}:\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("  - "), x)), "\n")))
    return F.concat_ws(
        "\n\n", line("Summary", r["summary"]), line("Approach", r["approach"]), items("Key Points", r["key_points"]), items("Pitfalls", r["pitfalls"]),
        F.when(F.size(r["tags"]) > 0, F.concat(F.lit("Tags: "), F.array_join(r["tags"], ", "))), F.when(r["difficulty"].isNotNull(), F.concat(F.lit("Difficulty: "), r["difficulty"].cast("string"), F.lit("/10"))),
        line("Similar", r["similar"]),
    )


def json_in_text(c: Column) -> Column:
    """What a chat model returned: the inside of a code fence, else the first brace to the last."""
    fenced = F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    return F.coalesce(fenced, F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")))


def page_island(html: Column, pattern: str) -> Column:
    """JSON that a page carries in a script; ``pattern`` has it as its first group."""
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


LENTILLE = r'(?s)<script[^>]*id="lentille-context"[^>]*>(.*?)</script>'
INITIAL_STATE = r"(?s)window\.__INITIAL_STATE__\s*=\s*(\{.*?\})\s*;?\s*</script>"


def repeat_diagnostics(c: Column) -> Column:
    """struct(formulas, distinct_formulas, triple_lines): signs of text that was rendered thrice."""
    found = F.regexp_extract_all(c, F.lit(r"(\$[^$\n]+\$)"), F.lit(1))
    return F.struct(F.size(found).alias("formulas"), F.size(F.array_distinct(found)).alias("distinct_formulas"), F.regexp_count(c, F.lit(r"(?m)^(.+)\n\1\n\1$")).alias("triple_lines"))


def sample_pairs(c: Column) -> Column:
    """array(array(input, output)) of texts with 输入/输出 marks."""
    pattern = r"(?s)输入\s*[:：]\s*(.*?)\s*输出\s*[:：]\s*(.*?)(?=\n\s*输入|\n\s*示例|\z)"
    clean = lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", "")
    return F.transform(F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("b")), lambda x: F.array(clean(x["a"]), clean(x["b"])))


def leetcode_samples(html: Column) -> Column:
    """array(array(input, output)) of ``<pre>`` examples; of example blocks where there are none."""
    strong = lambda words: rf"(?:<(?:strong|b)>)?\s*(?:{words})\s*[：:]?\s*(?:</(?:strong|b)>)?\s*"
    pre = rf"(?is)<pre>\s*{strong('Input|输入')}(.*?)\s*{strong('Output|输出')}(.*?)\s*(?:(?:<strong>)?\s*(?:Explanation|解释).*?)?</pre>"
    new = r"(?is)<(?:strong|b)>\s*(?:Input|输入)\s*[：:]?\s*</(?:strong|b)>\s*(?:<span[^>]*>)?(.*?)(?:</span>)?\s*</p>.*?<(?:strong|b)>\s*(?:Output|输出)\s*[：:]?\s*</(?:strong|b)>\s*(?:<span[^>]*>)?(.*?)(?:</span>)?\s*</p>"
    text = lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", ""))

    def pairs(p: str) -> Column:
        return F.transform(F.arrays_zip(F.regexp_extract_all(html, F.lit(p), F.lit(1)).alias("a"), F.regexp_extract_all(html, F.lit(p), F.lit(2)).alias("b")), lambda x: F.array(text(x["a"]), text(x["b"])))

    return F.when(F.size(pairs(pre)) > 0, pairs(pre)).otherwise(pairs(new))


ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def utf16_hex(text: Column, width: int) -> Column:
    """The first ``width`` UTF-16 units of a text, as four hexadecimal digits each."""
    return F.left(F.hex(F.encode(F.left(text, F.lit(width)), "UTF-16BE")), F.lit(4 * width))


def utf16_units(text: Column, width: int) -> Column:
    """The first ``width`` UTF-16 units of a text as numbers."""
    h = utf16_hex(text, width)
    return F.transform(F.filter(F.split(h, "(?<=\\G....)"), lambda u: u != ""), lambda u: F.conv(u, 16, 10).cast("long"))


def utf16_left(text: Column, width: int) -> Column:
    """The first ``width`` UTF-16 units of a text. A character above U+FFFF is two of them; where the cut would leave
    its first half, that half is the replacement character, as it is when such a text is written as UTF-8."""
    h = utf16_hex(text, width)
    split = F.substring(h, 4 * width - 3, 4).between("D800", "DBFF")
    cut = F.concat(F.decode(F.unhex(F.when(split, F.left(h, F.lit(4 * width - 4))).otherwise(h)), "UTF-16BE"), F.when(split, F.lit("\ufffd")).otherwise(""))
    # texts without such characters, and those that are short enough, are cut as they are
    return F.when(F.length(text) * 2 <= width, text).when(F.left(text, F.lit(width)).rlike(ASTRAL), cut).otherwise(F.left(text, F.lit(width)))
