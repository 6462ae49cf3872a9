"""Row-local clean-ups that need state from line to line: pandas UDFs over plain functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

COMMAND = re.compile(r"\\[a-zA-Z]")
# Lines longer than this are prose; up to so many characters a formula needs no mark.
LONGEST, BARE = 120, 3


@cache
def _part_of_math(c: str) -> int:
    """2 for characters that only formulas have (TeX's own, mathematical symbols, Greek letters), 1 for those that
    formulas may have, 0 for those of prose, code or other scripts."""
    if c.isascii():
        return 2 if c in "\\_^{}|" else int(c not in "`?[]~")
    if unicodedata.category(c) == "Sm" or unicodedata.name(c, "").startswith("GREEK "):
        return 2
    return int(c.isspace() or c == "\u200b")


def is_math(line: str) -> bool:
    """A line that holds nothing but a piece of a formula; a heading mark in front makes it none."""
    parts = {_part_of_math(c) for c in line[: LONGEST + 1]}
    short = len(line) <= BARE
    return bool(line) and not line.startswith("#") and len(line) <= LONGEST and min(parts) > 0 and (short or max(parts) == 2)


def islands(text: str, fits: Callable[[str], bool], bridge: bool):
    """Yields (lines, is_island): runs of fitting lines outside code fences; with ``bridge`` blank lines
    between two fitting lines belong to the run and are left out of it."""
    fenced, run, blanks = False, [], []
    for line in text.split("\n"):
        s = line.strip()
        fence = s.startswith(("```", "~~~"))
        if not fenced and not fence and fits(s):
            run.append(s)
            blanks = []
            continue
        if not fenced and not fence and not s and run and bridge:
            blanks.append(line)
            continue
        if run:
            yield run, True
        yield [*blanks, line], False
        run, blanks = [], []
        fenced ^= fence
    if run:
        yield run, True
    if blanks:
        yield blanks, False


def clean_math(text: str | None) -> str | None:
    """Formulas that were rendered three times: of three lines or more the longest with a command stays,
    else the longest; bare commands get dollar signs; spacing commands and empty math go."""
    if not text:
        return text
    out: list[str] = []
    for lines, island in islands(text, is_math, True):
        if island and len(lines) >= 3:
            out.append(max([x for x in lines if COMMAND.search(x)] or lines, key=len))
        else:
            out += lines
    text = "\n".join(out)
    if "$" not in text:
        text = re.sub(r"(?m)^(.*\\[a-zA-Z].*)$", lambda m: f"${m[1].strip()}$", text)
    text = re.sub(r"\\[,!;:]", "", text)
    text = re.sub(r"(?m)^\s*\$\s*\$\s*$", "", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def clean_ascii_clusters(text: str | None) -> str | None:
    """Runs of three or more short ASCII lines shrink to the longest (of equals the one with more marks)."""
    if not text:
        return text
    out: list[str] = []
    fits = lambda s: bool(s) and len(s) <= 60 and s.isascii() and not s.startswith(("[", "##"))
    for line in text.split("\n"):
        s = line.strip()
        if fits(s) and out and isinstance(out[-1], list):
            out[-1].append(s)
        else:
            out.append([s] if fits(s) else line)
    flat: list[str] = []
    for x in out:
        if isinstance(x, list):
            flat += [max(x, key=lambda c: (len(c), sum(m in c for m in "_^{}|\\")))] if len(x) >= 3 else x
        else:
            flat.append(x)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(flat)).strip()


# Words that begin a section and keep a short line on its own.
SECTION_WORDS = ("输入", "输出", "样例", "示例", "提示", "说明", "注意")


def merge_orphans(text: str | None, most: int = 20) -> str | None:
    """Short lines that follow each other become one line; blank lines stay as breaks."""
    if not text:
        return text
    out: list[str] = []
    open_ = False
    for line in text.split("\n"):
        s = line.strip()
        short = bool(s) and len(s) <= most and not s.startswith(SECTION_WORDS)
        if short and open_:
            out[-1] += f" {s}"
        else:
            out.append(s if short else line if s else "")
        open_ = short
    return "\n".join(out).strip()


# Elements without an end; TeX that renderers write for marks.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
TEX_MARKS = {r"^{\text{∗}}": r"^{\ast}", r"^{\text{*}}": r"^{\ast}", r"^{\text{†}}": r"^{\dagger}", r"^{\text{T}}": r"^{\mathsf{T}}"}


def plain_tex(tex: str) -> str:
    """TeX whose marks and indices don't stand in ``\\text``."""
    for old, new in TEX_MARKS.items():
        tex = tex.replace(old, new)
    return re.sub(r"([\^_])\{?\\text\{([^}]*)\}\}?", r"\1{\2}", tex)


class _Formula:
    """A formula that a page holds in several forms, and the one form of it that is kept: for ``katex`` the
    source, else the MathML's text, else all text; for ``MathJax`` the visible text (in dollars if it has a
    command), else the source. Other classes are copies, of which nothing is kept."""

    def __init__(self, tag: str, kind: str):
        self.kind, self.stack, self.parts = kind, [(tag, "other")], {}

    def open(self, tag: str, attrs: dict[str, str | None]) -> None:
        if tag in VOID:
            return
        form = self.stack[-1][1]
        if tag in ("annotation", "nobr"):
            form = tag
        elif tag == "script":
            form = "source" if (attrs.get("type") or "") == "math/tex" else "script"
        elif "katex-mathml" in (attrs.get("class") or "").split():
            form = "mathml"
        self.stack.append((tag, form))

    def data(self, text: str) -> None:
        self.parts[self.stack[-1][1]] = self.parts.get(self.stack[-1][1], "") + text.strip()

    def closed_by(self, tag: str) -> bool:
        at = max((i for i, (t, _) in enumerate(self.stack) if t == tag), default=len(self.stack))
        del self.stack[at:]
        return not self.stack

    def text(self) -> str:
        p = self.parts
        if self.kind == "katex" and "annotation" in p:
            tex = re.sub(r"^\\[hv]space\{[^}]*\}", "", p["annotation"]).strip()
            return f" ${tex}$ " if tex else ""
        if self.kind == "katex":
            return p.get("mathml") or p.get("other", "")
        if self.kind != "MathJax":
            return ""
        if shown := plain_tex(p.get("nobr", "")):
            return f" ${shown}$ " if COMMAND.search(shown) else f" {shown} "
        tex = plain_tex(p.get("source") or p.get("annotation", ""))
        return f" ${tex}$ " if tex else ""


class _Sections(HTMLParser):
    """Text under each heading of one level; formulas of ``var`` in dollars, those of KaTeX and MathJax once,
    lists and code as Markdown."""

    SKIP = {"script", "style", "nav"}
    FORMULAS = ("katex", "MathJax", "MathJax_Preview", "MJX_Assistive_MathML")
    formula: _Formula | None = None
    after_space = False

    def __init__(self, heading: str = "h3"):
        super().__init__(convert_charrefs=True)
        self.heading, self.out, self.title, self.buf, self.skip, self.pre = heading, [], "", [], 0, False

    def close_section(self):
        text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(self.buf))).strip()
        if self.title.strip() or text:
            self.out.append((self.title.strip(), text))
        self.title, self.buf = "", []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.formula:
            return self.formula.open(tag, a)
        kind = next((k for k in self.FORMULAS if k in (a.get("class") or "").split()), None)
        self.after_space &= tag in self.SKIP
        if kind and tag not in VOID and not self.skip:
            self.formula = _Formula(tag, kind)
        elif tag in self.SKIP:
            self.skip += 1
        elif tag == self.heading:
            self.close_section()
            self.in_title = True
        elif tag in ("var",):
            self.buf.append("$")
        elif tag == "pre":
            self.buf.append("\n```\n")
            self.pre = True
        elif tag == "li":
            self.buf.append("\n- ")
        elif tag in ("p", "div", "ul", "ol", "table", "tr", "section", "br"):
            self.buf.append("\n")
        elif tag == "td":
            self.buf.append(" | ")
        elif tag in ("b", "strong"):
            self.buf.append("**")
        elif tag == "img":
            alt = a.get("alt") or ""
            self.buf.append(f"${alt}$" if "equation" in (a.get("src") or "") or "equation" in (a.get("class") or "") else f"![{alt}]({a.get('src') or ''})")

    in_title = False

    def put_formula(self, text):
        before = self.title if self.in_title else "".join(self.buf[-1:])
        text = text.lstrip() if before[-1:].isspace() else text
        if self.in_title:
            self.title += text
        elif text:
            self.buf.append(text)
        self.after_space = (text or before)[-1:].isspace()

    def handle_endtag(self, tag):
        if self.formula:
            if self.formula.closed_by(tag):
                done, self.formula = self.formula.text(), None
                self.put_formula(done)
            return
        self.after_space &= tag in self.SKIP
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == self.heading:
            self.in_title = False
        elif tag == "var":
            self.buf.append("$")
        elif tag == "pre":
            self.buf.append("\n```\n")
            self.pre = False
        elif tag in ("b", "strong"):
            self.buf.append("**")
        elif tag in ("p", "div", "table", "section"):
            self.buf.append("\n")

    def handle_data(self, data):
        if self.formula:
            return self.formula.data(data)
        if self.skip:
            return
        if self.after_space and not self.pre:
            data = data.lstrip()
        self.after_space = self.after_space and not data
        if self.in_title:
            self.title += data
        else:
            self.buf.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_sections(html: str | None, heading: str = "h3") -> list[tuple[str, str]]:
    if not html:
        return []
    p = _Sections(heading)
    p.feed(html)
    p.close_section()
    return p.out


# Headings of the parts of a statement.
SECTION_KEYS = {
    "problem statement": "description", "problem": "description", "story": "description", "問題文": "description", "constraints": "constraints",
    "constraint": "constraints", "制約": "constraints", "入力": "input_format", "input": "input_format", "input format": "input_format",
    "出力": "output_format", "output": "output_format", "output format": "output_format",
}


def section_key(title: Column) -> Column:
    """What part of a statement a heading begins, in English or Japanese; samples by their kind; null: none."""
    t = F.lower(F.trim(title))
    keys = F.create_map(*(F.lit(x) for kv in SECTION_KEYS.items() for x in kv))
    kind = F.regexp_extract(t, r"^sample\s+(input|output)\s+\d+$", 1)
    return F.when(kind != "", F.concat(F.lit("sample_"), kind)).when(t.rlike(r"^sample\s+\d+$"), "sample").otherwise(F.try_element_at(keys, t))


def english_part(html: Column) -> Column:
    """The English part of a statement in two languages, up to the Japanese one; the whole if it has none."""
    en, ja = F.lit('<span class="lang-en">'), F.lit('<span class="lang-ja">')
    return F.when(F.contains(html, en), F.split_part(F.split_part(html, en, F.lit(2)), ja, F.lit(1))).otherwise(html)


def html_markdown(html: str | None) -> str | None:
    return None if html is None else "\n\n".join(f"### {t}\n{x}" if t else x for t, x in html_sections(html))


def html_samples(html: str | None) -> list[list[str]]:
    """(input, output) pairs: ``pre`` blocks below elements of class input and output, else in turns."""
    if not html:
        return []
    text = lambda x: unescape(re.sub(r"<[^>]+>", "", re.sub(r"(?i)<br\s*/?>|</div>", "\n", x))).strip()
    by_class = {k: [text(m) for m in re.findall(rf'(?is)class="[^"]*\b{k}\b[^"]*".*?<pre[^>]*>(.*?)</pre>', html)] for k in ("input", "output")}
    if by_class["input"] and len(by_class["input"]) == len(by_class["output"]):
        return [list(p) for p in zip(by_class["input"], by_class["output"], strict=True)]
    blocks = [text(m) for m in re.findall(r"(?is)<pre[^>]*>(.*?)</pre>", html)]
    return [list(p) for p in zip(blocks[::2], blocks[1::2], strict=False)]


def refence_math(text: str | None) -> str | None:
    """``$$$`` fences: pieces in turn are text and formula; neighbouring formulas become one (at most ten
    passes), continuation lines join, spaced letters in ``\\text`` close up."""
    if not text:
        return text
    parts = text.split("$$$")
    out = "".join(f"${p.strip()}$" if i % 2 and i < len(parts) - 1 or i % 2 and len(parts) % 2 else p for i, p in enumerate(parts))
    for _ in range(10):
        new = re.sub(r"\$([^$\n]+)\$\s?\$([^$\n]+)\$", r"$\1 \2$", out)
        if new == out:
            break
        out = new
    out = re.sub(r"\\text\{((?:\w )+\w)\}", lambda m: "\\text{" + m[1].replace(" ", "") + "}", out)
    return re.sub(r"(?<=[,;])\n(?=[a-z$])", " ", out)


def editorial_sections(children: list[tuple[str, str]]) -> dict[str, str]:
    """Problem letter -> text of an editorial: a child whose text begins ``letter.`` or ``123A -`` opens a
    section up to the next; neighbours of the same letter share one."""
    out: dict[str, list[str]] = {}
    letter = None
    for _, text in children:
        m = re.match(r"^\s*(?:\d+)?([A-Z]\d?)\s*[.\-–—:]", text)
        if m:
            letter = m[1]
        if letter:
            out.setdefault(letter, []).append(text)
    return {k: "\n".join(v) for k, v in out.items()}


def _udf(f: Callable[[str | None], str | None]):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action=None)

    return run


def clean_math_col(c: Column) -> Column:
    return _udf(clean_math)(c)


def clean_ascii_clusters_col(c: Column) -> Column:
    return _udf(clean_ascii_clusters)(c)


def merge_orphans_col(c: Column) -> Column:
    return _udf(merge_orphans)(c)


def html_markdown_col(c: Column) -> Column:
    return _udf(html_markdown)(c)


def refence_math_col(c: Column) -> Column:
    return _udf(refence_math)(c)


def html_samples_col(c: Column) -> Column:
    @F.pandas_udf("array<array<string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(html_samples)

    return run(c)


def html_sections_col(c: Column) -> Column:
    @F.pandas_udf("array<struct<title:string,text:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda h: [{"title": t, "text": x} for t, x in html_sections(h)])

    return run(c)
