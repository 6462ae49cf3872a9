"""URL filtering by association rules of labelled pages: FP-growth, pruned, matched by an inverted index."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlow.llm.common import written

BAD = "label=bad"
#: Fixed rules of the query: (host, path, verdict).
HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_PARTS = re.compile(r"[A-Za-z0-9_-]+")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits, null where none does. A tie goes to the
    longer host, then to the rule string that sorts first."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[0] + r[1]))
    name = verdict = F.lit(None).cast("string")
    for h, p, v in reversed(ordered):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def url_tokens(url: str | None) -> list[str]:
    """Distinct tokens of a URL, tagged by place: scheme, host labels and suffixes, path words, file
    ending, query keys and values, fragment. Numbers become ``#``."""
    url = (url or "").lower()
    scheme, found, rest = url.partition("://")
    if not found:
        scheme, rest = "", url
    rest, _, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    out = {f"s={scheme}"} if scheme else set()
    labels = host.split(".") if host else []
    out |= {f"h={x}" for x in labels} | {"d=" + ".".join(labels[-n:]) for n in range(1, len(labels) + 1)}
    out |= {f"w={x}" for label in labels for x in label.split("-") if "-" in label}
    plain = lambda x: "#" if x.isdigit() else x
    out |= {f"p={plain(x)}" for x in _PARTS.findall(path)}
    out |= {f"q={plain(x)}" for x in _PARTS.findall(query)} | {f"f={plain(x)}" for x in _PARTS.findall(fragment)}
    if slash and path.endswith("/"):
        out.add("end=/")
    return sorted(out)


def mine(labelled: DataFrame, support: float = 0.002, confidence: float = 0.5, lift: float = 1.2, errors: float = 3.0, least_rows: int = 12) -> list[tuple[frozenset[str], float]]:
    """Rules ``tokens -> bad``, the smallest that hold, with their confidence, by FP-growth.

    ``labelled`` has ``url`` and ``bad`` (boolean); null labels teach nothing. A rule holds with this support
    (its bad pages over all pages, and ``least_rows`` of them), this confidence and a confidence that is, less
    ``errors`` standard errors of a share of so many pages, ``lift`` times the share of bad pages or more. So
    chance patterns don't block, whatever the base rate is. Token sets have any length; of rules that hold, those
    that contain another are dropped. Tokens that are on the same pages only count as one item, which
    keeps the sets few. Their number is bounded by the support, not by the rows.
    """
    known = labelled.where(F.col("bad").isNotNull()).select("url", "bad")
    known = written(known.mapInArrow(_tokenised, "items array<string>, bad boolean"), "url-tokens")
    total, bad = known.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    if bad < least_rows:
        return []
    need = max(least_rows, ceil(support * total - 1e-9))
    same = _equivalent(known, need)
    if not same:
        return []
    stands_for = known.sparkSession.sparkContext.broadcast(same)

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = stands_for.value
        for b in batches:
            got = [sorted({of[t] for t in some if t in of}) + [BAD] * sign for some, sign in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.string()))], ["items"])

    baskets = known.mapInArrow(items, "items array<string>")
    model = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / total, minConfidence=confidence).fit(baskets)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BAD))
    pages = F.round(F.col("support") / F.col("confidence") * total)  # on which the tokens are
    sure = F.col("confidence") - errors * F.sqrt(F.col("confidence") * (1 - F.col("confidence")) / pages)
    found = found.where(sure >= lift * bad / total).select("antecedent", "confidence").collect()
    rules: list[tuple[frozenset[str], float]] = []
    kept: list[frozenset[str]] = []
    for r in sorted(found, key=lambda r: (len(r.antecedent), sorted(r.antecedent))):
        tokens = frozenset(r.antecedent)
        if not any(k <= tokens for k in kept):
            kept.append(tokens)
            rules.append((tokens, r.confidence))
    return rules


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([url_tokens(u) for u in b.column(0).to_pylist()], pa.list_(pa.string())), b.column(1)], ["items", "bad"])


def _equivalent(known: DataFrame, need: int) -> dict[str, str]:
    """Tokens on ``need`` bad pages at least (so their number is bounded by tokens of a URL / support), each
    with the one that stands for all on exactly the same pages: the least of equal sums of page hashes."""
    once = known.withColumn("page", F.monotonically_increasing_id()).select(F.explode("items").alias("t"), F.xxhash64("page").cast("decimal(38,0)").alias("h"), F.col("bad").cast("long").alias("b"))
    found = once.groupBy("t").agg(F.sum("h").alias("h"), F.count("*").alias("n"), F.sum("b").alias("b")).where(F.col("b") >= need).select("t", "h", "n").collect()
    least: dict[tuple, str] = {}
    for r in sorted(found, key=lambda r: r.t):
        least.setdefault((r.h, r.n), r.t)
    return {r.t: least[r.h, r.n] for r in found}


def inverted_index(rules: list[tuple[frozenset[str], float]]) -> dict[str, list[int]]:
    """token -> numbers of the rules filed under it; a rule is filed under its token in fewest rules."""
    uses: dict[str, int] = defaultdict(int)
    for tokens, _ in rules:
        for t in tokens:
            uses[t] += 1
    index: dict[str, list[int]] = defaultdict(list)
    for k, (tokens, _) in enumerate(rules):
        index[min(tokens, key=lambda t: (uses[t], t))].append(k)
    return dict(index)


def fitting(tokens: set[str], sets: list[frozenset[str]], index: dict[str, list[int]]) -> list[int]:
    return [k for t in tokens if t in index for k in index[t] if sets[k] <= tokens]


def judge(pages: DataFrame, rules: list[tuple[frozenset[str], float]]) -> DataFrame:
    """``page_id, host, path, rule, verdict, confidence`` of each row; no shuffle.

    A host rule decides first; else the page is blocked if a mined rule fits, and allowed if none does.
    Null and malformed URLs have empty host and path and are allowed; null ids, repeated rows and
    further columns pass; an empty table gives no rows.
    """
    id_type = pages.schema["page_id"].dataType.simpleString()
    sets = [s for s, _ in rules]
    # as many rules as support and confidence leave, see mine()
    shared = pages.sparkSession.sparkContext.broadcast((sets, [c for _, c in rules], inverted_index(rules)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, sure, index = shared.value
        for b in batches:
            got = [max((sure[k] for k in fitting(set(url_tokens(u)), sets, index)), default=None) if sets else None for u in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), b.column(5), pa.array(got, pa.float64())], ["page_id", "host", "path", "rule", "decided", "confidence"])

    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "url")
    rule, verdict = host_rule(F.col("host"), F.col("path"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), "url", verdict.alias("decided"))
    out = rows.mapInArrow(run, f"page_id {id_type}, host string, path string, rule string, decided string, confidence double")
    return out.select("page_id", "host", "path", "rule", F.coalesce("decided", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence")


def labels_of_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url, bad``: a page carries the number of its document at the end of its path; its label is bad
    where the document is labelled low in quality or toxic."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    number = F.expr("try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) as bigint)")
    numbered = pages.select("url", path_of(F.col("url")).alias("path")).select("url", number.alias("doc_id")).where("doc_id is not null")
    return numbered.join(marks, "doc_id").select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
