"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a text with at most k edits leaves one of its k + 1 pieces unharmed: exact hits
of pieces (one automaton over all pieces) give candidates, and Myers' bit-parallel algorithm verifies.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlow.llm.common import slices

SLICE = 1000  # texts that are Python objects at a time


def normal(text: str | None) -> str:
    """Lower case, each run of white space one space."""
    return " ".join(text.lower().split()) if text else ""


def pieces(text: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of near equal length, with their places."""
    n = errors + 1
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern_masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of the pattern to any substring of ``text`` and where that first ends (one
    past), if it is at most ``most``. One column of the matrix is two integers of m bits."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = (score, 0) if score <= most else None
    get = pattern_masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    """An automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[object, str]], error_rate: float, min_chars: int):
        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            k = int(len(text) * error_rate) if len(text) >= min_chars else 0
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            number = len(self.items)
            self.items.append((item_id, text, k, masks))
            for at, piece in pieces(text, k):
                found.setdefault(piece, []).append((number, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item, distance, budget, one past its end in the normalised text): the best place of each item."""
        if not self.any:
            return []
        text = normal(text)
        spots: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for number, at in where:
                _, item, k, _ = self.items[number]
                start = end + 1 - size - at
                lo, hi = max(0, start - k), start + len(item) + k
                spans = spots.setdefault(number, [])
                if spans and lo <= spans[-1][1] and hi >= spans[-1][0]:
                    spans[-1] = (min(lo, spans[-1][0]), max(hi, spans[-1][1]))
                else:
                    spans.append((lo, hi))
        out = []
        for number, spans in spots.items():
            item_id, item, k, masks = self.items[number]
            best = None
            for lo, hi in spans:
                window = text[lo:hi]
                if (at := window.find(item)) >= 0:
                    got = (0, at + len(item))
                elif len(window) >= len(item) - k:
                    got = myers(masks, len(item), window, k)
                else:
                    got = None
                if got and (best is None or (got[0], lo + got[1]) < best):
                    best = (got[0], lo + got[1])
            if best:
                out.append((item_id, best[0], k, best[1]))
        return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.05, min_chars: int = 20, block_bytes: int = 32_000_000) -> DataFrame:
    """``doc_id, item_id, distance, budget, end`` for each item that a whole text holds with at most
    ``error_rate`` edits a character (items under ``min_chars``: exactly); the best place of each item.

    Items are broadcast in blocks of at most ``block_bytes`` of text, a pass over the documents for each
    block, so any size of benchmark works. Texts are compared in lower case with single spaces. Null
    and empty texts or items match nothing; null ids, repeated rows and further columns pass; empty
    tables give no rows.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, distance int, budget int, end int"
    outs = []
    for shared in _blocks(spark, benchmark, error_rate, min_chars, block_bytes):
        outs.append(docs.select("doc_id", "text").mapInArrow(lambda batches, shared=shared: _match(batches, shared), schema))
    out = outs[0]
    for more in outs[1:]:
        out = out.unionByName(more)
    return out


_MATCHERS: dict[int, Matcher] = {}


def _matcher(shared) -> Matcher:
    """The automaton of a broadcast block, built once in a worker."""
    items, rate, least = shared.value
    key = hash((rate, least, tuple(items)))
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, rate, least)
    return _MATCHERS[key]


def _blocks(spark: SparkSession, benchmark: DataFrame, error_rate: float, min_chars: int, block_bytes: int) -> Iterator:
    """Broadcasts of distinct items, of about ``block_bytes`` of text each."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        items = [(r.item_id, r.text) for r in benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text").distinct().collect()]
        yield spark.sparkContext.broadcast((items, error_rate, min_chars))


def _match(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    matcher = _matcher(shared)
    for b in slices(batches, SLICE):
        rows = [(i, found) for i, t in enumerate(b.column(1).to_pylist()) if t for found in matcher.find(t)]
        yield pa.RecordBatch.from_arrays([
            b.column(0).take(pa.array([i for i, _ in rows], pa.int64())),
            *(pa.array([f[k] for _, f in rows], kind) for k, kind in ((0, None), (1, pa.int32()), (2, pa.int32()), (3, pa.int32()))),
        ], ["doc_id", "item_id", "distance", "budget", "end"]) if rows else pa.RecordBatch.from_arrays([b.column(0).slice(0, 0), pa.array([], pa.int64()), *[pa.array([], pa.int32())] * 3], ["doc_id", "item_id", "distance", "budget", "end"])


def drop_leaked(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.05, min_chars: int = 20, block_bytes: int = 32_000_000, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no benchmark item, as ``find_leaks`` finds them.

    An item of a few characters is held by almost any text, also inside words, so it drops nearly all: leave such items
    out of the benchmark. Null and empty texts hold nothing and stay; null ids, repeated rows and further columns
    pass; without items all rows stay, an empty table gives no rows.
    """
    at = docs.columns.index(text_col)
    schema = docs.schema
    for shared in _blocks(docs.sparkSession, benchmark, error_rate, min_chars, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared)
            for b in slices(batches, SLICE):
                yield b.filter(pa.array([not (t and matcher.find(t)) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
