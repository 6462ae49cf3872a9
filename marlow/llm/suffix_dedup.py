"""Removal of repeated passages by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``threshold`` tokens, by passes over digits from the most significant
on; a suffix that is alone in its group is left out of later passes, and groups that are equal after the
last pass are exactly the repeated windows. The first digit is one that deals windows out evenly and
lets almost all unique ones go before any text moves: the window's anchor, the smallest hash of a gram
of half the threshold in it. Equal windows have the same anchor at the same place, and neighbouring
windows share one, so a run of windows travels as one piece of text.

1. Each task lists the hashes of its anchors; buckets of hashes find those of two documents or more,
   written as sorted arrays to the shared folder.
2. Each task maps those arrays into memory, keeps the runs whose anchor is in them, merges equal runs
   (the smallest document stands for them) and deals them out by anchor.
   Windows of an anchor that very many texts hold go one by one, by their own hash.
3. A bucket settles anchors with one distinct run at once and sorts the windows of the others.
4. Removed spans meet their documents in a join by id.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlow.llm.common import Mapped, bucket_path, buckets_for, by_bucket, fresh, local_path, runs, scratch, slices, utf8, write_file

CHUNK = 1 << 19  # tokens that are hashed at a time
POS_BITS = 24
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BASE = 0x9E3779B97F4A7C15
CACHE_WORDS = 200_000


def power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def tokenizer(unit: str) -> Callable[[bytes], np.ndarray]:
    """Text -> token array: the bytes themselves, or a 64-bit hash of each word."""
    if unit == "bytes":
        return lambda raw: np.frombuffer(raw, np.uint8)
    hashes = _WordHashes()

    def words(raw: bytes) -> np.ndarray:
        some = raw.split()
        return np.fromiter(map(hashes.__getitem__, some), np.uint64, len(some))

    return words


def gram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of each k tokens, by doubling."""
    h = tokens.astype(np.uint64) + np.uint64(1)
    out, have, size = None, 0, 1
    rest = k
    n = len(tokens) - k + 1
    while True:
        if rest & 1:
            part = h[have:have + n]
            out = part.copy() if out is None else out * power(size) + part
            have += size
        rest >>= 1
        if not rest:
            break
        h = h[:-size] * power(size) + h[size:]
        size *= 2
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    return out


def runs_of(tokens: np.ndarray, lengths: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor, over texts that lie behind each other in ``tokens``:
    anchor hash (48 bits), text number, first window in ``tokens``, number of windows, how far the anchor
    is after the first window, first window in its text."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    k = max(1, threshold // 2)
    w = threshold - k + 1
    if len(tokens) < threshold:
        return none
    h = gram_hashes(tokens, k)
    v = (h >> np.uint64(POS_BITS) << np.uint64(POS_BITS)) | np.arange(len(h), dtype=np.uint64)
    m = 1
    while 2 * m <= w:
        v = np.minimum(v[:-m], v[m:])
        m *= 2
    if m < w:
        v = np.minimum(v[: len(v) - (w - m)], v[w - m:])
    anchor = (v & np.uint64((1 << POS_BITS) - 1)).astype(np.int64)
    ends = np.cumsum(lengths)
    n = len(anchor)
    text = np.repeat(np.arange(len(lengths)), lengths)[:n]
    anchor[np.arange(n) + threshold > ends[text]] = -1
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    count = np.diff(np.r_[first, n])
    live = anchor[first] >= 0
    first, count = first[live], count[live]
    at = anchor[first]
    number = text[first]
    # the smallest hashes are all small: mixed again, they spread over the buckets
    x = h[at]
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x ^ (x >> np.uint64(33))) >> np.uint64(16), number, first, count, at - first, first - (ends - lengths)[number]


def chunks(raws: list[bytes], tokens_of: Callable[[bytes], np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Texts in groups of about CHUNK tokens; a longer text is alone (and whole)."""
    held, size, start = [], 0, 0
    for i, raw in enumerate(raws):
        t = tokens_of(raw)
        if held and size + len(t) > CHUNK:
            yield start, held
            held, size, start = [], 0, i
        held.append(t)
        size += len(t)
    if held:
        yield start, held


def batch_runs(raws: list[bytes], tokens_of, threshold: int) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
    """For each chunk: number of its first text, the tokens, the runs. Texts of over 2**POS_BITS tokens
    are cut into pieces that overlap by threshold - 1 tokens, so that no window is lost."""
    for start, held in chunks(raws, tokens_of):
        limit = (1 << POS_BITS) - 1
        if len(held) == 1 and len(held[0]) > limit:
            t = held[0]
            for a in range(0, len(t) - threshold + 1, limit - threshold + 1):
                piece = t[a:a + limit]
                h, number, first, count, at, local = runs_of(piece, np.array([len(piece)]), threshold)
                yield start, t, (h, number, first + a, count, at, local + a)
        else:
            t = np.concatenate(held)
            yield start, t, runs_of(t, np.array([len(x) for x in held]), threshold)


def six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h, np.uint64).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unsix(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).reshape(-1)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)


SLICE = 1000
FLUSH_ANCHORS = 2_000_000
FLUSH_RUNS = 200_000
FLUSH_BYTES = 40_000_000
#: Texts with one anchor from which its windows are dealt out one by one, by their own hash.
CROWDED = 10_000


def hot_anchors(rows: DataFrame, folder: str, unit: str, threshold: int, buckets: int, crowd: int = CROWDED) -> None:
    """Writes, for each bucket, the sorted hashes of anchors that two texts or more hold, and of those
    that more than ``crowd`` hold."""

    def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = tokenizer(unit)
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        base = size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, doc = (np.concatenate(x) for x in zip(*kept, strict=True))
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
            h = h[new]
            at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            texts = np.diff(np.r_[at, len(h)]).astype(np.uint32)
            h, shared = h[at], texts > 1
            parts = list(runs(bucket_of(h, buckets)))
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _ in parts], pa.int32()),
                pa.array([six(h[s][~shared[s]]) for _, s in parts], pa.binary()),
                pa.array([six(h[s][shared[s]]) for _, s in parts], pa.binary()),
                pa.array([texts[s][shared[s]].tobytes() for _, s in parts], pa.binary()),
            ], ["bucket", "one", "more", "texts"])

        for part in slices(batches, SLICE):
            for start, _, (h, number, *_) in batch_runs(utf8(part.column(0)), tokens_of, threshold):
                if len(h):
                    kept.append((h, number + (base + start)))
                    size += len(h)
            base += part.num_rows
            if size > FLUSH_ANCHORS:
                yield from flush()
                kept, size = [], 0
        if size:
            yield from flush()

    def merge(table: pa.Table) -> pa.Table:
        one = [unsix(x) for x in table.column("one").to_pylist()]
        every = np.concatenate([*one, *(unsix(x) for x in table.column("more").to_pylist())])
        texts = np.concatenate([np.ones(sum(map(len, one)), np.int64), *(np.frombuffer(x, np.uint32).astype(np.int64) for x in table.column("texts").to_pylist())])
        order = np.argsort(every, kind="stable")
        every, texts = every[order], texts[order]
        at = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        texts = np.add.reduceat(texts, at)
        hot, crowded = every[at][texts > 1], every[at][texts > crowd]
        write_file(bucket_path(folder, table.column("bucket")[0].as_py()), np.r_[np.array([len(hot)], np.uint64), hot, crowded].tobytes())
        return pa.table({"n": pa.array([len(hot)], pa.int64())})

    listed = rows.select("text").mapInArrow(list_anchors, "bucket int, one binary, more binary, texts binary")
    by_bucket(listed, buckets).applyInArrow(merge, "n long").agg(F.sum("n")).collect()


class HotAnchors:
    """The sorted arrays, mapped into memory as they are asked for. Every anchor of the texts has been dealt to a
    bucket and every bucket has a file, so one that is missing is an error."""

    def __init__(self, folder: str, buckets: int):
        self.folder, self.buckets, self.mapped = folder, buckets, Mapped()

    def among(self, h: np.ndarray) -> np.ndarray:
        """0, 1 for hot, 2 for crowded hashes."""
        values, back = np.unique(h, return_inverse=True)
        out = np.zeros(len(values), np.int8)
        for i, some in runs(bucket_of(values, self.buckets)):
            table = self.mapped(bucket_path(self.folder, i), np.uint64)
            hot = int(table[0])
            for part in (table[1:1 + hot], table[1 + hot:]):
                if len(part):
                    out[some] += part[np.minimum(np.searchsorted(part, values[some]), len(part) - 1)] == values[some]
        return out[back]


def pack(x) -> bytes:
    return zstandard.compress(pickle.dumps(x, 5), 1)


def unpack(raw: bytes):
    return pickle.loads(zstandard.decompress(raw))


def hot_runs(rows: DataFrame, folder: str, unit: str, threshold: int, buckets: int) -> DataFrame:
    """``bucket, payload, spans``: the distinct hot runs of a task with the smallest document that has each, by
    buckets of anchors, and spans that are already known to repeat a smaller document of the same task, merged,
    by buckets of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = tokenizer(unit)
        hot = HotAnchors(folder, buckets)
        seen: dict[bytes, list] = {}
        gone: list[tuple[int, int, int, int]] = []
        held = [0]

        def add(x: int, piece: bytes, doc: int, key: int, s: int, c: int, a: int) -> None:
            entry = seen.get(piece)
            if entry is None:
                seen[piece] = [x, doc, a, [(key, s)]]
                held[0] += len(piece)
            elif doc > entry[1]:
                gone.append((doc, key, s, s + c + threshold - 1))
            elif doc == entry[1]:
                entry[3].append((key, s))
            else:
                gone.extend((entry[1], k, t, t + c + threshold - 1) for k, t in entry[3])
                entry[1], entry[3] = doc, [(key, s)]

        def flush() -> Iterator[pa.RecordBatch]:
            at: dict[int, list] = {}
            b = bucket_of(np.array([x[0] for x in seen.values()], np.uint64), buckets).tolist()
            for (piece, entry), i in zip(seen.items(), b, strict=True):
                at.setdefault(i, []).append((piece, entry))
            for i, entries in sorted(at.items()):
                payload = (
                    [p for p, _ in entries], np.array([e[0] for _, e in entries], np.uint64), np.array([e[1] for _, e in entries], np.int64),
                    [e[2] for _, e in entries], [e[3] for _, e in entries],
                )
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pack(payload)], pa.binary()), pa.array([None], pa.binary())], ["bucket", "payload", "spans"])
            if gone:
                parts, blobs = by_document(np.array(gone, np.int64), buckets)
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.nulls(len(parts), pa.binary()), pa.array(blobs, pa.binary())], ["bucket", "payload", "spans"])

        for part in slices(batches, SLICE):
            ids, keys = part.column(0).to_pylist(), part.column(1).to_pylist()
            for start, tokens, found in batch_runs(utf8(part.column(2)), tokens_of, threshold):
                if not len(found[0]):
                    continue
                kind = hot.among(found[0])
                raw, width = tokens.tobytes(), tokens.itemsize
                for x, i, f, c, a, s, k in zip(*(part[kind > 0].tolist() for part in (*found, kind)), strict=True):
                    doc, key = ids[start + i], keys[start + i]
                    if k == 1:
                        add(x, raw[f * width:(f + c + threshold - 1) * width], doc, key, s, c, a)
                        continue
                    for j in range(c):
                        window = raw[(f + j) * width:(f + j + threshold) * width]
                        add(xxhash.xxh3_64_intdigest(window) >> 16, window, doc, key, s + j, 1, 0)
                if len(seen) > FLUSH_RUNS or held[0] > FLUSH_BYTES or len(gone) > FLUSH_RUNS:
                    yield from flush()
                    seen.clear()
                    gone.clear()
                    held[0] = 0
        if seen or gone:
            yield from flush()

    return rows.mapInArrow(run, "bucket int, payload binary, spans binary")


def by_document(spans: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """Spans (document, key, first, end), merged and dealt to buckets of documents: a blob for each."""
    spans = merged(spans)
    to = bucket_of((spans[:, 0].astype(np.uint64) * np.uint64(BASE)) >> np.uint64(16), buckets)
    order = np.argsort(to, kind="stable")
    parts = list(runs(to[order]))
    return [i for i, _ in parts], [zstandard.compress(spans[order[some]].tobytes(), 1) for _, some in parts]


def equal_windows(pieces: list[bytes], group: np.ndarray, place: np.ndarray, counts: np.ndarray, smallest: np.ndarray, threshold: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Radix passes over the windows of pieces: for each piece and window (in order) the smallest document
    that has an equal one. ``group`` and ``place`` are the first digit: the anchor and where it stands."""
    text = np.frombuffer(b"".join(pieces) + b"\0" * 8, np.uint8)
    begin = np.cumsum([0, *map(len, pieces)])[:-1]
    owner = np.repeat(np.arange(len(pieces)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    best = smallest[owner].copy()
    live = np.arange(len(owner))
    level = np.unique(group[owner] << np.int64(20) | (place[owner] - inner).astype(np.int64), return_inverse=True)[1]
    at = begin[owner] + inner * width
    digits = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    size = threshold * width
    for d in [*range(0, size - 7, 8), *([size - 8] if size >= 8 and size % 8 else [])] or [None]:
        if d is None:  # shorter than a digit
            value = np.zeros(len(live), np.uint64)
            for i in range(size):
                value = value << np.uint64(8) | text[at[live] + i].astype(np.uint64)
        else:
            value = digits[at[live] + d]
        rank = np.unique(value, return_inverse=True)[1]
        level, size_of = np.unique(level.astype(np.int64) * (int(rank.max(initial=0)) + 1) + rank, return_inverse=True, return_counts=True)[1:]
        alone = size_of[level] == 1
        live, level = live[~alone], level[~alone]
        if not len(live):
            return owner, best
    order = np.argsort(level, kind="stable")
    level, live = level[order], live[order]
    cuts = np.flatnonzero(np.r_[True, level[1:] != level[:-1]])
    best[live] = np.repeat(np.minimum.reduceat(best[live], cuts), np.diff(np.r_[cuts, len(live)]))
    return owner, best


def settle(payloads: list[bytes], threshold: int, width: int) -> np.ndarray:
    """Removed spans of a bucket: rows of document, key, first token, one past the last."""
    number: dict[bytes, int] = {}
    anchors, places, counts, smallest = [], [], [], []
    holders: list[list[tuple[int, list]]] = []
    for raw in payloads:
        pieces, h, docs, place, starts = unpack(raw)
        for piece, x, doc, a, where in zip(pieces, h.tolist(), docs.tolist(), place, starts, strict=True):
            i = number.setdefault(piece, len(number))
            if i == len(anchors):
                anchors.append(x)
                places.append(a)
                counts.append(len(piece) // width - threshold + 1)
                smallest.append(doc)
                holders.append([(doc, where)])
            else:
                smallest[i] = min(smallest[i], doc)
                holders[i].append((doc, where))
    spans: list[tuple[int, int, int, int]] = []
    if number:
        ids, group, of = np.unique(np.array(anchors, np.uint64), return_inverse=True, return_counts=True)
        least, n_windows = np.array(smallest, np.int64), np.array(counts)
        for i, c in enumerate(counts):
            for doc, where in holders[i]:
                if doc > smallest[i]:
                    spans.extend((doc, k, s, s + c + threshold - 1) for k, s in where)
        mixed = np.flatnonzero(of[group] > 1)
        if len(mixed):
            every = list(number)
            owner, best = equal_windows([every[i] for i in mixed], group[mixed].astype(np.int64), np.array(places)[mixed], n_windows[mixed], least[mixed], threshold, width)
            begin = np.cumsum(n_windows[mixed]) - n_windows[mixed]
            removed = best < least[mixed][owner]
            for j in np.unique(owner[removed]).tolist():
                i = int(mixed[j])
                flags = removed[begin[j]:begin[j] + counts[i]]
                edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0])).reshape(-1, 2).tolist()
                for doc, where in holders[i]:
                    if doc == smallest[i]:
                        spans.extend((doc, k, s + a, s + b + threshold - 1) for k, s in where for a, b in edges)
    return np.array(spans, np.int64).reshape(-1, 4)


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal spans of rows (document, key, first, end), in order; spans of a text that touch are one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    # each text gets a range of 2**32 places of its own, so that one running maximum serves all
    base = np.cumsum(np.r_[0, (spans[1:, :2] != spans[:-1, :2]).any(1)]) << 32
    reach = np.maximum.accumulate(spans[:, 3] + base)
    at = np.flatnonzero(np.r_[True, spans[1:, 2] + base[1:] > reach[:-1]])
    ends = reach[np.r_[at[1:], len(spans)] - 1] - base[at]
    return np.c_[spans[at, :3], ends]


def repeated_spans(docs: DataFrame, threshold: int = 50, unit: str = "bytes", crowd: int = CROWDED) -> DataFrame:
    """``doc_id, text_key, spans``: the maximal token spans of each text that repeat a text of a smaller
    doc_id, as a blob of int32 pairs; a row for each text that has any. ``text_key`` is xxhash64 of the text."""
    spark = docs.sparkSession
    width = 1 if unit == "bytes" else 8
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    buckets = buckets_for(docs, 5.0)
    folder = local_path(scratch(spark, "anchors"))
    hot_anchors(rows, folder, unit, threshold, buckets, crowd)

    def reduce(table: pa.Table) -> pa.Table:
        """Spans of an anchor bucket, dealt to buckets of documents; what is dealt already is passed on."""
        payloads = [x for x in table.column("payload").to_pylist() if x is not None]
        parts, blobs = by_document(settle(payloads, threshold, width), buckets)
        known = [x for x in table.column("spans").to_pylist() if x is not None]
        parts += [table.column("bucket")[0].as_py()] * len(known)
        return pa.table({"part": pa.array(parts, pa.int32()), "spans": pa.array(blobs + known, pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        """All spans of the documents of a bucket, merged."""
        found = merged(np.concatenate([np.frombuffer(zstandard.decompress(x), np.int64).reshape(-1, 4) for x in table.column("spans").to_pylist()]))
        cuts = np.flatnonzero(np.r_[True, (found[1:, :2] != found[:-1, :2]).any(1)])
        ends = np.r_[cuts[1:], len(found)]
        return pa.table({
            "doc_id": pa.array(found[cuts, 0], pa.int64()), "text_key": pa.array(found[cuts, 1], pa.int64()),
            "spans": pa.array([found[a:b, 2:].astype(np.int32).tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
        })

    dealt = by_bucket(hot_runs(rows, folder, unit, threshold, buckets), buckets).applyInArrow(reduce, "part int, spans binary")
    return by_bucket(dealt, buckets, "part").applyInArrow(gather, "doc_id long, text_key long, spans binary")


def byte_spans(raw: bytes, blob: bytes | None, unit: str) -> np.ndarray:
    """Maximal removed byte spans of a text."""
    if not blob:
        return np.zeros((0, 2), np.int64)
    spans = np.frombuffer(blob, np.int32).reshape(-1, 2).astype(np.int64)
    if unit == "bytes":
        return spans
    where = [m.span() for m in WORD.finditer(raw)]
    return np.array([(where[a][0], where[b - 1][1]) for a, b in spans.tolist()], np.int64)


def without(raw: bytes, spans: np.ndarray) -> bytes:
    kept, at = [], 0
    for a, b in spans.tolist():
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept)


def with_spans(docs: DataFrame, threshold: int, unit: str, crowd: int = CROWDED) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name, which none of its columns has: a blob of spans, null if
    nothing repeats."""
    name, key, other, text_key = fresh(docs, "spans", "span_id", "span_key", "text_key")
    spans = repeated_spans(docs, threshold, unit, crowd).select(F.col("doc_id").alias(key), F.col("text_key").alias(other), F.col("spans").alias(name))
    keyed = docs.withColumn(text_key, F.xxhash64("text"))
    return keyed.join(spans, (F.col("doc_id") == F.col(key)) & (F.col(text_key) == F.col(other)), "left").select(*docs.columns, name), name


def dedup_report(docs: DataFrame, threshold: int = 50, crowd: int = CROWDED) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row.

    A byte goes if a ``threshold``-byte string over it also starts in a document of a smaller doc_id,
    judged on the input. Null text counts as empty. A null doc_id is neither smaller nor larger than
    another: its text stays whole. Rows with the same doc_id don't remove from each other; repeated rows
    get the same result. Ids are whole numbers, or texts of them; another text is an error. Further columns are not
    read; an empty table gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw, blobs in zip(utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
                spans = byte_spans(raw, blobs, "bytes")
                rows.append((len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(without(raw, spans)).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found, _ = with_spans(docs.select("doc_id", "text"), threshold, "bytes", crowd)
    return found.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, threshold: int = 50, unit: str = "words") -> DataFrame:
    """``docs``, all rows and columns, with repeated passages cut out of ``text`` (and ``n_chars``, if it is
    there, counted anew). Cut bytes that would leave half a character take its rest along.

    A null text stays null. Rows with a null doc_id stay whole, as rows of one doc_id do from each other; repeated rows are cut
    alike. Texts are judged on the input, whatever their length; an empty table gives no rows. Ids as in ``dedup_report``.
    """
    columns = docs.columns
    at = columns.index("text")
    n_chars = columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [b.column(i) for i in range(len(columns))]
            blobs = b.column(len(columns)).to_pylist()
            if any(blobs):
                texts = out[at].to_pylist()
                for i, x in enumerate(blobs):
                    if x:
                        raw = texts[i].encode("utf-8", "replace")
                        texts[i] = without(raw, byte_spans(raw, x, unit)).decode("utf-8", "ignore")
                out[at] = pa.array(texts, out[at].type)
                if n_chars is not None:
                    old = out[n_chars].to_pylist()
                    out[n_chars] = pa.array([len(t) if x else o for t, x, o in zip(texts, blobs, old, strict=True)], out[n_chars].type)
            yield pa.RecordBatch.from_arrays(out, columns)

    return with_spans(docs, threshold, unit)[0].mapInArrow(run, docs.schema)
