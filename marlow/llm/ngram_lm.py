"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model of any order.

Counted in Spark, stored as sorted hash arrays in the shared folder, mapped into memory by the workers.

* Vocabulary: 64-bit hashes of words, dealt to buckets by their high bits, each a sorted array with
  counts beside it. A word's id is its place in the order of all hashes.
* N-grams of the full order are counted as rows of ids and dealt to buckets by a hash of their context (all but
  the last word). A bucket writes two tables: counts by n-gram, and sums by context (its total, and how many
  followers were seen once, twice, more often). It sends on the distinct n-grams without their first word,
  with the number of words that precede them: these are what the next lower order counts, and so on.
* By id, in ranges of ids: how many distinct words come before a word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlow.llm.common import Mapped, Numbering, bucket_path, buckets_for, by_bucket, id_remainder, local_path, runs, scratch, utf8, write_file

END = b"\n"  # no word holds white space
RANGE = 1 << 17  # ids in a dense file
CHUNK_TEXTS, CHUNK_BYTES, COUNT_BYTES = 2000, 6_000_000, 4_000_000
FLUSH_KEYS, FLUSH_WORDS = 2_000_000, 500_000
SUMS, SUM_GROUP = 256, 1 << 30  # groups in which sums of all buckets travel, and the number of the first
ESCAPE = 255


def tokens_of(raw: bytes) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    out = raw.lower().split()
    out.append(END)
    return out


def chunks(batches: Iterator[pa.RecordBatch], column: int, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with their texts: at most CHUNK_TEXTS, of at most ``most`` bytes; a longer text is alone."""
    for b in batches:
        at = 0
        raws = utf8(b.column(column))
        while at < len(raws):
            n, size = 0, 0
            while at + n < len(raws) and n < CHUNK_TEXTS and (not n or size + len(raws[at + n]) <= most):
                size += len(raws[at + n])
                n += 1
            yield b.slice(at, n), raws[at:at + n]
            at += n


def high_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def followed_by(prefix: np.ndarray | np.uint64, word: np.ndarray) -> np.ndarray:
    """Hash of a prefix (by its hash; 0 for none) and the id of the next word."""
    h = prefix * np.uint64(0x9E3779B97F4A7C15) + (word.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def grams(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = followed_by(h, c)
    return h


def by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, where each is first found, and the sums of their counts."""
    order = np.argsort(keys)
    s = keys[order]
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])[: len(s)]
    return s[at], order[at], np.add.reduceat(counts[order], at) if len(s) else counts


def distinct_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, where one of each is found, and the number of each key among them. (np.unique sorts
    stably for that, which takes several times as long.)"""
    order = np.argsort(keys)
    s = keys[order]
    new = np.r_[True, s[1:] != s[:-1]][: len(s)]
    back = np.empty(len(s), np.int64)
    back[order] = np.cumsum(new) - 1
    return s[new], order[new], back


def pack_columns(columns: list[np.ndarray]) -> bytes:
    """Unsigned 32-bit columns, byte by byte of equal weight, which compresses well."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns), 1)


def unpack_columns(raw: bytes, n: int) -> list[np.ndarray]:
    x = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(n, 4, -1)
    return [np.ascontiguousarray(x[i].T).view(np.uint32).reshape(-1) for i in range(n)]


def table_key(h: np.ndarray) -> np.ndarray:
    """The order of a table: by the low half of the hash, as the high bits may have chosen the bucket, then by the
    high half, mixed, so that its low bits count first."""
    return h << np.uint64(32) | ((h >> np.uint64(32)) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF))


def pack_table(h: np.ndarray, values: np.ndarray) -> bytes:
    """A sorted array of distinct hashes with a row of numbers for each: offsets by the first bits, the next 32 bits
    in order, and a byte that is the place of the row among the 255 commonest, or says that it stands apart."""
    key = table_key(h)
    order = np.argsort(key)
    key, values = key[order], values[order]
    bits = max(1, (len(key) // 16).bit_length())
    starts = np.cumsum(np.r_[0, np.bincount((key >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)]).astype(np.uint32)
    low = ((key << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    mixed = grams(list(values.T))
    _, first, code, times = np.unique(mixed, return_index=True, return_inverse=True, return_counts=True)
    common = np.argsort(-times, kind="stable")[:ESCAPE]
    rank = np.full(len(times), ESCAPE, np.uint8)
    rank[common] = np.arange(len(common))
    code = rank[code]
    apart = np.flatnonzero(code == ESCAPE)
    head = np.array([len(key), bits, values.shape[1], len(common), len(apart)], np.int64)
    parts = [head, values[first[common]].astype(np.int64), apart.astype(np.int64), values[apart].astype(np.int64), starts, low, code]
    return b"".join(np.ascontiguousarray(x).tobytes() for x in parts)


class HashTable:
    """What ``pack_table`` wrote, in a mapped file."""

    def __init__(self, raw: np.ndarray):
        n, bits, width, common, apart = raw[:40].view(np.int64).tolist()
        at = 40

        def take(dtype, count: int) -> np.ndarray:
            nonlocal at
            at, start = at + np.dtype(dtype).itemsize * count, at
            return raw[start:at].view(dtype)

        self.bits, self.width = np.uint64(bits), width
        self.common = np.zeros((ESCAPE + 1, width), np.int64)
        self.common[:common] = take(np.int64, common * width).reshape(-1, width)
        self.apart, self.rows = take(np.int64, apart), take(np.int64, apart * width).reshape(-1, width)
        self.starts, self.low, self.code = take(np.uint32, (1 << bits) + 1), take(np.uint32, n), take(np.uint8, n)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The row of each ``table_key``; zeros where it is not there. Keys in order read the file in order."""
        first = (key >> (np.uint64(64) - self.bits)).astype(np.int64)
        want = ((key << self.bits) >> np.uint64(32)).astype(np.uint32)
        lo, end = self.starts[first].astype(np.int64), self.starts[first + 1].astype(np.int64)
        hi = end.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.low[mid] < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        out = np.zeros((len(key), self.width), np.int64)
        hit = np.flatnonzero(lo < end)
        hit = hit[self.low[lo[hit]] == want[hit]]
        code = self.code[lo[hit]]
        out[hit] = self.common[code]
        far = hit[code == ESCAPE]
        out[far] = self.rows[np.searchsorted(self.apart, lo[far])]
        return out


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of things counted 1, 2, 3, 4 times; each within [0, its count]."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)]


@dataclass
class KneserNey:
    """The model: where its arrays are, and a few sums."""

    folder: str
    buckets: int
    order: int
    types: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # words in each vocabulary bucket
    vocabulary: int = 0
    tokens: int = 0
    bigrams: int = 0
    high: dict[int, list[float]] = field(default_factory=dict)  # discounts by order, from 2 on
    low: list[float] = field(default_factory=lambda: discounts([0, 0, 0, 0]))
    low_left: float = 1.0  # share of the unigram mass that the uniform distribution gets

    def reader(self) -> Reader:
        return Reader(self)

    def path(self, kind: str, number: int) -> str:
        return bucket_path(f"{self.folder}/{kind}", number)


class Reader:
    """Looks words and n-grams up in the mapped arrays of a model."""

    def __init__(self, model: KneserNey):
        self.m = model
        self.mapped = Mapped()
        self.offsets = np.cumsum(model.types) - model.types

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: unknown) and count of each word."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        order = np.argsort(h, kind="stable")
        s = h[order]
        ids, counts = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        for b, some in runs(high_bucket(s, self.m.buckets)):
            if not self.m.vocabulary or not self.m.types[b]:
                continue
            table = self.mapped(self.m.path("v", b), np.uint64)
            table, times = table[: len(table) // 2], table[len(table) // 2:]
            at = np.minimum(np.searchsorted(table, s[some]), len(table) - 1)
            hit = table[at] == s[some]
            ids[order[some]] = np.where(hit, at + self.offsets[b], -1)
            counts[order[some]] = np.where(hit, times[at], 0)
        return ids, counts

    def preceded(self, ids: np.ndarray) -> np.ndarray:
        """How many distinct words come before each; 0 for id -1."""
        out = np.zeros(len(ids), np.int64)
        order = np.argsort(ids, kind="stable")
        s = ids[order]
        known = int(np.searchsorted(s, 0))
        for r, some in runs(s[known:] // RANGE):
            out[order[known:][some]] = self.mapped(self.m.path("suffix", r), np.int64)[s[known:][some] - r * RANGE]
        return out

    def rows(self, kind: str, h: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a table for the distinct hashes (zeros where one is not there), and the number of each hash among
        them; the hashes ``place`` choose the bucket."""
        distinct, first, back = distinct_of(table_key(h))
        b = high_bucket(place[first], self.m.buckets)
        order = np.argsort(b, kind="stable")
        found = np.zeros((len(distinct), width), np.int64)
        for i, some in runs(b[order]):
            found[order[some]] = HashTable(self.mapped(self.m.path(kind, i), np.uint8)).find(distinct[order[some]])
        return found, back

    def columns(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Lengths of the texts, local numbers of tokens, counts by number, and the ids of each token and of the words
        before it, farthest first (-1: unknown); the start of a text is a word of its own."""
        number = Numbering()
        lengths = np.array([len(x) for x in lists])
        local = np.fromiter(map(number.__getitem__, chain.from_iterable(lists)), np.int64, int(lengths.sum()))
        ids, counts = self.words(list(number))
        before = self.m.order - 1
        at = np.arange(len(local)) + before * (1 + np.repeat(np.arange(len(lists)), lengths))
        padded = np.full(len(local) + before * len(lists), self.m.vocabulary, np.int64)
        padded[at] = ids[local]
        return lengths, local, np.c_[ids, counts], [padded[at - before + k] for k in range(self.m.order)]

    def score(self, raws: list[bytes]) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, base score, score."""
        m = self.m
        lengths, local, known, columns = self.columns([tokens_of(r) for r in raws])
        ids, counts = known.T
        starts = np.cumsum(lengths) - lengths
        base = np.log10((counts + 0.5) / (m.tokens + 0.5 * (m.vocabulary + 1)))
        preceded = self.preceded(ids)
        low = np.array([0, *m.low])
        p = (np.maximum(preceded - low[np.minimum(preceded, 3)], 0) / max(1, m.bigrams) + m.low_left / (m.vocabulary + 1))[local]
        for k in range(2, m.order + 1):
            if not m.vocabulary:
                break
            context, word = columns[m.order - k:-1], columns[-1]
            usable = np.flatnonzero(np.all([c >= 0 for c in context], 0))
            h = grams([c[usable] for c in context])
            d = np.array([0, *m.high[k]])
            found, back = self.rows(f"c{k}", h, h, 4)
            share = (found[:, 1:] @ d[1:]) / np.maximum(found[:, 0], 1)
            total, left, paid = (np.zeros(len(p)) for _ in range(3))
            total[usable], left[usable] = found[back, 0], share[back]
            known = word[usable] >= 0
            found, back = self.rows(f"n{k}", followed_by(h[known], word[usable][known]), h[known], 1)
            paid[usable[known]] = np.maximum(found[:, 0] - d[np.minimum(found[:, 0], 3)], 0)[back]
            p = np.where(total > 0, paid / np.maximum(total, 1) + left * p, p)
        return lengths, np.add.reduceat((ids[local] >= 0).astype(np.int64), starts), np.add.reduceat(base[local], starts), np.add.reduceat(np.log10(p), starts)


def blobs(bucket: np.ndarray, columns: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    """Buckets, and for each a blob of its part of the columns (by the first of them, which then compresses best)."""
    order = np.lexsort((columns[0], bucket))
    columns = [c[order] for c in columns]
    parts = list(runs(bucket[order]))
    return [b for b, _ in parts], [pack_columns([c[some] for c in columns]) for _, some in parts]


def train(docs: DataFrame, order: int = 3, hold_out: tuple[int, int] = (5, 1)) -> KneserNey:
    """Count over all texts whose id remainder is not held out; null texts count as empty (an end alone).

    ``order`` is 2 or more. Each task sends distinct n-grams with their counts, so a common word or n-gram
    reaches a bucket once for each task. The number of buckets grows with the input; every bucket of every table has
    a file, so one that is missing is an error. Sums that come to the driver: a row a vocabulary bucket.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    folder = local_path(scratch(spark, "lm"))
    rows = docs.where(id_remainder(F.col("doc_id"), hold_out[0]) != hold_out[1]).select("text")
    buckets = buckets_for(docs, 20.0)
    model = KneserNey(folder, buckets, order)
    path = model.path

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = Counter()

        def flush() -> pa.RecordBatch:
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, counter), np.uint64, len(counter))
            h, _, n = by_key(h, np.fromiter(counter.values(), np.int64, len(counter)))
            parts = list(runs(high_bucket(h, buckets)))
            return pa.RecordBatch.from_arrays([
                pa.array([b for b, _ in parts], pa.int32()), pa.array([h[s].tobytes() for _, s in parts], pa.binary()), pa.array([n[s].tobytes() for _, s in parts], pa.binary()),
            ], ["bucket", "h", "n"])

        for _, raws in chunks(batches, 0):
            for raw in raws:
                counter.update(tokens_of(raw))
            if len(counter) > FLUSH_WORDS:
                yield flush()
                counter.clear()
        if counter:
            yield flush()

    def merge_words(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        h, n = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("h", np.uint64), ("n", np.int64)))
        h, _, n = by_key(h, n)
        write_file(path("v", b), h.tobytes() + n.astype(np.uint64).tobytes())
        return pa.table({"b": pa.array([b], pa.int32()), "types": pa.array([len(h)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})

    got = by_bucket(rows.mapInArrow(count_words, "bucket int, h binary, n binary"), buckets).applyInArrow(merge_words, "b int, types long, tokens long").collect()
    model.types = np.zeros(buckets, np.int64)
    for r in got:
        model.types[r.b] = r.types
    model.vocabulary, model.tokens = int(model.types.sum()), sum(r.tokens for r in got)
    if not model.vocabulary:
        return model
    shared = spark.sparkContext.broadcast(model)

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = shared.value.reader()
        held: list[list[np.ndarray]] = [[] for _ in range(order + 2)]  # hashes, ids of each place, counts
        size = 0

        def taken(k: int) -> np.ndarray:
            out = np.concatenate(held[k])
            held[k].clear()
            return out

        def flush() -> pa.RecordBatch:
            _, first, n = by_key(taken(0), taken(order + 1))
            columns = [taken(k)[first] for k in range(1, order + 1)]
            parts, packed = blobs(high_bucket(grams(columns[:-1]), buckets), [*columns, n])
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(packed, pa.binary()), pa.nulls(len(parts), pa.list_(pa.int64()))], ["bucket", "grams", "kinds"])

        for _, raws in chunks(batches, 0, COUNT_BYTES):
            columns = reader.columns([tokens_of(r) for r in raws])[3]
            h = grams(columns)
            h, first, n = by_key(h, np.ones(len(h), np.int64))
            for one, new in zip(held, (h, *(c[first].astype(np.uint32) for c in columns), n.astype(np.uint32)), strict=True):
                one.append(new)
            size += len(h)
            if size > FLUSH_KEYS:
                yield flush()
                size = 0
        if size:
            yield flush()

    def summed(table: pa.Table) -> list[list[int]]:
        """Sums of all buckets that travel along: [order, things counted once, twice, 3, 4 times]."""
        sums: dict[int, np.ndarray] = {}
        for k, *n in (x for x in table.column("kinds").to_pylist() if x):
            sums[k] = sums.get(k, 0) + np.array(n, np.int64)
        return [[k, *n.tolist()] for k, n in sums.items()]

    def merge_of(k: int):
        """Tables of order ``k``; what is sent on is dealt to buckets of contexts, or of ids at the end."""

        def merge(table: pa.Table) -> pa.Table:
            b = table.column("bucket")[0].as_py()
            if b >= SUM_GROUP:
                sums = summed(table)
                return pa.table({"bucket": pa.array([b] * len(sums), pa.int32()), "grams": pa.nulls(len(sums), pa.binary()), "kinds": pa.array(sums, pa.list_(pa.int64()))})
            found = [unpack_columns(x, k + 1) for x in table.column("grams").to_pylist() if x]
            *columns, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.uint32)] * (k + 1)
            h, first, n = by_key(grams(columns), n.astype(np.int64))
            columns = [c[first] for c in columns]
            write_file(path(f"n{k}", b), pack_table(h, n[:, None]))
            context = grams(columns[:-1])
            by_context = np.argsort(context)
            c, m = context[by_context], n[by_context]
            at = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])[: len(c)]
            sums = np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (m, m == 1, m == 2, m > 2)], 1) if len(c) else np.zeros((0, 4), np.int64)
            write_file(path(f"c{k}", b), pack_table(c[at], sums))
            rest = columns[1:]
            _, first, times = by_key(grams(rest), np.ones(len(n), np.int64))
            rest = [x[first] for x in rest]
            to = high_bucket(grams(rest[:-1]), buckets) if k > 2 else rest[0].astype(np.int64) // RANGE
            parts, packed = blobs(to, [*rest, times])
            if k > 2:  # the bucket of the same number, if only to write empty tables
                parts, packed = [*parts, b], [*packed, None]
            kinds = [k, *(int((n == i).sum()) for i in (1, 2, 3, 4))]
            return pa.table({
                "bucket": pa.array([*parts, SUM_GROUP + b % SUMS], pa.int32()), "grams": pa.array([*packed, None], pa.binary()),
                "kinds": pa.array([*[None] * len(parts), kinds], pa.list_(pa.int64())),
            })

        return merge

    def merge_ids(table: pa.Table) -> pa.Table:
        r = table.column("bucket")[0].as_py()
        if r >= SUM_GROUP:
            sums = summed(table)
        else:
            preceded = np.zeros(min(RANGE, model.vocabulary - r * RANGE), np.int64)
            for x in table.column("grams").to_pylist():
                ids, times = unpack_columns(x, 2)  # ids are distinct in a blob
                preceded[ids.astype(np.int64) - r * RANGE] += times
            write_file(path("suffix", r), preceded.tobytes())
            sums = [[1, *(int((preceded == i).sum()) for i in (1, 2, 3, 4)), int((preceded > 2).sum()), int(preceded.sum())]]
        return pa.table({"kinds": pa.array(sums, pa.list_(pa.int64()))})

    link = "bucket int, grams binary, kinds array<long>"
    every = spark.range(0, buckets, 1, min(buckets, spark.sparkContext.defaultParallelism)).selectExpr("cast(id as int) as bucket", "cast(null as binary) as grams", "cast(null as array<long>) as kinds")
    level = rows.mapInArrow(count_grams, link).union(every)
    for k in range(order, 1, -1):
        level = by_bucket(level, buckets).applyInArrow(merge_of(k), link)
    ranges = -(-model.vocabulary // RANGE)
    sums: dict[int, np.ndarray] = {}
    for row in by_bucket(level, max(ranges, min(buckets, SUMS))).applyInArrow(merge_ids, "kinds array<long>").collect():
        k, *n = row.kinds
        sums[k] = sums.get(k, 0) + np.array(n, np.int64)
    model.high = {k: discounts(sums[k].tolist()) for k in range(2, order + 1)}
    *low, more, model.bigrams = sums[1].tolist()
    model.low = discounts(low)
    model.low_left = float(np.dot(model.low, [low[0], low[1], more])) / max(1, model.bigrams)
    return model


def score(docs: DataFrame, model: KneserNey, hold_out: tuple[int, int] = (5, 1)) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row; no shuffle.

    Whole texts; a null or empty text is one end token. A word that training has not seen gets its share
    of the uniform distribution. Null ids (they train as the empty id), repeated rows and further columns
    pass; an empty table gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = shared.value.reader()
        for part, raws in chunks(batches, 1):
            n, known, base, total = reader.score(raws)
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                pa.array([reader.m.tokens] * len(raws), pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64()),
            ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    held = (id_remainder(F.col("doc_id"), hold_out[0]) == hold_out[1]).alias("held_out")
    return docs.select("doc_id", "text", held).mapInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
