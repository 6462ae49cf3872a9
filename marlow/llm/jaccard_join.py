"""N-gram Jaccard join by the chosen-path method.

Each text is the set of its word shingles. A set walks down random trees: at the node with path p it takes
every token t whose hash under p is below 1 / (rate * size of the set), so similar sets take the same
tokens. Sets that meet in a small bucket are compared; a large bucket is split by the next token, as often
as it takes: until its parts are small, or until splitting no longer tells its sets apart (then they are
similar on the whole, and are compared in blocks). Each split leaves at most SPLITS of the pairs, so the
number of levels is bounded by log(pairs of the largest bucket) / log(1 / SPLITS). Trees are repeated until
the target recall, which holds at any depth.

Compared at first by 64 one-byte minima (a sketch); what may be similar is linked in stars, and connected
sets are then compared exactly, whole, in blocks. So nothing lists all pairs of a group, and every link
between two sets of a component is found, also one that no bucket showed. A group is sent in parts of some
MB, each pair of parts to one task, which compares them a block at a time: a set is sent once for each part
of its group, however many blocks that is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlow.llm.common import Mapped, bucket_path, buckets_for, by_bucket, fresh, give_back, local_path, scratch, slices, utf8, write_file, written
from marlow.llm.components import connected_components, hub_anti, hub_join, hub_semi

WORDS, SIMILAR = 5, 0.8
RATE = 0.6  # below the similarity: more tokens are taken than the threshold alone asks for
SPLITS = 0.75  # a bucket is split on while that leaves at most so much of its pairs
SMALL = 512  # sets that a bucket compares at once before it is split
ALIKE_PART = 16  # a bucket that isn't split any more is sent in parts of so many times SMALL sets (of 84 bytes each)
BLOCK = 512  # sets in a block of exact comparison
PART_BYTES, PART_SETS = 8_000_000, 4096  # of shingles, and sets, in a part of a group; a task holds two parts
SKETCH, SKETCH_LEAST = 64, 0.58  # more than four standard deviations below 0.8
TINY = 96  # sets of fewer shingles aren't judged by the sketch
CACHE_WORDS = 200_000
FLUSH_BYTES = 16_000_000


def repeats_for(recall: float, similar: float = SIMILAR, rate: float = RATE) -> int:
    """Trees after which a pair at the threshold has met with this probability, however deep the trees are."""
    miss = 0.0
    for _ in range(1000):
        miss = math.exp(-similar / rate * (1 - miss))
    return max(1, math.ceil(math.log(1 - recall) / math.log(miss)))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(raw: bytes, hashes: dict[bytes, int], n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text; a text of fewer words is one shingle, a
    text without words none."""
    words = raw.split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(w) < n:
        w = np.r_[w, np.full(n - len(w), len(w), np.uint64)]
    h = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i:len(w) - n + 1 + i]
    return np.unique(mix(h))


def set_hash(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def sketch(s: np.ndarray) -> bytes:
    """A byte of the smallest hash in each of 64 ranges; an empty range takes the next."""
    bounds = np.arange(SKETCH, dtype=np.uint64) << np.uint64(58)
    at = np.searchsorted(s, bounds)
    return (s[np.where(at < len(s), at, 0)] & np.uint64(255)).astype(np.uint8).tobytes()


def tree_roots(trees: int) -> np.ndarray:
    return mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def chosen_paths(s: np.ndarray, paths: np.ndarray, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """The paths by which the set goes on from ``paths``, and which of them each continues."""
    limit = np.uint64(min((1 << 64) - 1, int((1 << 64) / (rate * len(s)))))
    kids, parents = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    step = max(1, (1 << 20) // len(s))
    for i in range(0, len(paths), step):
        h = mix(paths[i:i + step, None] ^ s[None, :])
        row, col = np.nonzero(h < limit)
        parent = paths[i:i + step][row]
        kids.append(mix(h[row, col] + parent * np.uint64(0xA24BAED4963EE407)))
        parents.append(parent)
    return np.concatenate(kids), np.concatenate(parents)


def profile(docs: DataFrame, trees: int) -> DataFrame:
    """``doc_id, text_key, node, size, sketch, paths`` of each row: text_key is xxhash64 of the text, node the
    hash of the set (null: no words), paths those of the first level."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_key", "node", "size", "sketch", "paths"]
    roots_ = tree_roots(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for b in slices(batches, 1000):
            rows = []
            for raw in utf8(b.column(2)):
                s = shingles(raw, hashes)
                rows.append((set_hash(s), len(s), sketch(s), chosen_paths(s, roots_)[0].view(np.int64)) if len(s) else (None, 0, None, None))
            node, size, sk, paths = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(sk, pa.binary()), pa.array(paths, pa.list_(pa.int64())),
            ], names)

    schema = f"doc_id {id_type}, text_key long, node long, size int, sketch binary, paths array<long>"
    return docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(run, schema)


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches in which the rows of a group lie together."""
    held: pa.Table | None = None
    give_back()
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if not t.num_rows:
            continue
        k = [t.column(c).to_numpy() for c in keys]
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) if t.num_rows > 1 else np.zeros(0, int)
        last = int(change[-1]) + 1 if len(change) else 0
        if last:
            yield t.slice(0, last)
        held = t.slice(last).combine_chunks()
        del b, t, k
        give_back()
    if held is not None and held.num_rows:
        yield held


def cuts_of(t: pa.Table, keys: list[str]) -> np.ndarray:
    k = [t.column(c).to_numpy() for c in keys]
    return np.r_[0, np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1, t.num_rows]


def roots(near: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the smallest index of each row's component."""
    n = len(near)
    label = np.arange(n, dtype=np.int32)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], np.int32(n)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def first_alike(m: int, alike: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The smallest index of each one's component among 0 to m - 1: a member meets only those that no component
    has yet, so where all are alike each is met about once."""
    label, free = np.arange(m), np.arange(m)
    while len(free):
        first, free = free[0], free[1:]
        waiting = [first]
        while waiting and len(free):
            near = alike(np.array([waiting.pop()]), free)
            found, free = free[near], free[~near]
            label[found] = first
            waiting += found.tolist()
    return label


def bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars over sets of a bucket whose sketches and sizes allow the threshold."""
    keys = ["path", "bi", "bj"]
    for t in by_group(batches, keys):
        node, size = t.column("node").to_numpy(), t.column("size").to_numpy()
        sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        cuts = cuts_of(t, keys)
        counts = np.diff(cuts)
        u, v = [], []

        def alike(a: np.ndarray, b: np.ndarray, size=size, sk=sk) -> np.ndarray:
            fit = np.minimum(size[a], size[b]) >= SIMILAR * np.maximum(size[a], size[b])
            return fit & ((np.minimum(size[a], size[b]) < TINY) | ((sk[a] == sk[b]).sum(-1) >= SKETCH_LEAST * SKETCH))

        for m in range(2, 9):
            start = cuts[:-1][counts == m]
            for i in range(m if len(start) else 0):
                for j in range(i + 1, m):
                    ok = alike(start + i, start + j)
                    u.append(node[start[ok] + i])
                    v.append(node[start[ok] + j])
        for a, m in zip(cuts[:-1][counts > 8].tolist(), counts[counts > 8].tolist(), strict=True):
            r = first_alike(m, lambda x, y, a=a: alike(a + x, a + y))  # noqa: B023
            moved = np.flatnonzero(r != np.arange(m))
            u.append(node[a + moved])
            v.append(node[a + r[moved]])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])


def parts_of(**most: int) -> Column:
    """Parts of a group so that none has more than ``most`` of its columns' totals (on average)."""
    return F.greatest(F.lit(1), *(F.ceil(F.col(c) / m) for c, m in most.items())).cast("int")


def in_parts(rows: DataFrame, parts: Column) -> DataFrame:
    """Adds ``own, bi, bj``: the rows of a group (by ``node``) are dealt to ``parts`` parts by a hash, and each
    pair of parts meets once."""
    rows = rows.withColumn("__parts", parts).withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), F.col("__parts")).cast("int"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    return rows.withColumn("bi", F.least("own", "__other")).withColumn("bj", F.greatest("own", "__other")).drop("__parts", "__other")


def compared(members: DataFrame, sets: DataFrame, small: int) -> DataFrame:
    """Edges between alike sets of buckets (``node, path, n``), in parts of ALIKE_PART times ``small`` sets."""
    members = in_parts(members.join(sets.select("node", "size", "sketch"), "node"), parts_of(n=ALIKE_PART * small))
    dealt = members.select("path", "bi", "bj", "node", "size", "sketch").repartition("path", "bi", "bj").sortWithinPartitions("path", "bi", "bj", "node")
    return dealt.mapInArrow(bucket_edges, "u long, v long")


def candidate_edges(docs: DataFrame, sets: DataFrame, buckets: int, small: int = SMALL) -> DataFrame:
    """Edges between sets that a bucket finds alike. ``sets`` has a row for each node, ``docs`` their texts; for
    ``buckets`` see ``cut_wanted``."""
    found = []
    level = sets.select("node", F.explode("paths").alias("path"))
    while True:
        sizes = written(level.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        members = hub_join(level, sizes, ["path"])
        found.append(compared(members.where(F.col("n") <= small), sets, small))
        if sizes.where(F.col("n") > small).isEmpty():
            break
        large = written(hub_join(level, sizes.where(F.col("n") > small), ["path"]).join(sets.select("node", F.col("first_id").alias("doc_id")), "node").select("doc_id", "node", "path", "n"), "large")
        kids = written(next_paths(docs, large.drop("n"), buckets), "kids")
        # pairs that a split leaves: where they are most of a bucket's pairs, its sets are alike
        parts = kids.groupBy("parent", "path").agg(F.count("*").alias("c"))
        parts = parts.groupBy("parent").agg(F.sum(F.col("c") * F.col("c")).alias("left"), F.sum("c").alias("kids"))
        judged = sizes.where(F.col("n") > small).join(parts, F.col("path") == F.col("parent"), "left")
        stays = F.coalesce(F.col("left") > SPLITS * F.col("n") * F.col("n"), F.lit(False))
        judged = written(judged.select("path", "n", F.coalesce("kids", F.lit(0)).alias("kids"), stays.alias("alike")), "judged")
        found.append(compared(hub_join(large.select("node", "path"), judged.where("alike").select("path", "n"), ["path"]), sets, small))
        going = judged.where("not alike").select(F.col("path").alias("parent"), F.col("kids").alias("n"))
        level = written(hub_join(kids, going, ["parent"]).select("node", "path").distinct(), "level")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def next_paths(docs: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """``node, parent, path``: how each set of ``wanted`` (doc_id, node, path) goes on from its path."""

    def derive(s: np.ndarray, rows: np.ndarray) -> tuple:
        kid, parent = chosen_paths(s, rows[:, 2].astype(np.int64).view(np.uint64))
        return np.full(len(kid), rows[0, 1]), parent.view(np.int64), kid.view(np.int64)

    return cut_wanted(docs, wanted, buckets, derive, {"node": pa.int64(), "parent": pa.int64(), "path": pa.int64()}, "node long, parent long, path long")


def exact_links(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of each set within its part (pairs of two parts count across them only) and a star edge, by
    ``block`` sets at a time."""
    keys = ["root", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, keys):
            cuts = cuts_of(t, keys).tolist()
            node, own, bi, bj = (t.column(c).to_numpy() for c in ("node", "own", "bi", "bj"))
            blobs = t.column("shingles").to_pylist()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                _, once = np.unique(node[a:b], return_index=True)
                at = a + once
                sides = [at] if bi[a] == bj[a] else [at[own[at] == bi[a]], at[own[at] == bj[a]]]
                at = np.concatenate(sides)
                links, first = links_of([np.frombuffer(blobs[i], np.uint64) for i in at], block, len(sides[0]) if len(sides) > 1 else None)
                out.append((node[at], links, node[at][first]))
            n, links, root = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(links), pa.array(root)], ["node", "links", "root"])

    return run


def links_of(sets: list[np.ndarray], block: int, left: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many of the others each set is similar to, and one member of its component. With ``left`` only the
    first so many meet the rest (either may be none), else all meet all."""
    m = len(sets)
    links, up = np.zeros(m, np.int64), list(range(m))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def tie(rows: np.ndarray, near: np.ndarray) -> None:
        for x, r in zip(rows.tolist(), rows[roots(near)].tolist(), strict=True):
            x, r = top(x), top(r)
            up[max(x, r)] = min(x, r)

    spans = [(0, m)] if left is None else [(0, left), (left, m)]
    cuts = [[(i, min(i + block, b)) for i in range(a, b, block)] for a, b in spans]
    if left is None:
        for c in cuts[0]:
            near = similar_matrix(sets[slice(*c)])
            np.fill_diagonal(near, False)
            links[slice(*c)] += near.sum(1)
            tie(np.arange(*c), near)
    pairs = [(c, d) for k, c in enumerate(cuts[0]) for d in (cuts[0][k + 1:] if left is None else cuts[1])]
    whose = {c: Incidence(sets[slice(*c)]) for c in {c for pair in pairs for c in pair}}
    for c, d in pairs:
        near = whose[c].similar(whose[d])
        links[slice(*c)] += near.sum(1)
        links[slice(*d)] += near.sum(0)
        p, q = near.shape
        both = np.zeros((p + q, p + q), bool)
        both[:p, p:], both[p:, :p] = near, near.T
        tie(np.r_[np.arange(*c), np.arange(*d)], both)
    return links, np.array([top(x) for x in range(m)], np.int64)


class Incidence:
    """Which of some sets has which shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        self.values, self.column = np.unique(np.concatenate(sets), return_inverse=True)
        self.owner = np.repeat(np.arange(len(sets)), self.size)

    def of(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``owner, column`` of the given columns, numbered as given and sorted by that number."""
        number = np.full(len(self.values), -1)
        number[columns] = np.arange(len(columns))
        col = number[self.column]
        order = np.flatnonzero(col >= 0)
        order = order[np.argsort(col[order], kind="stable")]
        return self.owner[order], col[order]

    def similar(self, other: Incidence, similar: float = SIMILAR) -> np.ndarray:
        """Which pairs have a Jaccard similarity of at least ``similar``: see ``similar_matrix``."""
        shared, mine, theirs = np.intersect1d(self.values, other.values, assume_unique=True, return_indices=True)
        (a, ca), (b, cb) = self.of(mine), other.of(theirs)
        both = np.zeros((len(self.size), len(other.size)), np.float32)
        step = 8192
        for first in range(0, len(shared), step):
            width = min(step, len(shared) - first)
            x, y = np.zeros((len(self.size), width), np.float32), np.zeros((len(other.size), width), np.float32)
            for z, own, col in ((x, a, ca), (y, b, cb)):
                i, j = np.searchsorted(col, [first, first + step])
                z[own[i:j], col[i:j] - first] = 1
            both += x @ y.T
        return both >= similar * (self.size[:, None] + other.size[None, :] - both) - 1e-4


def similar_matrix(sets: list[np.ndarray], similar: float = SIMILAR) -> np.ndarray:
    """Which sets have a Jaccard similarity of at least ``similar``: shared shingles are counted by
    products of incidence matrices, some columns at a time."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        ok = both >= similar * (size.sum() - both) - 1e-9
        return np.array([[True, ok], [ok, True]])
    owner = np.repeat(np.arange(len(sets)), size)
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = times[col] > 1
    owner, col = owner[use], np.unique(col[use], return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    step = 8192
    for first in range(0, int(col.max(initial=-1)) + 1, step):
        a, b = np.searchsorted(col, [first, first + step])
        x = np.zeros((len(sets), step), np.float32)
        x[owner[a:b], col[a:b] - first] = 1
        both += x @ x.T
    return both >= similar * (size[:, None] + size[None, :] - both) - 1e-4


def cut_wanted(docs: DataFrame, wanted: DataFrame, buckets: int, derive: Callable[[np.ndarray, np.ndarray], tuple], types: dict[str, pa.DataType], schema: str) -> DataFrame:
    """``derive(shingles, rows)``, as columns, for each text that ``wanted`` names; rows are those of the text in
    ``wanted``: doc_id, node and further longs.

    Most documents are not wanted: instead of sending every text to a join, the wanted rows are written as
    arrays sorted by id to the shared folder, by buckets, and each task that reads documents maps them into
    memory and cuts only the texts that are in them.
    """
    folder = local_path(scratch(docs.sparkSession, "wanted"))
    names = wanted.columns

    def write(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        rows = np.stack([table.column(c).to_numpy() for c in names], 1)
        write_file(bucket_path(folder, b), np.ascontiguousarray(rows[np.lexsort((rows[:, 1], rows[:, 0]))]).tobytes())
        return pa.table({"bucket": pa.array([b], pa.int32())})

    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(buckets)).cast("int")
    keyed = wanted.select(place.alias("bucket"), *(F.col(c).cast("long").alias(c) for c in names))
    filled = {r.bucket for r in by_bucket(keyed, buckets).applyInArrow(write, "bucket int").collect()}
    shared = docs.sparkSession.sparkContext.broadcast(filled)  # a number a bucket

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, mapped, filled = _WordHashes(), Mapped(), shared.value
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cols = ([x for part in c for x in part] if pa.types.is_binary(t) else np.concatenate(c) for c, t in zip(zip(*out, strict=True), types.values(), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values(), strict=True)], list(types))

        for b in slices(batches, 1000):
            ids, bucket = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(bucket).tolist():
                if k not in filled:
                    continue
                t = mapped(bucket_path(folder, k), np.int64).reshape(-1, len(names))
                mine = np.flatnonzero(bucket == k)
                first, last = (np.searchsorted(t[:, 0], ids[mine], side) for side in ("left", "right"))
                for i, a, z in zip(mine.tolist(), first.tolist(), last.tolist(), strict=True):
                    if a == z:
                        continue
                    s = shingles(utf8(b.column(2).slice(i, 1))[0], hashes)
                    rows = t[a:z]
                    if len(s) and len(rows := rows[rows[:, 1] == set_hash(s)]):
                        out.append(derive(s, rows))
                        size += s.nbytes
                        if size > FLUSH_BYTES:
                            yield flush()
                            out, size = [], 0
        if out:
            yield flush()

    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), place, "text")
    return known.mapInArrow(cut, schema)


def sets_of(docs: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """``node, root, n, shingles`` of the wanted documents (``doc_id, node, root, n``; n: any number of the root)."""
    types = {"node": pa.int64(), "root": pa.int64(), "n": pa.int64(), "shingles": pa.binary()}
    return cut_wanted(docs, wanted, buckets, lambda s, rows: (rows[:, 1], rows[:, 2], rows[:, 3], [s.tobytes()] * len(rows)), types, "node long, root long, n long, shingles binary")


def classified(docs: DataFrame, recall: float, small: int, block: int, part_bytes: int) -> DataFrame:
    """``doc_id, text_key, node, root, class_id, copy_of, n_links`` of each row; the last four are null where
    the row takes no part. root tells classes apart, also where they share a doc_id."""
    buckets = buckets_for(docs, 100.0)
    seen = written(profile(docs, repeats_for(recall)), "sets")
    known = seen.where("node is not null and doc_id is not null")
    # n: rows of the set
    sets = written(known.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("size", "sketch", "paths"))), "classes")
    coarse = connected_components(candidate_edges(docs, sets, buckets, small))
    coarse = written(coarse.join(sets.select("node", F.col("first_id").alias("doc_id"), "size"), "node"), "coarse")

    sizes = written(coarse.groupBy("root").agg(F.count("*").alias("n"), (F.sum("size") * 8).alias("bytes")), "sizes")
    grouped = hub_join(coarse, sizes, ["root"])
    whole = sets_of(docs, grouped.select("doc_id", "node", "root", parts_of(n=PART_SETS, bytes=part_bytes).alias("n")), buckets)
    dealt = in_parts(whole, F.col("n").cast("int")).select("root", "bi", "bj", "own", "node", "shingles")
    dealt = dealt.repartition("root", "bi", "bj").sortWithinPartitions("root", "bi", "bj")
    links = written(dealt.mapInArrow(exact_links(block), "node long, links long, root long"), "links")
    classes = written(connected_components(links.select(F.col("node").alias("u"), F.col("root").alias("v"))), "classes")
    counts = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    linked = classes.join(counts, "node", "left").join(sets.select("node", "first_id"), "node")
    linked = written(linked.select("node", "root", "first_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "linked")
    least = written(linked.groupBy("root").agg(F.min("first_id").alias("class_id"), F.count("*").alias("n")), "least")
    linked = hub_join(linked, least, ["root"]).select("node", "root", "class_id", "n_links")
    ids = sets.select("node", F.col("first_id").alias("copy_of"), "n").join(linked, "node", "left")
    ids = ids.select("node", "n", F.coalesce("root", "node").alias("root"), F.coalesce("class_id", "copy_of").alias("class_id"), "copy_of", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    rows = seen.select("doc_id", "text_key", "node")
    part = hub_join(rows.where("node is not null and doc_id is not null"), written(ids, "ids"), ["node"]).drop("n")
    rest = rows.where("node is null or doc_id is null").withColumn("node", F.lit(None).cast("long"))
    return part.unionByName(rest, allowMissingColumns=True)


def near_duplicates(docs: DataFrame, recall: float = 0.99, small: int = SMALL, block: int = BLOCK, part_bytes: int = PART_BYTES) -> DataFrame:
    """``doc_id, class_id, copy_of, n_links`` of each row.

    Links are pairs of different shingle sets (five words, words split at ASCII white space) of Jaccard
    similarity 0.8 or more; ``class_id`` is the smallest doc_id of the connected texts, ``copy_of`` the
    smallest doc_id with an equal set, ``n_links`` the number of different sets that the row's set is
    linked with. Texts under five words are one shingle; null texts and texts without words are alone
    (class_id is their own). Rows with a null doc_id take no part: class_id is null. Repeated rows share
    all; an id with several texts has a row for each. Ids are whole numbers, or texts of them; another text is an
    error. Further columns are not read; an empty table gives no rows. ``recall`` is that of a pair at the threshold to meet in a bucket, ``small`` the sets that a
    bucket compares at once, ``block`` those that are compared exactly at once, ``part_bytes`` the shingles of a
    group that are sent together.
    """
    return classified(docs, recall, small, block, part_bytes).select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, recall: float = 0.99, small: int = SMALL, block: int = BLOCK, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id, and where that id has several texts of
    the class, one of them (by a hash of the text). Rows are told apart by id and text, so an id that stands
    over texts of two classes loses none of the other class. Rows with a null doc_id and texts without words
    stay; of repeated rows (equal id and text, whatever their other columns) one stays. The
    result has the columns of ``docs``; an empty table gives no rows."""
    seen = classified(docs, recall, small, block, part_bytes).where("class_id is not null").select("doc_id", "text_key", "root", "class_id")
    rows = written(seen.groupBy("doc_id", "text_key").agg(F.first("root").alias("root"), F.first("class_id").alias("class_id"), F.count("*").alias("n")), "rows")
    # ids that are the least of their class with more than one text of it
    several = rows.where("doc_id = class_id").groupBy("root").agg(F.min("text_key").alias("keep"), F.count("*").alias("texts")).where("texts > 1")
    others = rows.where("doc_id = class_id").join(several, "root").where("text_key <> keep").select("doc_id", "text_key", "n")
    id_name, key = fresh(docs, "class_doc_id", "text_key")
    named: Callable[[DataFrame], DataFrame] = lambda df: df.select(F.col("doc_id").alias(id_name), F.col("text_key").alias(key), "n")
    extra = written(named(rows.where("doc_id <> class_id").select("doc_id", "text_key", "n").union(others)), "extra")
    again = written(hub_anti(named(rows.where("n > 1")), extra.withColumn("n", F.lit(1)), [id_name, key]), "again")
    keyed = docs.withColumn(id_name, F.col("doc_id")).withColumn(key, F.xxhash64("text"))
    kept = hub_anti(keyed, extra, [id_name, key])
    if again.isEmpty():
        return kept.select(*docs.columns)
    # only where a row stands more than once, rows are compared as rows
    once = hub_semi(kept, again, [id_name, key]).select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return hub_anti(kept, again, [id_name, key]).select(*docs.columns).unionByName(once)
