"""Exact top-k by inner product over posting lists: MaxScore on shards, whose results are merged.

Vectors of whole numbers are documents: a component is a term, its value the impact. An index has one posting
list a term and shard. A block of queries meets a shard in one task.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlow.llm.common import by_bucket, written

#: Impacts of a chunk, terms x rows, that a task holds at a time.
CHUNK_CELLS = 1 << 20
#: Scores of a chunk, queries x rows, that a task holds at a time.
CHUNK_SCORES = 1 << 20


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``uid, key, vector``: components as floor(scale * x); ``uid`` tells rows of one id apart.

    Rows whose vector is null, or holds a null or a component that isn't finite, are left out. The table is written
    to the shared folder, so that each row has one ``uid`` for good.
    """
    x = F.col(vector_col)
    finite = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = df.where(F.coalesce(finite, F.lit(False))).select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("key"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("vector"),
    )
    return written(rows, "vectors")


def build_index(vectors: DataFrame, shards: int) -> DataFrame:
    """Posting lists: ``shard, term, at, impact``, a row for each shard and term. ``at`` are places of the shard's
    members, in order of (key, uid), that have the term; ``impact`` their values. Term -1 lists the members: ``at`` are
    their uids, ``impact`` their keys (``keyless`` counts those without one, which stand last).

    Rows are dealt by a hash of their uid: no key makes a shard large.
    """
    schema = pa.schema([("shard", pa.int32()), ("term", pa.int32()), ("keyless", pa.int32()), ("at", pa.list_(pa.int64())), ("impact", pa.list_(pa.int64()))])

    def invert(table: pa.Table) -> pa.Table:
        key, uid = table["key"].to_numpy(), table["uid"].to_numpy()
        null = np.asarray(table["key"].is_null())
        key = np.where(null, 0, np.nan_to_num(key)).astype(np.int64) if null.any() else key.astype(np.int64)
        order = np.lexsort((uid, key, null))
        lists = table["vector"].combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        size = np.diff(lists.offsets.to_numpy())
        row = np.repeat(place, size)
        term = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        value = lists.flatten().to_numpy()
        found = value != 0
        row, term, value = row[found], term[found], value[found]
        by_term = np.lexsort((row, term))
        row, term, value = row[by_term], term[by_term], value[by_term]
        terms, starts = np.unique(term, return_index=True)
        ends = np.r_[starts[1:], len(term)]
        shard = table["shard"][0].as_py()
        out = [(shard, -1, int(null.sum()), uid[order], key[order])] + [(shard, int(t), 0, row[a:b], value[a:b]) for t, a, b in zip(terms, starts, ends, strict=True)]
        return pa.table(list(map(list, zip(*out, strict=True))), schema=schema)

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))
    return by_bucket(dealt, shards, "shard").applyInArrow(invert, "shard int, term int, keyless int, at array<long>, impact array<long>")


class Shard:
    """A shard's posting lists, and the search of one block of queries in them."""

    def __init__(self, keys: np.ndarray, uids: np.ndarray, keyless: int, postings: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.keys, self.uids, self.keyless, self.postings = keys, uids, keyless, postings

    def search(self, weights: np.ndarray, own: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score) of each query's ``k`` best, for ``weights`` (queries x terms) and the queries' own uids.

        Rows are taken in chunks. For each, a query's terms are ordered by the most that a list can add to its score.
        The smallest are non-essential while what they add together stays below ``share`` of the score that is to be
        beaten (the k-th so far). Lists of the essential terms are traversed for all queries of the block at once
        (their impacts as rows of a matrix). The rest are probed, the term of the highest bound first, for the pairs
        that can still reach that score; it falls with every probe. Pairs that reach it, ties included, are kept.
        """
        n, m = len(self.uids), len(weights)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        least = np.full(m, -np.inf)
        if not n or not m:
            return best
        terms = sorted(self.postings)
        if not terms:
            weights = np.zeros((m, 1), np.int64)
            terms, self.postings = [0], {0: (np.zeros(0, np.int64), np.zeros(0, np.int64))}
        number = [t for t in terms if t < weights.shape[1]]
        w = weights[:, number]
        high = np.array([self.postings[t][1].max(initial=0) for t in number], np.int64)
        low = np.array([self.postings[t][1].min(initial=0) for t in number], np.int64)
        # no sum of products is above ``reach``: a float holds it exactly, or whole numbers are multiplied
        reach = float((np.abs(w).astype(float) @ np.maximum(high, -low).astype(float)).max(initial=0))
        kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64
        if reach >= 2**63:
            raise OverflowError("scores don't fit 64 bits")
        chunk = max(1, min(CHUNK_CELLS // max(len(number), 1), CHUNK_SCORES // m, n))
        own_place = _places(self.uids, own)
        for start in range(0, n, chunk):
            stop = min(n, start + chunk)
            impacts = np.zeros((len(number), stop - start), kind)
            top, bottom = np.zeros(len(number)), np.zeros(len(number))
            for i, t in enumerate(number):
                at, value = self.postings[t]
                a, b = np.searchsorted(at, (start, stop))
                impacts[i, at[a:b] - start] = value[a:b]
                top[i], bottom[i] = value[a:b].max(initial=0), value[a:b].min(initial=0)
            q, p, s = self._chunk(w.astype(kind), impacts, np.maximum(w * top, w * bottom), least, own_place - start, k, share)
            best = _keep(np.r_[best[0], q], np.r_[best[1], p + start], np.r_[best[2], s], k)
            count = np.bincount(best[0], minlength=m)
            last = np.cumsum(count) - 1
            full = count >= k
            least[full] = best[2][last[full]]
        return best

    @staticmethod
    def _chunk(w: np.ndarray, impacts: np.ndarray, most: np.ndarray, least: np.ndarray, own: np.ndarray, k: int, share: float):
        m, width = len(w), impacts.shape[1]
        order = np.argsort(most, axis=1, kind="stable")
        adds = np.cumsum(np.take_along_axis(most, order, 1), axis=1)
        optional = adds < np.maximum(least * share, 0)[:, None]
        n_optional = optional.sum(1)
        essential = np.ones_like(optional)
        np.put_along_axis(essential, order, ~optional, 1)
        acc = np.where(essential, w, 0).astype(w.dtype) @ impacts
        mine = np.flatnonzero((own >= 0) & (own < width))
        gone = np.zeros(acc.shape, bool) if len(mine) else None
        if gone is not None:
            gone[mine, own[mine]] = True
        need = least
        if not n_optional.any() and width > k and (least == -np.inf).any():
            # scores are exact: the k-th of the chunk is a bound, too; one more, as a query's own row is none of its hits
            kth = np.partition(acc, width - k - 1, axis=1)[:, width - k - 1] if width > k + 1 else acc.min(1)
            need = np.maximum(least, kth)
        rest = np.where(n_optional > 0, np.take_along_axis(adds, np.maximum(n_optional - 1, 0)[:, None], 1)[:, 0], 0.0) if adds.shape[1] else np.zeros(m)
        if w.dtype == np.int64:  # bounds are floats: what they round away is given back, scores stay exact
            need = need - 1e-12 * np.where(np.isfinite(need), np.abs(need) + (adds[:, -1] if adds.shape[1] else 0), 0)
        alive = acc >= (need - rest)[:, None]
        if gone is not None:
            alive &= ~gone
        q, p = np.nonzero(alive)
        score = acc[q, p]
        left = n_optional[q]
        while len(q) and left.max() > 0:
            probing = left > 0
            term = order[q, np.maximum(left - 1, 0)]
            score = np.where(probing, score + w[q, term] * impacts[term, p], score)
            left = np.maximum(left - 1, 0)
            bound = np.where(left > 0, adds[q, np.maximum(left - 1, 0)], 0.0)
            stays = score >= need[q] - bound
            q, p, score, left = q[stays], p[stays], score[stays], left[stays]
        return q, p, score.astype(np.int64)


def _places(uids: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Where each of ``own`` stands among ``uids``; a number below all places if nowhere."""
    order = np.argsort(uids)
    at = np.searchsorted(uids[order], own)
    hit = (at < len(uids)) & (uids[order[np.minimum(at, len(uids) - 1)]] == own)
    return np.where(hit, order[np.minimum(at, len(uids) - 1)], np.iinfo(np.int64).min // 2)


def _keep(q: np.ndarray, p: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` highest scores of each query, ties by place."""
    order = np.lexsort((p, -s, q))
    q, p, s = q[order], p[order], s[order]
    first = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return q[rank < k], p[rank < k], s[rank < k]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float = 0.25, query_rows: int | None = None, shard_rows: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each query with all other vectors.

    Both tables are of ``whole_vectors``; a query is one of the vectors. Ties go to the smaller id, then (ids that
    repeat) to the row written first; no id comes after all ids. Rows of one id are different rows: each is a query of
    its own, and finds the others. Where a vector is shorter, what it lacks counts 0. ``share`` 1 is the usual
    split of terms; less makes more terms essential and leaves fewer probes. No queries, no rows.

    Blocks of queries meet shards, each pair in one task; both grow with the square root of the tables until they
    reach a bound, so that a row is sent n_queries / query_rows times. Of each pair at most ``k`` hits a query leave.
    """
    n, n_queries = vectors.count(), queries.count()
    query_rows = query_rows or int(min(4096, max(128, n_queries // 16)))
    shard_rows = shard_rows or int(min(65536, max(2048, n // 16)))
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // query_rows))
    index = written(build_index(vectors, shards), "postings")
    dealt = queries.select(
        F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(blocks)).cast("int").alias("block"), F.lit(-2).alias("term"), F.array(F.col("uid"), F.col("key")).alias("at"), F.col("vector").alias("impact"),
    )
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    meet = index.select(every(blocks, "block"), "shard", "term", "keyless", "at", "impact").unionByName(dealt.select("block", every(shards, "shard"), "term", F.lit(0).alias("keyless"), "at", "impact"))
    meet = meet.withColumn("cell", F.col("block") * shards + F.col("shard"))
    schema = pa.schema([("query_uid", pa.int64()), ("query_id", pa.int64()), ("uid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def hits(table: pa.Table) -> pa.Table:
        term = table["term"].to_numpy()
        asked = np.flatnonzero(term == -2)
        members = np.flatnonzero(term == -1)
        if not len(asked) or not len(members):
            return schema.empty_table()
        at, impact = table["at"], table["impact"]
        numbers = lambda column, i: column[int(i)].values.to_numpy(zero_copy_only=False).astype(np.int64)
        vectors_ = [numbers(impact, i) for i in asked]
        width = max(map(len, vectors_))
        weights = np.zeros((len(asked), max(width, 1)), np.int64)
        for row, v in zip(weights, vectors_, strict=True):
            row[:len(v)] = v
        who = np.array([at[int(i)].as_py() for i in asked], np.int64)
        lists = {int(term[i]): (numbers(at, i), numbers(impact, i)) for i in np.flatnonzero(term >= 0)}
        keyless = table["keyless"][int(members[0])].as_py()
        shard = Shard(numbers(impact, members[0]), numbers(at, members[0]), keyless, lists)
        q, p, s = shard.search(weights, who[:, 0], k, share)
        ids = pa.array(shard.keys[p], mask=p >= len(shard.keys) - keyless)
        return pa.table([pa.array(who[q, 0]), pa.array(who[q, 1]), pa.array(shard.uids[p]), ids, pa.array(s)], schema=schema)

    found = by_bucket(meet, shards * blocks, "cell").applyInArrow(hits, "query_uid long, query_id long, uid long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_divisible(df: DataFrame, by: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``search`` with the rows whose id is divisible by ``by`` as queries."""
    vectors = whole_vectors(df, id_col, vector_col)
    return search(vectors, vectors.where(F.col("key") % by == 0), k)
