"""Toxicity by non-negative positive-unlabelled learning on numpy.

The classifier is linear over words and word beginnings. Only confirmed toxic examples carry a label;
all other training text counts as unlabelled. The risk of the negative class is estimated as
(unlabelled risk - prior * positive risk) and held at zero or more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlow.llm.common import id_remainder, slices, written

BUCKETS = 1 << 20
CACHE_WORDS = 200_000
SLICE = 1000  # texts that are Python objects at a time
# ASCII letters in lower case and all bytes of longer characters stay, the rest separates words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(LETTERS).split() if text else []


def features_of(word: bytes) -> list[int]:
    """Hashed features of a word: itself, and its first 3 to 6 bytes."""
    return [zlib.crc32(b"=" + word) % BUCKETS] + [zlib.crc32(b"^" + word[:n]) % BUCKETS for n in range(3, 7) if len(word) >= n]


@dataclass
class PUModel:
    """``columns``: feature bucket -> column; ``weights`` by column; ``bias``."""

    columns: dict[int, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def hits(self) -> _Hits:
        return _Hits(self.columns)

    def score(self, seen: set[int]) -> float:
        z = self.bias + float(self.weights[list(seen)].sum()) if seen else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class _Hits(dict):
    """word -> its columns in the model, or None."""

    def __init__(self, columns: dict[int, int]):
        self.columns = columns

    def __missing__(self, word: bytes):
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = tuple(self.columns[f] for f in features_of(word) if f in self.columns) or None
        self[word] = found
        return found

    def of(self, text: str | None) -> set[int]:
        return {c for hit in filter(None, map(self.__getitem__, words_of(text))) for c in hit}


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, l2: float | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative PU risk with the logistic loss, by Adam on all rows.

    Risk: prior * mean loss(+|P) + max(0, mean loss(-|U) - prior * mean loss(-|P)). Where the second
    term is below zero, its gradient is reversed, as the method has it. The penalty on weights is weaker
    the more positives there are.
    """
    l2 = 0.4 / len(positive) if l2 is None else l2
    n = positive.shape[1]
    theta, m, v = (np.zeros(n + 1, np.float32) for _ in range(3))
    theta[-1] = np.log(prior / (1 - prior))
    add_one = lambda x: np.hstack([x, np.ones((len(x), 1), x.dtype)])
    p, u = add_one(positive), add_one(unlabelled)
    for step in range(1, steps + 1):
        zp, zu = p @ theta, u @ theta
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_pos = -prior * (p.T @ (1 - sp)) / len(p)
        g_neg = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        g = g_pos + g_neg if negative >= 0 else -g_neg
        g = (g + l2 * np.r_[theta[:-1], 0]).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = (theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, positives: int = 6000, unlabelled: int = 12000, columns: int = 400, least: int = 5, hold_out: tuple[int, int] = (5, 0)) -> PUModel:
    """Fit on rows whose id remainder is not held out.

    ``positives`` and ``unlabelled`` bound the rows to fit on (both drawn by a hash of the id, about that
    many). The model has the ``columns`` features that tell most, of those that ``least`` positives or more have;
    the class prior is the share of toxic labels over all training labels. Without a toxic label
    in training, the model is the constant score 0. Null ids and labels teach nothing; of several
    labels of an id the highest counts.
    """
    mod, rest = hold_out
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (id_remainder(F.col("doc_id"), mod) != rest))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()
    if not toxic:
        return PUModel(bias=-30.0)
    prior = min(0.9, max(1e-4, toxic / n))
    drawn = lambda bound, of, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, bound / max(1, of)))
    # at most about ``positives`` ids, a parameter, so they may be broadcast
    pos_ids = known.where((F.col("toxic") > 0) & drawn(positives, toxic, 1)).select("doc_id")
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), mod) != rest))
    pos = texts.join(F.broadcast(pos_ids), "doc_id").select("text", F.lit(True).alias("pos"))
    unl = texts.where(drawn(unlabelled, texts.select("doc_id").count(), 2)).select("text", F.lit(False).alias("pos"))
    # a bounded number of rows, read three times below: written once, so that the corpus is not read again
    sample = written(pos.unionByName(unl), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = {True: np.zeros(BUCKETS, np.int32), False: np.zeros(BUCKETS, np.int32)}
        cache: dict[bytes, list[int]] = {}
        for b in slices(batches, SLICE):
            for text, is_pos in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen: set[int] = set()
                for w in set(words_of(text)):
                    if (f := cache.get(w)) is None:
                        if len(cache) > CACHE_WORDS:
                            cache.clear()
                        f = cache[w] = features_of(w)
                    seen.update(f)
                df[is_pos][list(seen)] += 1
        some = np.flatnonzero(df[True] | df[False])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[True][some], pa.int64()), pa.array(df[False][some], pa.int64())], ["f", "p", "u"])

    n_pos, n_unl = (int(x or 0) for x in sample.agg(F.sum(F.col("pos").cast("int")), F.sum((~F.col("pos")).cast("int"))).first())
    if not n_pos or not n_unl:
        return PUModel(bias=-30.0)
    df = sample.mapInArrow(count, "f long, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= least)
    # two standard errors below the share seen: chance features of few positives stay out
    in_p, in_u = (F.col("p") - 2 * F.sqrt("p")) / n_pos, F.col("u") / n_unl
    in_n = F.greatest((in_u - prior * in_p) / (1 - prior), F.lit(0.0))
    gain = in_p * F.log((in_p + 1 / n_pos) / (in_n + 1 / n_pos))
    best = [r.f for r in df.where(in_p > in_n).orderBy(gain.desc(), "f").limit(columns).select("f").collect()]
    column = {f: i for i, f in enumerate(best)}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits(column)
        for b in slices(batches, SLICE):
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([sorted(hits.of(t)) for t in b.column(0).to_pylist()], pa.list_(pa.int32()))], ["pos", "seen"])

    # bounded by positives + unlabelled rows of at most ``columns`` entries
    rows = sample.mapInArrow(extract, "pos boolean, seen array<int>").toArrow()
    flag = np.array(rows.column("pos").to_pylist())
    x = np.zeros((len(flag), len(best)), np.float32)
    for i, seen in enumerate(rows.column("seen").to_pylist()):
        x[i, seen] = 1
    if not flag.any() or flag.all():
        return PUModel(bias=-30.0)
    weights, bias = fit_nnpu(x[flag], x[~flag], prior)
    return PUModel(column, weights, bias)


def score(docs: DataFrame, model: PUModel, hold_out: tuple[int, int] = (5, 0)) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row; whole texts, row for row, no shuffle.

    A null or empty text has the score of no features (the bias). Null ids, repeated rows and further
    columns pass; an empty table gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        hits = m.hits()
        for b in slices(batches, SLICE):
            got = [m.score(hits.of(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got, pa.float64()), pa.array([int(s >= 0.5) for s in got], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    held = (id_remainder(F.col("doc_id"), hold_out[0]) == hold_out[1]).alias("held_out")
    return docs.select("doc_id", "text", held).mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: PUModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        hits = m.hits()
        for b in slices(batches, SLICE):
            yield b.filter(pa.array([m.score(hits.of(t)) < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
