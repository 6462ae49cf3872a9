"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlow.llm.common import id_remainder, slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
_TABLE: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """code point -> lower-case letter, or a space for what is no letter; made once in each process."""
    if not _TABLE:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(table)
    return _TABLE[0]


def ngrams(text: str) -> np.ndarray | None:
    """Bucket of every character n-gram of the whole text, or None if it has no letter.

    Letters are lower-cased; runs of other characters become one space.
    """
    codes = letter_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    space = codes == 32
    if space.all():
        return None
    codes = codes[~(space & np.r_[False, space[:-1]])]
    codes = np.r_[np.uint32(32), codes, np.uint32(32)].astype(np.uint32)
    out, h = [], np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1:] * np.uint32(0x9E3779B1)
        if n in ORDERS:
            mixed = h ^ (h >> np.uint32(15))
            out.append((mixed * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F)) >> np.uint32(17))
    return np.concatenate(out)


class LanguageModel:
    """``languages`` and the log-probability matrix (BUCKETS x languages) with log priors."""

    def __init__(self, languages: list[str], counts: np.ndarray, docs: np.ndarray, smooth: float = 0.5):
        self.languages = languages
        self.matrix = np.log(counts + smooth) - np.log(counts.sum(0) + smooth * BUCKETS)
        self.prior = np.log(docs + 1.0) - np.log((docs + 1.0).sum() or 1.0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language and its posterior for each text; ``und`` and 0 without a letter or a language."""
        names, sure = ["und"] * len(texts), [0.0] * len(texts)
        for rows, data, bucket, offset in sparse_batches(texts) if self.languages else ():
            z = np.stack([np.add.reduceat(column[bucket] * data, offset[:-1]) for column in self.matrix.T], 1) + self.prior
            best = z.argmax(1)
            p = 1 / np.exp(z - z[np.arange(len(z)), best][:, None]).sum(1)
            for i, k, x in zip(rows, best.tolist(), p.tolist(), strict=True):
                names[i], sure[i] = self.languages[k], x
        return names, sure


def sparse_batches(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Compressed sparse rows (data, bucket, offset) of n-gram counts of the texts that have a letter, with their
    numbers; about ``most`` entries at a time. A long text has an entry for each bucket, not for each n-gram."""
    rows: list[int] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def packed():
        return rows, np.concatenate([d for d, _ in held]), np.concatenate([b for _, b in held]), np.cumsum([0, *(len(b) for _, b in held)])

    for i, text in enumerate(texts):
        grams = ngrams(text) if text else None
        if grams is None:
            continue
        if len(grams) > BUCKETS:
            counts = np.bincount(grams, minlength=BUCKETS)
            bucket = np.flatnonzero(counts)
            held.append((counts[bucket].astype(float), bucket))
        else:
            held.append((np.ones(len(grams)), grams))
        rows.append(i)
        size += len(held[-1][1])
        if size >= most:
            yield packed()
            rows, held, size = [], [], 0
    if rows:
        yield packed()


def train(docs: DataFrame, per_language: int = 4000, hold_out: tuple[int, int] = (3, 1)) -> LanguageModel:
    """Count n-grams on the executors over about ``per_language`` documents of each language, drawn by
    a hash of the id among rows that are not held out and have a language. Null texts teach nothing.
    The counts are languages x BUCKETS numbers, whatever the input."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder(F.col("doc_id"), hold_out[0]) != hold_out[1]))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    number = {x: i for i, x in enumerate(languages)}
    share = F.element_at(F.create_map(*(F.lit(v) for x in languages for v in (x, min(1.0, per_language / sizes[x])))), F.col("lang"))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < share * 1_000_000).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (grams := ngrams(text)) is not None:
                    counts[number[lang]] += np.bincount(grams, minlength=BUCKETS)
        lang, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[lang, bucket], pa.int64())], ["l", "b", "n"])

    got = sample.mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS, len(languages)))
    counts[got.column("b").to_numpy(), got.column("l").to_numpy()] = got.column("n").to_numpy()
    return LanguageModel(languages, counts, np.array([sizes[x] for x in languages], float))


def identify(docs: DataFrame, model: LanguageModel, hold_out: tuple[int, int] = (3, 1)) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row, from the whole text; no shuffle.

    ``und`` with score 0 where the text is null, empty or has no letter (or no language was learned).
    Null ids, repeated rows and further columns pass; an empty table gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, 1000):
            names, sure = m.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(names, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = (id_remainder(F.col("doc_id"), hold_out[0]) == hold_out[1]).alias("held_out")
    return docs.select("doc_id", "text", held).mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
