"""Quality rules as weak supervision: rules vote or abstain, EM finds how far to trust each of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlow.llm.common import Numbering, slices, written

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\r\x0b\x0c"
UPPER = bytes(range(65, 91))
LETTER_BYTES = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
RULES = ("symbols", "dup_lines", "repeats", "word_length", "shouting", "length", "sentences", "letters")
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes]) -> int:
    """Words covered by windows of three words that are found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number = Numbering()
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    if len(number) <= n - 3 or len(number) < n:
        keys = ids[:-1] * len(number) + ids[1:]
        if len(number) >= 1 << 20:
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys[:-1] * len(number) + ids[2:]
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        covered[:-2] |= twice
        covered[1:-1] |= twice
        covered[2:] |= twice
        return int(covered.sum())
    return 0


def vote(value: float, bad: bool, good: bool) -> int:
    return 0 if bad else 2 if good else 1


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the votes as one base-3 number
    (0 low quality, 1 abstains, 2 good), of a whole text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    upper = len(raw) - len(raw.translate(None, UPPER))
    letters = len(raw) - len(raw.translate(None, LETTER_BYTES))
    stops = raw.count(b".") + raw.count(b"?") + raw.count(b"!")
    per = 1 / max(1, n)
    votes = (
        vote(x := symbols * per, x > 0.3, x < 0.05),
        vote(x := dup / max(1, len(lines)), x > 0.3, x < 0.1 and len(lines) > 1),
        vote(x := repeats * per, x > 0.4, x < 0.2 and n >= 10),
        vote(x := chars * per, x > 12 or x < 2.5, 3.5 <= x <= 8.5),
        vote(x := upper / max(1, letters), x > 0.4, x < 0.15),
        vote(n, n < 20, n >= 60),
        vote(x := stops * per, x > 0.5 or x == 0 and n > 100, 0.02 <= x <= 0.35),
        vote(x := letters / max(1, len(raw)), x < 0.62, x > 0.74),
    )
    code = 0
    for v in votes:
        code = code * 3 + v
    return n, chars, symbols, dup, repeats, code


def votes_of(code: int) -> list[int]:
    out = []
    for _ in RULES:
        code, v = divmod(code, 3)
        out.append(v)
    return out[::-1]


def em(codes: np.ndarray, counts: np.ndarray, rounds: int = 60, floor: float = 0.02) -> np.ndarray:
    """Posterior of good quality for each pattern of votes.

    Each rule has a table P(vote | class) over low, abstain, good; the first posterior is the share of
    good among the votes cast. A rule that cannot do better than chance is held at it: accuracy on
    either class never falls under that of a vote against the class, so the classes cannot swap.
    """
    if not len(codes):
        return np.zeros(0)
    v = np.array([votes_of(int(c)) for c in codes])
    cast = (v != 1).sum(1)
    good = np.where(cast > 0, ((v == 2).sum(1) + 0.5) / (cast + 1), 0.5)
    # an error found by one rule is worth more than silence: start from a stricter majority
    good = np.clip(good**2, floor, 1 - floor)
    one_hot = np.eye(3)[v]
    for _ in range(rounds):
        w1, w0 = counts * good, counts * (1 - good)
        prior = np.clip(w1.sum() / counts.sum(), 0.05, 0.98)
        table = []
        for w in (w0, w1):
            t = np.einsum("p,prv->rv", w, one_hot) + 1
            table.append(t / t.sum(1, keepdims=True))
        t0, t1 = table
        tell = np.clip(np.log(t1) - np.log(t0), -3, 3)
        tell[:, 0] = np.minimum(tell[:, 0], 0)
        tell[:, 2] = np.maximum(tell[:, 2], 0)
        z = np.log(prior / (1 - prior)) + np.einsum("prv,rv->p", one_hot, tell)
        new = 1 / (1 + np.exp(-z))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return good


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality``.

    One pass measures every whole text and is written to the shared folder; the patterns of votes
    (3 ** rules at most, whatever the input) are counted over all rows and EM runs on those counts.
    Null and empty texts have no words and fail; null ids, repeated rows and further columns pass; an
    empty table gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1000):
            got = list(zip(*map(measure, b.column(1).to_pylist()), strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in got)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes"])

    measured = written(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {STATS}, votes long"), "quality")
    counted = measured.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    posterior = em(np.array([r.votes for r in counted]), np.array([r.n for r in counted], float))
    table = measured.sparkSession.createDataFrame([(r.votes, float(p)) for r, p in zip(counted, posterior, strict=True)], "votes long, quality double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.join(F.broadcast(table), "votes").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("quality") >= threshold)).alias("kept"), "quality",
    )
