"""Full-text search over a table of postings: words of a text, where they stand, in buckets by word.

The words are those of a plain configuration: runs of letters, digits and underscores in lower case, without stems or
stop words. A term of several words is a phrase. The index is written once; a search reads the buckets of its words only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Buckets of an index; more for a large corpus, so that a word's bucket is a small part of it.
BUCKETS = 16


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"))


def words_of(term: str) -> list[str]:
    """The words of a search term; quotes and operators stand between words and have no meaning."""
    return [w for w in re.findall(r"[^\W]+", term.lower())]


def bucket_of(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode()) % buckets


#: Texts whose words are put in order at a time.
TEXTS = 1000


def postings(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, word, id, length, positions`` of ``docs`` (id, text): a row for each word of a text.

    ``length`` is the text's in characters. A null text has no words; rows of one id are one text each, and must
    not repeat for positions to be those of one text. A text's words are put in order where the text is, so nothing is sent.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                said = b.column(2)
                flat, ends = said.flatten().dictionary_encode(), np.cumsum(np.r_[0, said.value_lengths().to_numpy(zero_copy_only=False)])
                row = np.repeat(np.arange(b.num_rows), np.diff(ends))
                place = (np.arange(len(row)) - ends[row]).astype(np.int32)
                # by word, then by text; the sort is stable, so places stay in order
                key = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) * b.num_rows + row
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.array([], np.int64)
                word, text = np.divmod(key[first], b.num_rows)
                bucket = np.array([bucket_of(w, buckets) for w in flat.dictionary.to_pylist()], np.int32)
                positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(key)].astype(np.int32)), pa.array(place[order]))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[word]), flat.dictionary.take(pa.array(word)), b.column(0).take(pa.array(text)), b.column(1).take(pa.array(text)), positions], names=["bucket", "word", "id", "length", "positions"])

    said = docs.select("id", F.length("text").alias("length"), words(F.col("text")).alias("words"))
    return said.mapInArrow(gather, f"bucket int, word string, id {kind}, length int, positions array<int>")


def write_index(docs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Postings as a table partitioned by bucket, in order of word. Rebalancing cuts a bucket with a very common word
    into several files and joins small ones."""
    put = postings(docs, buckets).hint("rebalance", "bucket").sortWithinPartitions("bucket", "word", "id")
    put.write.option("parquet.block.size", 16 << 20).partitionBy("bucket").parquet(path)


def matches(index: DataFrame, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``id, length, tf``: texts that have one of the terms, and how often, all terms together.

    Only partitions of the terms' buckets are read, and of them row groups that may hold the words. No terms, no rows.
    """
    asked = [w for w in map(words_of, terms) if w]
    if not asked:
        return index.select("id", "length", F.lit(0).cast("long").alias("tf")).where(F.lit(False))
    known = sorted({w for term in asked for w in term})
    places = sorted({bucket_of(w, buckets) for w in known})
    rows = index.where(F.col("bucket").isin(places) & F.col("word").isin(known))
    # one aggregate: a phrase is where its words' positions, each less its place in the phrase, meet
    at = {w: f"__w{i}" for i, w in enumerate(known)}
    g = rows.groupBy("id", "length").agg(*(F.max(F.when(F.col("word") == w, F.col("positions"))).alias(c) for w, c in at.items()))
    none = F.array().cast("array<int>")

    def starts(w: str, place: int) -> Column:
        """Where a phrase would begin, whose word in this place is ``w``."""
        return F.transform(F.coalesce(F.col(at[w]), none), lambda p: p - place)

    def often(term: list[str]) -> Column:
        met = starts(term[0], 0)
        for place, w in enumerate(term[1:], 1):
            met = F.array_intersect(met, starts(w, place))
        return F.size(met).cast("long")

    tf = sum(map(often, asked), F.lit(0).cast("long"))
    return g.select("id", "length", tf.alias("tf")).where("tf > 0")


def search(index: DataFrame, terms: list[str], k: int = 50, buckets: int = BUCKETS) -> DataFrame:
    """``id, score``: tf / (1 + ln(length)) over the terms that a text has, the ``k`` best, ties by id."""
    score = F.col("tf") / (1 + F.log(F.col("length").cast("double")))
    return matches(index, terms, buckets).select("id", score.alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def open_index(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    return spark.read.schema(f"word string, id {id_type}, length int, positions array<int>, bucket int").parquet(path)
