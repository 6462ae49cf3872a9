"""Corpus pipeline: toxic documents go, one of each group of near copies stays, repeated passages are cut,
documents with benchmark passages go, and what is left becomes token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to the shared
folder and reads it again as the next one's docs, as a cluster that runs the stages one by one would.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marlow.llm import bpe, decontaminate, jaccard_join, suffix_dedup, toxicity
from marlow.llm.common import written
from marlow.llm.queries import table, tokenizer_path

#: Words of a repeated passage from which it is cut.
PASSAGE_WORDS = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from the labels of the documents at hand."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return jaccard_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without passages of 50 words or more that a document of smaller id has."""
    return suffix_dedup.remove_repeats(docs, PASSAGE_WORDS, "words")


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, up to a few edits."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def tokens_and_text(model: bpe.ByteBPE, ids: list[list[int]]) -> list[pa.Array]:
    return [pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(x) for x in ids], pa.string())]


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, token_ids, decoded``: the ids of each text and what they decode to, a row for each row. A null text
    counts as empty: no ids, and an empty text. Null and repeated ids stay as they are; other columns are left out."""
    return bpe.bpe_map(docs, tokenizer_path(), tokens_and_text, "n_tokens long, token_ids array<int>, decoded string")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaked),
    ("bpe", encode),
]

#: Learning, seeded trees and merges have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
