"""Model-backed columns: a provider is a function over batches of texts; the defaults are deterministic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The one version string of embeddings; stale rows are those that differ from it, nulls too.
EMBEDDING_VERSION = "hashed-words-64@1"
Provider = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def column(provider: Provider, returns: str) -> Callable[[Column], Column]:
    """The provider as a column function; batches of texts go to it as Arrow sends them."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from provider(batches)

    return run


def hashed_words(dim: int = 64) -> Provider:
    """Unit vectors of hashed words; the zero vector for no words."""

    def embed(text: str | None) -> list[float]:
        v = [0.0] * dim
        for w in (text or "").lower().split():
            h = xxhash.xxh64_intdigest(w.encode())
            v[h % dim] += 1.0 if h >> 63 else -1.0
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v] if n else v

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(embed)

    return run


def leading_sentence(most: int = 200) -> Provider:
    """The first sentence as a summary."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else t.strip().split("\n")[0].split(". ")[0][:most])

    return run


def safe(provider_for_one: Callable[[str], str]) -> Provider:
    """Errors become (value, error) structs instead of failing the task; use with
    ``struct<value:string,error:string>``."""

    def one(t: str | None) -> dict:
        try:
            return {"value": None if t is None else provider_for_one(t), "error": None}
        except Exception as e:  # the point of this wrapper: one bad row is a row with an error
            return {"value": None, "error": str(e)[:500]}

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([one(t) for t in s], columns=["value", "error"])

    return run


def check_dimension(df: DataFrame, column: str, dim: int) -> DataFrame:
    """Vectors of another length raise; nothing is padded."""
    ok = F.size(column) == dim
    return df.withColumn(column, F.when(F.col(column).isNull() | ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"vector of {column} must have {dim} entries, not "), F.size(column).cast("string")))))
