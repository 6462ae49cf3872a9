"""What the corpus operators share: the shared scratch folder, Arrow plumbing, size estimates."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from marlow.sources.catalog import spread  # noqa: F401
from marlow.sources.shared import scratch

def local_path(uri: str) -> str:
    """The path of a ``file:`` URI, for files that workers map into memory.

    The shared folder must then be mounted on every machine; other stores are refused, not copied.
    """
    if uri.startswith("file:"):
        return "/" + uri[len("file:"):].lstrip("/")
    if "://" in uri:
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {uri}")
    return uri


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table to the shared folder and read again: later jobs start from the
    files, so a lost executor costs no recomputation of what stands before."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def buckets_for(df: DataFrame, mb_each: float, least: int = 12, text_col: str = "text") -> int:
    """How many hash buckets keep each near ``mb_each`` MB of text; grows with the text, without a bound. The bytes are
    counted (a pass that reads one column): file sizes would mislead where texts compress well."""
    size = df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    return int(max(least, size / (mb_each * 1e6)))


#: More tasks than this help no cluster; a task then takes several buckets, one after the other.
MOST_TASKS = 50_000


def by_bucket(df: DataFrame, buckets: int, key: str = "bucket") -> GroupedData:
    """``df`` grouped by the number of its bucket, a bucket a task (up to MOST_TASKS): where buckets met in a
    task by a hash, some tasks would have several and others none. Numbers are not negative; those above take
    the task that the remainder names. The grouping needs no further shuffle."""
    return df.repartitionById(min(buckets, MOST_TASKS), F.col(key)).groupBy(key)


def runs(sorted_values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each distinct value of a sorted array and the slice that holds it."""
    if not len(sorted_values):
        return
    at = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(sorted_values)], strict=True):
        yield int(sorted_values[a]), slice(a, b)


def bucket_path(folder: str, bucket: int) -> str:
    """Where a bucket's arrays are: at most 4096 folders, so that none holds all files."""
    return f"{folder}/{bucket % 4096}/{bucket}"


class Mapped:
    """Arrays in files, mapped into memory as they are asked for; at most ``most`` are open, the one unused
    for longest is closed. A missing file is an error, never an empty array."""

    def __init__(self, most: int = 400):
        self.most = most
        self.open: dict[str, np.ndarray] = {}

    def __call__(self, path: str, dtype) -> np.ndarray:
        got = self.open.pop(path, None)
        if got is None:
            if not os.path.getsize(path):
                return np.zeros(0, dtype)
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open)))
            got = np.memmap(path, dtype, "r")
        self.open[path] = got
        return got


def id_remainder(col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def record(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, schema.field(n).type) for n, c in cols.items()], schema=schema)


def give_back() -> None:
    """Hands memory that Arrow has freed but keeps for later back to the system: a worker lives on from task to task, and
    would hold what its batches took besides what its executor holds."""
    pa.default_memory_pool().release_unused()


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that few texts are Python objects at a time. See ``give_back``."""
    give_back()
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        del b
        give_back()


def utf8(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def write_file(path: str, data: bytes) -> None:
    """Write so that a second attempt of a task, or one that is running at once, does no harm."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


class Numbering(dict):
    """word -> 0, 1, 2, ... in order of first use."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` has it, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: ``monotonically_increasing_id`` counts rows of a partition below this bit, partitions above it.
PART_BIT = 33


def indexed(rows: DataFrame, order: list[str], rows_each: int) -> DataFrame:
    """``rows`` as a written table in ranges of ``order``, with ``at``, which ascends in that order, and ``part``, the number
    of the range. A range has about ``rows_each`` rows; the last column of ``order`` must tell all rows apart, else equal
    ones are one range. Nulls stand first."""
    parts = int(min(MOST_TASKS, max(1, -(-rows.count() // rows_each))))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return written(ranged.withColumn("part", F.shiftright("at", PART_BIT).cast("int")), "indexed")

