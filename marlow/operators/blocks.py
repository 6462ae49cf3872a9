"""Two tables that meet cell by cell, in blocks of bounded size on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(asking: DataFrame, held: DataFrame, cell: list[str], ask_key: str, held_key: str, ask_rows: int, held_rows: int, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables with ``slice`` and ``block`` beside the columns of ``cell``, and the key on which they are cogrouped.

    A cell's held rows are cut into slices of about ``held_rows``, those that ask into blocks of about ``ask_rows``, by a
    hash of their keys; each block meets each slice. ``sizes`` (cell, slices, blocks) spares counting, if they are known. Cells are few (the callers bound their number), so that
    their sizes may be broadcast; a cell of very many rows has many slices, not a large one.
    """
    pieces = lambda df, rows, name: df.groupBy(*cell).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    sizes = F.broadcast(sizes if sizes is not None else pieces(held, held_rows, "slices").join(pieces(asking, ask_rows, "blocks"), cell))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    share = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    left = asking.join(sizes, cell).withColumn("block", share(ask_key, "blocks")).withColumn("slice", every("slices"))
    right = held.join(sizes, cell).withColumn("slice", share(held_key, "slices")).withColumn("block", every("blocks"))
    left, right = left.drop("slices", "blocks"), right.drop("slices", "blocks")
    # both may come from one table: fresh columns keep Spark from taking one side's for the other's
    return left, right.toDF(*right.columns), [*cell, "slice", "block"]
