"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlow.llm.common import written

#: At most so many keys are broadcast as hubs; a key that is no hub has at most that part of all rows, or HUB_ROWS.
HUBS, HUB_ROWS = 2000, 1000


def hub_limit(counts: DataFrame) -> int | None:
    """Rows from which a key is a hub, for ``counts`` (a row a key, ``n`` rows); None if no key is one."""
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    limit = max(HUB_ROWS, (total or 0) // HUBS)
    return limit if (most or 0) > limit else None


def hub_join(rows: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``counts``: a row a key, whose ``n`` is how many rows have it.

    Keys of very many rows are at most HUBS, so they are broadcast, and their rows stay where they are; the
    others meet by a shuffle. Both tables are read more than once: hand over written ones.
    """
    limit = hub_limit(counts)
    if limit is None:
        return rows.join(counts, keys)
    hubs = F.broadcast(counts.where(F.col("n") > limit))
    rest = rows.join(hubs, keys, "left_anti").join(counts.where(F.col("n") <= limit), keys)
    return rows.join(hubs, keys).unionByName(rest)


def hub_semi(rows: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is in ``counts``; keys of very many rows as in ``hub_join``."""
    limit = hub_limit(counts)
    if limit is None:
        return rows.join(counts, keys, "left_semi")
    hubs = F.broadcast(counts.where(F.col("n") > limit))
    return rows.join(hubs, keys, "left_semi").union(rows.join(hubs, keys, "left_anti").join(counts.where(F.col("n") <= limit), keys, "left_semi"))


def hub_anti(rows: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in ``counts``; keys of very many rows as in ``hub_join``."""
    limit = hub_limit(counts)
    if limit is None:
        return rows.join(counts, keys, "left_anti")
    return rows.join(F.broadcast(counts.where(F.col("n") > limit)), keys, "left_anti").join(counts.where(F.col("n") <= limit), keys, "left_anti")


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``node, root`` for each node of ``edges`` (columns ``u``, ``v``, long): root is the smallest node
    of its component. Loops and repeated edges do no harm; an empty table gives no rows.

    Each round is written to the shared folder. Minima are combined before they are sent, and edges of hubs
    don't meet in a task: see ``hub_join``.
    """
    now = written(_oriented(edges.select("u", "v")), "edges")
    before = None
    for _ in range(most_rounds):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        before = mark
        if mark[0] <= HUB_ROWS:  # too few edges for a hub
            now = written(_small_star(_large_star(now, _join), _join), "edges")
        else:
            now = written(_small_star(written(_large_star(now, _hub_join), "stars"), _hub_join), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _oriented(edges: DataFrame) -> DataFrame:
    """Larger end first, no loops, no repeats."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _join(edges: DataFrame, least: DataFrame, key: str) -> DataFrame:
    return edges.join(least, key)


def _hub_join(edges: DataFrame, least: DataFrame, key: str) -> DataFrame:
    return hub_join(edges, written(least, "least"), [key])


def _large_star(edges: DataFrame, join) -> DataFrame:
    """Every node's larger neighbours are tied to the smallest of the node and its neighbours."""
    # edges are oriented: the larger neighbours of v are the u of its rows, and n counts those rows
    both = edges.select(F.col("v").alias("w"), F.col("u").alias("x"), F.lit(1).alias("own")).union(edges.select("u", "v", F.lit(0)))
    least = both.groupBy("w").agg(F.least("w", F.min("x")).alias("m"), F.sum("own").alias("n")).where("n > 0")
    return _oriented(join(edges.withColumnRenamed("v", "w"), least, "w").select("u", F.col("m").alias("v")))


def _small_star(edges: DataFrame, join) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    tied = join(edges, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _oriented(tied.union(least.select("u", "m")))
