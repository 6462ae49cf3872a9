"""Nearest neighbours by an inverted file: k-means cells, vectors in a table by cell, probes, exact scores.

The centroids are fitted on a bounded sample; every vector is in the index. A search looks at the cells whose
centroids are nearest to the query, or at all of them, which is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlow.functions.scores import cosine_to
from marlow.operators.blocks import dealt

#: At most so many cells; their centroids are on the driver and in every task.
MOST_CELLS = 4096
#: Centroids are fitted on about so many vectors.
FIT_ROWS = 200_000
#: Vectors of a cell that meet queries in one task.
SLICE_ROWS = 16_384
#: Queries that meet a slice in one task.
BLOCK_ROWS = 2_048


def whole(v: Column) -> Column:
    """A vector that has a direction: not null, without nulls, finite, not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def write_index(vectors: DataFrame, path: str, cells: int | None = None, fit_rows: int = FIT_ROWS, seed: int = 5) -> None:
    """The index of ``vectors`` (id, vector and what filters need) in folder ``path``: ``cells``, partitioned by cell, and ``centroids``.

    Vectors without a direction are left out. There are about sqrt(n) cells unless told otherwise. Rebalancing cuts a cell
    of very many vectors into several files.
    """
    df = vectors.where(whole(F.col("vector")))
    n = df.count()
    k = max(1, min(MOST_CELLS, n, cells or round(n**0.5)))
    if n == 0:
        df.withColumn("cell", F.lit(0)).write.parquet(f"{path}/cells")
        df.sparkSession.createDataFrame([], "cell int, centroid array<double>").write.parquet(f"{path}/centroids")
        return
    dense = array_to_vector(F.transform("vector", lambda x: x.cast("double")))
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, fit_rows / n) * (1 << 30)) + 1
    fitted = KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="features", predictionCol="cell", maxIter=15).fit(df.where(part).select(dense.alias("features")))
    put = fitted.transform(df.withColumn("features", dense)).drop("features").hint("rebalance", "cell")
    put.write.partitionBy("cell").parquet(f"{path}/cells")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(fitted.clusterCenters())]
    df.sparkSession.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")


@dataclass
class VectorIndex:
    """``vectors`` has the columns of the indexed table and ``cell``; ``centroids`` a unit row a cell."""

    vectors: DataFrame
    cells: np.ndarray
    centroids: np.ndarray

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # MOST_CELLS at most
        c = np.array([r.centroid for r in rows]) if rows else np.zeros((0, 1))
        length = np.linalg.norm(c, axis=1, keepdims=True)
        return VectorIndex(spark.read.parquet(f"{path}/cells"), np.array([r.cell for r in rows], int), c / np.where(length == 0, 1, length))

    def probe(self, query: list[float], probes: int) -> list[int]:
        """The cells whose centroids are nearest to the query."""
        if not len(self.cells):
            return []
        order = np.argsort(-(self.centroids @ np.asarray(query, float)), kind="stable")
        return self.cells[order[:probes]].tolist()

    def search(self, query: list[float], k: int = 80, probes: int | None = 10, where: Column | None = None) -> DataFrame:
        """``id, score``: the ``k`` nearest by cosine in the probed cells (None: in all), after the filter if there is one.
        Other cells' files are not read."""
        df = self.vectors if probes is None else self.vectors.where(F.col("cell").isin(self.probe(query, probes)))
        df = df if where is None else df.where(where)
        return df.select("id", cosine_to(F.col("vector"), [float(x) for x in query]).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)

    def search_all(self, queries: DataFrame, k: int = 80, probes: int | None = 10, where: Column | None = None) -> DataFrame:
        """``query_id, id, score, rank``: the ``k`` nearest of each query (query_id, vector) in its probed cells.

        A query goes to each cell it probes, and there to each slice of the cell; slices have about SLICE_ROWS vectors and
        blocks about BLOCK_ROWS queries, however many a cell has. At most ``k`` rows a query and slice leave a task.
        Queries without a direction have no neighbours.
        """
        spark = queries.sparkSession
        kind, asked_kind = self.vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
        df = self.vectors if where is None else self.vectors.where(where)
        q = queries.where(whole(F.col("vector"))).select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
        if probes is None or not len(self.cells):
            q = q.withColumn("cell", F.explode(F.array(*(F.lit(int(c)) for c in self.cells)) if len(self.cells) else F.array().cast("array<int>")))
        else:
            near = spark.sparkContext.broadcast((self.cells, self.centroids))

            @F.pandas_udf("array<int>")
            def probed(v: pd.Series) -> pd.Series:
                cells, centroids = near.value
                order = np.argsort(-(np.stack(v.to_numpy()) @ centroids.T), axis=1, kind="stable")[:, :probes]
                return pd.Series(list(cells[order].astype(np.int32)))

            q = q.withColumn("cell", F.explode(probed("vector")))
        left, right, key = dealt(q, df.select("cell", "id", "vector"), ["cell"], "query_id", "id", BLOCK_ROWS, SLICE_ROWS)

        def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = {"query_id": [], "id": [], "score": []}
            if len(a) and len(b):
                b = b.sort_values("id")
                m = np.stack(b["vector"].to_numpy()).astype(float)
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                w = np.stack(a["vector"].to_numpy()).astype(float)
                scores = (w / np.linalg.norm(w, axis=1, keepdims=True)) @ m.T
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                out = {"query_id": np.repeat(a["query_id"].to_numpy(), top.shape[1]), "id": b["id"].to_numpy()[top].ravel(), "score": np.take_along_axis(scores, top, 1).ravel()}
            return pd.DataFrame(out)

        found = left.select(*key, "query_id", "vector").groupBy(*key).cogroup(right.select(*key, "id", "vector").groupBy(*key)).applyInPandas(best, f"query_id {asked_kind}, id {kind}, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``wanted, hits, recall`` of ``search_all`` results against exact ones."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    g = exact.select("query_id", "id").join(hit, ["query_id", "id"], "left").agg(F.count("*").alias("wanted"), F.count("hit").alias("hits"))
    return g.withColumn("recall", F.col("hits") / F.col("wanted"))
