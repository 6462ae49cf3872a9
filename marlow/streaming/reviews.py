"""Review schedules as reviews come: a keyed state that is folded row by row, however long a history is."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "at long, ease double, doubled int, late long"


class Reviews(StatefulProcessor):
    """Ease and interval of one key, and the position of its last review. Reviews of a batch are taken in the order of their
    position; one that isn't beyond the last is late: it is counted and changes nothing, as its place in the order has gone by."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("review", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        last, ease, doubled, late = self.state.get() if self.state.exists() else (None, 2.5, 0, 0)
        for at, q in sorted((int(a), int(q)) for pdf in rows for a, q in zip(pdf["at"], pdf["quality"], strict=True)):
            if last is not None and at <= last:
                late += 1
                continue
            last = at
            if q >= 3:
                ease, doubled = max(1.3, ease + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)), min(doubled + 1, 20)
            else:
                ease, doubled = max(1.3, ease - 0.15), 0
        self.state.update((-1 if last is None else last, ease, doubled, late))
        yield pd.DataFrame({"key": [key[0]], "at": [-1 if last is None else last], "ease": [ease], "interval": [min(365, 2**doubled)], "late": [late]})

    def close(self) -> None:
        pass


def review_stream(reviews: DataFrame) -> DataFrame:
    """``key, at, ease, interval, late`` of each key that has new reviews (``key`` long, ``at``, ``quality``), a row a batch: the
    newest row of a key is its schedule."""
    return reviews.groupBy("key").transformWithStateInPandas(Reviews(), "key long, at long, ease double, interval int, late long", outputMode="Update", timeMode="None")


def with_state_store(spark: SparkSession) -> SparkSession:
    """Keyed state needs the store that Spark ships for it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark
