"""A log of snapshots with optimistic commits: a writer whose base is no longer the newest starts over, or fails.

A version is a folder of Parquet files and an entry in the log, ``log/<number>``. The entry is what publishes it, and is
made only if no other writer has made that number: by a link on a local file system, else by a rename that doesn't
replace, which HDFS does in one step. A store without such a rename needs a lock beside it.
"""

from __future__ import annotations

import os
import random
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed on the same base."""


def _store(spark: SparkSession, root: str):
    fs, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    path = fs.Path(root)
    return fs, path.getFileSystem(conf), conf


def version(spark: SparkSession, root: str) -> int:
    """The newest version; 0 before the first."""
    fs, store, _ = _store(spark, root)
    log = fs.Path(f"{root}/log")
    if not store.exists(log):
        return 0
    names = [s.getPath().getName() for s in store.listStatus(log)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def read(spark: SparkSession, root: str, at: int | None = None) -> DataFrame:
    """A version's rows, the newest unless told otherwise. A version never changes once it is there."""
    n = version(spark, root) if at is None else at
    folder = spark.read.text(f"{root}/log/{n:020d}").first()[0]
    return spark.read.parquet(f"{root}/{folder}")


def commit(df: DataFrame, root: str, base: int) -> int:
    """Write ``df`` and publish it as version ``base`` + 1; ``Conflict`` if there is one already. What was written for a
    commit that failed is removed, and was never seen by a reader."""
    spark = df.sparkSession
    fs, store, conf = _store(spark, root)
    folder = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    part, final = f"{root}/log/.{folder}", f"{root}/log/{base + 1:020d}"
    out = store.create(fs.Path(part), True)
    out.write(bytearray(folder.encode()))
    out.close()
    try:
        if store.getScheme() == "file":
            plain = lambda p: fs.Path(p).toUri().getPath()
            os.link(plain(part), plain(final))
        else:
            files = fs.FileContext.getFileContext(store.getUri(), conf)
            none = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
            files.rename(files.makeQualified(fs.Path(part)), files.makeQualified(fs.Path(final)), none)
    except (FileExistsError, Py4JJavaError) as e:
        taken = store.exists(fs.Path(final))
        store.delete(fs.Path(f"{root}/{folder}"), True)
        if not taken:
            raise
        raise Conflict(f"version {base + 1} of {root} is there already") from e
    finally:
        store.delete(fs.Path(part), False)
    return base + 1


def update(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame], tries: int = 10) -> int:
    """Commit ``change`` of the newest version. Where another writer was first, ``change`` runs again on what it wrote, so
    that nobody's rows are lost; after ``tries`` the conflict is raised."""
    for i in range(tries):
        base = version(spark, root)
        try:
            return commit(change(read(spark, root, base)), root, base)
        except Conflict:
            if i == tries - 1:
                raise
            time.sleep(random.uniform(0, 0.05 * 2**min(i, 5)))
    raise AssertionError("unreachable")
