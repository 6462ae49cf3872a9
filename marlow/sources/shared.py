"""The folder that driver and executors share, and fresh paths in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only where the setting is absent and all run in one process
    (tests) a temporary folder takes its place; on a cluster the absence is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="marlow-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], True)
    return f"file://{_OWN_DIRS[app]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/marlow/{name}-{uuid.uuid4().hex}"
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, for what must be the same whenever it is read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple, str] = {}


def kept(spark: SparkSession, table: str, name: str, build: Callable[[str], None]) -> str:
    """The path of what ``build(path)`` writes from the files of ``table``: built at the first call of the session, and
    again when the table's files have changed (path, length or time)."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    files = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(hpath, True)
    state = []
    while files.hasNext():
        f = files.next()
        state.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    key = (spark.sparkContext.applicationId, name, tuple(sorted(state)))
    if key not in _KEPT:
        path = scratch(spark, name)
        build(path)
        _KEPT[key] = path
    return _KEPT[key]
