"""Sends the package to the executors, for sessions whose workers don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; Spark hands the archive to executors that join later, too."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    _SENT.add(app)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="marlow-code-")
    path = os.path.join(folder, "marlow.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
