"""Landed pages of a judge's API as a data source: ``spark.read.format("judge_pages").load(root)``.

A file of the landing zone is one partition, so that pages are read in parallel. Files lie in
``root/platform=<judge>/page=<n>/``; a line is an answer for one user: JSON with ``uid``, ``status``, ``comment`` and
``result``. Filters on platform and page leave files out before anything is read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

#: Pages that are asked for, and entries of a page.
MOST_PAGES, PAGE_ROWS = 5, 20
SCHEMA = "platform string, page int, uid long, ok boolean, comment string, id long, verdict string"


@dataclass
class PageFile(InputPartition):
    path: str
    platform: str
    page: int


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        root = options.get("path", "")
        if "://" in root and not root.startswith("file:"):
            raise ValueError(f"pages are read by Python: {root} must be a folder that is mounted on every machine")
        self.root = "/" + root[len("file:"):].lstrip("/") if root.startswith("file:") else root
        self.most = int(options.get("pages", MOST_PAGES))
        self.rows = int(options.get("rows", PAGE_ROWS))
        self.wanted: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            if isinstance(f, EqualTo | In | LessThan | LessThanOrEqual) and f.attribute in (("platform",), ("page",)):
                self.wanted.append(f)
            else:
                yield f

    def _fits(self, part: PageFile) -> bool:
        for f in self.wanted:
            v = getattr(part, f.attribute[0])
            fits = v in f.value if isinstance(f, In) else v == f.value if isinstance(f, EqualTo) else v < f.value if isinstance(f, LessThan) else v <= f.value
            if not fits:
                return False
        return True

    def partitions(self) -> list[PageFile]:
        out = []
        for folder, _, names in os.walk(self.root):
            at = re.search(r"platform=([^/]+)/page=(\d+)$", folder)
            if at and int(at[2]) <= self.most:
                out += [PageFile(os.path.join(folder, n), at[1], int(at[2])) for n in sorted(names) if not n.startswith((".", "_"))]
        return [p for p in out if self._fits(p)] or [PageFile("", "", 0)]

    def read(self, part: PageFile) -> Iterator[tuple]:
        """Entries of each answer, ``rows`` at most; an answer that failed, or is no answer, is one row that isn't ok."""
        if not part.path:
            return
        with open(part.path, encoding="utf-8") as lines:
            for line in lines:
                try:
                    answer = json.loads(line)
                    entries = answer["result"] if answer["status"] == "OK" else None
                    uid, comment = answer.get("uid"), answer.get("comment")
                except (ValueError, KeyError, TypeError):
                    uid, entries, comment = None, None, "no envelope"
                if not isinstance(entries, list):
                    yield part.platform, part.page, uid, False, comment, None, None
                    continue
                for e in entries[:self.rows]:
                    yield part.platform, part.page, uid, True, None, e.get("id"), e.get("verdict")


class JudgePages(DataSource):
    """Options: ``pages`` (5), the last page that is read, and ``rows`` (20), the entries of a page."""

    @classmethod
    def name(cls) -> str:
        return "judge_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)


def read_pages(spark: SparkSession, root: str, **options) -> DataFrame:
    """Registers the format, lets filters through to it, and loads the pages."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JudgePages)
    return spark.read.format("judge_pages").options(**options).load(root)


def land_pages(records: DataFrame, root: str, rows: int = PAGE_ROWS) -> None:
    """``records`` (platform, uid, id, verdict, status, comment) as pages of ``rows`` entries a user, newest id first; the
    status and comment of a page are those of its first entry."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("platform", "uid").orderBy(F.col("id").desc()))
    paged = records.withColumn("k", k).withColumn("page", F.floor((F.col("k") - 1) / rows).cast("int") + 1)
    entry = F.struct("k", "id", "verdict", "status", "comment")
    pages = paged.groupBy("platform", "page", "uid").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    first = F.get("e", F.lit(0))
    result = F.when(first["status"] == "OK", F.transform("e", lambda x: F.struct(x["id"].alias("id"), x["verdict"].alias("verdict"))))
    value = F.to_json(F.struct("uid", first["status"].alias("status"), first["comment"].alias("comment"), result.alias("result")))
    pages.select("platform", "page", value.alias("value")).hint("rebalance", "platform", "page").write.partitionBy("platform", "page").text(root)
