"""Landing-zone sources and sinks: crawled JSON, page islands, tables in HTML, user lists, snapshots out."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from marlow.functions.identity import file_key, first_filled
from marlow.functions.text import INITIAL_STATE, LENTILLE, page_island
from marlow.sources.shared import scratch

COMMON = ("platform", "source_id", "title", "url", "difficulty_raw", "tags", "content", "raw")


def read_json_files(spark: SparkSession, folder: str, schema: str, date: str | None = None) -> DataFrame:
    """Rows of JSON files (an object or a list each) below ``folder``, with ``file_name`` and ``file_key``.

    Work lists of crawls are skipped, malformed documents dropped; ``date`` keeps files of that prefix.
    """
    glob = f"{date}*.json" if date else "*.json"
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(folder, wholetext=True).withColumn("file_name", F.col("_metadata.file_name"))
    files = files.where(~F.col("file_name").startswith("bulk_list_") & ~F.col("file_name").startswith("bulk_detail_progress_"))
    # an object is read as a list of one; what is no JSON is null and explodes to nothing
    rows = files.select("file_name", F.explode(F.from_json("value", f"array<struct<{_fields(schema)}>>")).alias("r"))
    return rows.select("r.*", "file_name", file_key(F.col("file_name")).alias("file_key"))


def _fields(schema: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString()[len("struct<"):-1]


def read_kinds(spark: SparkSession, root: str, platform: str, schema: str, kinds=("problems", "profiles", "records", "solutions")) -> DataFrame:
    """The four folders of a platform in one frame with ``kind``; folders that are missing are left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = None
    for kind in kinds:
        path = f"{root}/{platform}/{kind}"
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            one = read_json_files(spark, path, schema).withColumn("kind", F.lit(kind))
            out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], f"{schema}, file_name string, file_key string, kind string")


def unprocessed(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that the ledger of imports doesn't name; nothing is deleted after an import."""
    return files.join(ledger.select("file_name"), "file_name", "left_anti")


def first_filled_source(*sources: DataFrame | None) -> DataFrame:
    """The first source that has a row; else the last, empty."""
    given = [s for s in sources if s is not None]
    for s in given:
        if not s.isEmpty():
            return s
    return given[-1]


def read_problems(spark: SparkSession, base: str, platform: str, date: str, schema: str, count: int = 0, order: tuple[str, ...] = ()) -> DataFrame:
    """A date partition in file order, within a file by the columns ``order``; all rows where ``count`` is 0.
    Only the files of that platform and date are read."""
    df = spark.read.schema(f"{schema}, platform string, date string").json(base).where((F.col("platform") == platform) & (F.col("date") == date))
    df = df.withColumn("__file", F.col("_metadata.file_path")).orderBy("__file", *order).drop("__file")
    return df.limit(count) if count else df


def write_landing(df: DataFrame, root: str, kind: str) -> None:
    """The files of crawls: of each ``platform`` and ``day`` (yyyy-mm-dd) a JSON list ``root/platform/kind/day_platform.json``
    of the other columns. A day's crawl of a platform is one group. Files get their names from the driver, one rename for
    each platform and day: some thousands a year, whatever the rows."""
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in ("platform", "day")]
    lists = df.groupBy("platform", "day").agg(F.to_json(F.collect_list(F.struct(*rest))).alias("value"))
    staged = scratch(spark, "landing")
    lists.write.partitionBy("platform", "day").text(staged)
    fs, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    store = fs.Path(staged).getFileSystem(conf)
    for f in store.globStatus(fs.Path(staged, "platform=*/day=*/part-*")):
        day, platform = (f.getPath().getParent().getName()[4:], f.getPath().getParent().getParent().getName()[9:])
        folder = fs.Path(f"{root}/{platform}/{kind}")
        store.mkdirs(folder)
        store.rename(f.getPath(), fs.Path(folder, f"{day}_{platform}.json"))


def put_file(spark: SparkSession, path: str, text: str) -> None:
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(text.encode()))
    out.close()


def write_enriched(df: DataFrame, base: str, mode: str = "append") -> None:
    """JSON by platform and date."""
    df.write.mode(mode).partitionBy("platform", "date").json(base)


def append_failures(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def to_sink(df: DataFrame, send: Callable[[dict], None]) -> None:
    """Hands every row to ``send`` on the executors (webhook, REST)."""

    def rows(it) -> None:
        for r in it:
            send(r.asDict(recursive=True))

    df.foreachPartition(rows)


def send_and_log(df: DataFrame, send: Callable[[dict], None], key: str) -> DataFrame:
    """Hands every row to ``send`` on the executors and returns ``key, ok, error`` of each attempt, for the log. An
    attempt that fails stops nothing. A task that is run again sends again: receivers must know rows by their key."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            log = []
            for row in b.to_pylist():
                try:
                    send(row)
                    log.append((row[key], True, None))
                except Exception as e:  # whatever a sink raises belongs in the log
                    log.append((row[key], False, str(e)[:500]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in log], b.schema.field(key).type), pa.array([x[1] for x in log], pa.bool_()), pa.array([x[2] for x in log], pa.string())], [key, "ok", "error"])

    return df.mapInArrow(run, f"`{key}` {kind}, ok boolean, error string")


def codeforces_envelope(raw: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of ``{status, result: [...]}`` responses with status OK."""
    parsed = raw.select(F.from_json(column, f"status string, result array<struct<{schema}>>").alias("x"))
    return parsed.where("x.status = 'OK'").select(F.explode("x.result").alias("r")).select("r.*")


def leetcode_problems(df: DataFrame) -> DataFrame:
    """Free problems; translated title and content first."""
    return df.where(~F.coalesce("paidOnly", F.lit(False))).select(
        F.lit("leetcode").alias("platform"), F.col("titleSlug").alias("source_id"), first_filled(F.col("translatedTitle"), F.col("title")).alias("title"),
        F.col("difficulty").alias("difficulty_raw"), F.transform("topicTags", lambda t: t["slug"]).alias("tags"), first_filled(F.col("translatedContent"), F.col("content")).alias("content"),
    )


def luogu_island(pages: DataFrame, schema: str, column: str = "html") -> DataFrame:
    return pages.withColumn("island", F.from_json(page_island(F.col(column), LENTILLE), schema))


def nowcoder_island(pages: DataFrame, schema: str, column: str = "html") -> DataFrame:
    return pages.withColumn("island", F.from_json(page_island(F.col(column), INITIAL_STATE), schema))


def nowcoder_submissions(pages: DataFrame, table_rows: Callable[[DataFrame], DataFrame], column: str = "html") -> DataFrame:
    """``submission_id, verdict_raw`` of pages: the list in the page's island, or for pages without one the rows of its
    HTML table. ``table_rows`` makes rows of cells out of pages (see ``HtmlTableRows``)."""
    found = nowcoder_island(pages, "list array<struct<submission_id: bigint, verdict_raw: string>>", column)
    from_island = found.where("island.list is not null").select(F.inline("island.list"))
    bare = found.where("island.list is null").drop("island")
    return from_island.unionByName(submission_table(table_rows(bare)).select("submission_id", "verdict_raw"))


def atcoder_problems(merged: DataFrame, contests: DataFrame, models: DataFrame) -> DataFrame:
    """Problems with the contest and the difficulty model; both maps hold a row a problem."""
    return merged.join(contests.select(F.col("problem_id").alias("id"), "contest_id"), "id", "left").join(models.select("id", "difficulty"), "id", "left")


def as_common(df: DataFrame, platform: str, names: dict[str, str]) -> DataFrame:
    """The common record of all adapters; ``names`` maps its columns to those of ``df``, the rest are null."""
    kinds = {"tags": "array<string>"}
    cols = [F.lit(platform).alias("platform")]
    for c in COMMON[1:]:
        src = F.to_json(F.struct(*df.columns)) if c == "raw" else F.col(names[c]) if c in names else F.lit(None)
        cols.append(src.cast(kinds.get(c, "string")).alias(c))
    return df.select(*cols)


class _Rows(HTMLParser):
    """Cells (text, first link) of all table rows."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[list[str]]] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append(["", ""])
            self.inside = True
        elif tag == "a" and self.inside and self.rows and self.rows[-1] and not self.rows[-1][-1][1]:
            self.rows[-1][-1][1] = dict(attrs).get("href") or ""

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.inside = False

    def handle_data(self, data):
        if self.inside and self.rows and self.rows[-1]:
            self.rows[-1][-1][0] += data


@udtf(returnType="row int, cells array<string>, links array<string>")
class HtmlTableRows:
    """Rows of tables in a page: texts and links of their cells."""

    def eval(self, html: str):
        if html:
            p = _Rows()
            p.feed(html)
            for i, r in enumerate(p.rows):
                if r:
                    yield i, [" ".join(c[0].split()) for c in r], [c[1] for c in r]


def submission_table(rows: DataFrame) -> DataFrame:
    """Submissions of (id, problem, verdict, language, time) rows; headers have no number in front."""
    c = F.col("cells")
    return rows.where(F.get(c, F.lit(0)).rlike(r"^\d+$")).select(
        F.get(c, F.lit(0)).cast("long").alias("submission_id"), F.get(c, F.lit(1)).alias("problem"), F.get(c, F.lit(2)).alias("verdict_raw"), F.get(c, F.lit(3)).alias("language"), F.get(c, F.lit(4)).alias("submitted"),
    )


def problem_table(rows: DataFrame, most: int = 0, page: str | None = None) -> DataFrame:
    """Problems of list pages: header cells 难度 and 标签 tell the columns, a link the id; one row an id, from
    its first row. ``page`` is the column that tells pages apart, whose rows meet their own header; without it
    all rows are of one page."""
    rows = rows.withColumn("__page", F.col(page) if page else F.lit(0))
    at = lambda word: F.array_position(F.transform("cells", lambda x: x.contains(word)), True)
    header = rows.where(F.exists("cells", lambda x: x.contains("难度"))).groupBy("__page").agg(F.min_by(F.struct(at("难度").alias("d"), at("标签").alias("t")), "row").alias("h")).select("__page", "h.*")
    pid = F.regexp_extract(F.array_join("links", " "), r"/problem/(\d+)", 1)
    cell = lambda i: F.get("cells", (i - 1).cast("int"))
    out = rows.where(pid != "").join(header, "__page").select("__page", "row", pid.alias("id"), F.when(F.col("d") > 0, cell(F.col("d"))).alias("difficulty"), F.when(F.col("t") > 0, F.split(cell(F.col("t")), r"[,，\s]+")).alias("tags"))
    k = F.row_number().over(Window.partitionBy("id").orderBy("__page", "row"))
    out = out.withColumn("__k", k).where("__k = 1").orderBy("__page", "row").drop("__page", "row", "__k")
    return out.limit(most) if most else out


def problem_ids(df: DataFrame) -> DataFrame:
    """Distinct ``contestId + index``, in order."""
    return df.select(F.concat(F.col("contestId").cast("string"), "index").alias("id")).where("id is not null").distinct().orderBy("id")
