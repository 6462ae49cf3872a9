"""Merkle manifest of a dataset: a tree of digests a group, and a tree over the groups' roots.

Rows are put in order by ranges. Each range walks its rows with a stack of mountains: a node completed by ``fanout``
nodes carries into the level above. Nodes whose parent reaches over an edge of the range are left, and merged
level by level; there are at most 2 * (fanout - 1) of them a level and range.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlow.llm.common import by_bucket, id_remainder, indexed, written

FANOUT = 8
ROWS_EACH = 20_000
#: Levels that are merged at a time.
BAND = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE = "grp string, level int, idx long, digest string, size long"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def count_at(size: int, level: int, fanout: int) -> int:
    """Nodes of a level over ``size`` leaves."""
    for _ in range(level):
        size = -(-size // fanout)
    return size


def height(size: int, fanout: int) -> int:
    h = 0
    while size > 1:
        size, h = -(-size // fanout), h + 1
    return h


class Mountains:
    """A stack of unfinished runs, one a level, over leaves ``start``, ``start + 1``, ... of ``size``.

    A run that ends (with its ``fanout``-th node, or with the last of its level, without padding) becomes a node above
    if it began at a run's beginning. Else its nodes are ``left``, as are those of runs that are open at the
    end: other ranges have the rest. The top of a tree is left, too. ``seen`` has every node made or pushed.
    """

    def __init__(self, start: int, size: int, fanout: int):
        self.next, self.fanout = start, fanout
        self.counts = [size]
        while self.counts[-1] > 1:
            self.counts.append(-(-self.counts[-1] // fanout))
        self.runs: list[list[str]] = [[] for _ in self.counts]
        self.left: list[tuple[int, int, str]] = []
        self.seen: list[dict[int, str]] = [{} for _ in self.counts]

    def push(self, leaf: str) -> None:
        index, node, level = self.next, leaf, 0
        self.next += 1
        while True:
            run = self.runs[level]
            run.append(node)
            self.seen[level][index] = node
            if (index + 1) % self.fanout and index + 1 < self.counts[level]:
                return
            self.runs[level] = []
            first = index + 1 - len(run)
            if self.counts[level] == 1 or first % self.fanout:
                self.left += [(level, first + i, x) for i, x in enumerate(run)]
                return
            index, node, level = index // self.fanout, digest("".join(run)), level + 1

    def close(self) -> list[tuple[int, int, str]]:
        """All nodes that are left."""
        at = self.next
        for level, run in enumerate(self.runs):
            # the nodes of this level that are finished end where the next leaf's ancestor stands
            end = at // self.fanout**level
            self.left += [(level, end - len(run) + i, x) for i, x in enumerate(run)]
        self.runs = [[] for _ in self.runs]
        return self.left


@dataclass
class Tree:
    """``rows`` (grp, leaf, at, part and what else the caller has), ``segments`` (part, grp, start, first, n, size) and
    ``edges`` (NODE: every node of the runs that no range has whole, and the top of each group)."""

    rows: DataFrame
    segments: DataFrame
    edges: DataFrame
    parts: int
    fanout: int

    def tops(self) -> DataFrame:
        """``grp, size, digest``: the top node of each group."""
        return self.edges.where((F.col("idx") == 0) & _last_level(self.fanout)).select("grp", "size", "digest")


def _last_level(fanout: int) -> Column:
    """Whether the node's level has one node: size <= fanout ** level."""
    return F.col("size") <= F.pow(F.lit(fanout), F.col("level")).cast("decimal(38,0)")


def _joined(rows: DataFrame, parts: int, more: list[DataFrame], fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` of each part: its rows (kind 0) and the rows that ``more`` has for it."""
    meet = rows.withColumn("kind", F.lit(0))
    for i, df in enumerate(more, 1):
        meet = meet.unionByName(df.withColumn("kind", F.lit(i)), allowMissingColumns=True)
    return by_bucket(meet, parts, "part").applyInArrow(fn, schema)


def _split(table: pa.Table) -> dict[int, list[dict]]:
    """Rows by kind; those of kind 0 in order."""
    out: dict[int, list[dict]] = {0: [], 1: [], 2: [], 3: []}
    for r in table.to_pylist():
        out[r["kind"]].append(r)
    out[0].sort(key=lambda r: r["at"])
    return out


def build(leaves: DataFrame, order: list[str], fanout: int = FANOUT, rows_each: int = ROWS_EACH) -> Tree:
    """A tree a group over ``leaves`` (grp not null, leaf, and the columns of ``order``, the last of which tells rows apart)."""
    rows = indexed(leaves, ["grp", *order], rows_each)
    found = rows.groupBy("part", "grp").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    w = Window.partitionBy("grp")  # a row a range that the group reaches into
    start = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    segments = written(found.withColumn("start", start).withColumn("size", F.sum("n").over(w)), "segments")

    def walk(table: pa.Table) -> pa.Table:
        kinds = _split(table)
        stacks = {s["grp"]: (Mountains(s["start"], s["size"], fanout), s["size"]) for s in kinds[1]}
        for r in kinds[0]:
            stacks[r["grp"]][0].push(r["leaf"])
        out = [(grp, *node, size) for grp, (stack, size) in stacks.items() for node in stack.close()]
        return pa.table(list(map(list, zip(*out, strict=True))) if out else [[]] * 5, schema=pa.schema([("grp", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("size", pa.int64())]))

    last, largest = segments.agg(F.max("part"), F.max("size")).first()
    parts = (last or 0) + 1
    left = edges = written(_joined(rows.select("part", "grp", "leaf", "at"), parts, [segments.select("part", "grp", "start", "size")], walk, NODE), "left")
    nodes = left
    for base in range(0, height(largest or 0, fanout), BAND):
        made = written(_merged(nodes, base, fanout), "nodes")
        edges = edges.unionByName(made)
        nodes = left.unionByName(made)
    return Tree(rows, segments, edges, parts, fanout)


def _merged(nodes: DataFrame, base: int, fanout: int) -> DataFrame:
    """Nodes of levels ``base`` + 1 to ``base`` + BAND that those below them make. A group has the nodes below one node of
    the upper level, so fanout ** BAND of a level at most."""
    arrow = pa.schema([("grp", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("size", pa.int64())])

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        grp, size = rows[0]["grp"], rows[0]["size"]
        at: dict[int, dict[int, str]] = {}
        for r in rows:
            at.setdefault(r["level"], {})[r["idx"]] = r["digest"]
        made = []
        for level in range(base, base + BAND):
            if count_at(size, level, fanout) == 1:
                break
            below = at.get(level, {})
            for parent in sorted({i // fanout for i in below}):
                first = parent * fanout
                node = digest("".join(below[i] for i in range(first, min(first + fanout, count_at(size, level, fanout)))))
                at.setdefault(level + 1, {})[parent] = node
                made.append((grp, level + 1, parent, node, size))
        return pa.table(list(map(list, zip(*made, strict=True))) if made else [[]] * 5, schema=arrow)

    under = F.pow(F.lit(fanout), base + BAND - F.col("level")).cast("long")
    band = nodes.where((F.col("level") >= base) & (F.col("level") < base + BAND)).withColumn("cell", F.call_function("div", F.col("idx"), under))
    return band.groupBy("grp", "cell").applyInArrow(merge, NODE)


def prove(tree: Tree, above: DataFrame | None, fn: Callable[[dict, list[tuple[str, str]], str, str | None], tuple], schema: str) -> DataFrame:
    """``fn(row, path, top, root)`` of each row, as rows of ``schema``.

    ``path`` lists, from the leaf's level up, what stands left and right of the node in its run. ``above`` (grp, path, root)
    goes on with it from the group's top. A range gets the nodes of those runs of its ends' ancestors that reach
    beyond it: at most 2 * (fanout - 1) a level.
    """
    fanout = tree.fanout
    levels = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log(F.col("size").cast("double")) / F.log(F.lit(float(fanout)))).cast("int")))).alias("level")
    ends = tree.segments.select("part", "grp", levels, "size", F.explode(F.array_distinct(F.array("start", F.col("start") + F.col("n") - 1))).alias("leaf_at"))
    run = lambda c: F.floor(c / F.pow(F.lit(fanout), F.col("level") + 1).cast("decimal(38,0)")).cast("long")
    wanted = ends.select("part", "grp", "level", run(F.col("leaf_at")).alias("run")).distinct()
    nodes = tree.edges.withColumn("run", F.floor(F.col("idx") / fanout)).join(wanted, ["grp", "level", "run"]).select("part", "grp", "level", "idx", "digest")
    more = [tree.segments.select("part", "grp", "start", "size"), nodes]
    if above is not None:
        more.append(tree.segments.select("part", "grp").join(above, "grp"))

    def walk(table: pa.Table) -> pa.Table:
        kinds = _split(table)
        stacks = {s["grp"]: Mountains(s["start"], s["size"], fanout) for s in kinds[1]}
        starts = {s["grp"]: s["start"] for s in kinds[1]}
        for r in kinds[0]:
            stacks[r["grp"]].push(r["leaf"])
        for r in kinds[2]:
            stacks[r["grp"]].seen[r["level"]][r["idx"]] = r["digest"]
        beyond = {r["grp"]: ([tuple(x) for x in r["path"]], r["root"]) for r in kinds[3]}
        uppers: dict[tuple[str, int], list[tuple[str, str]]] = {}
        out = []

        def sides(stack: Mountains, level: int, index: int) -> tuple[str, str]:
            first = index - index % fanout
            seen = stack.seen[level]
            return "".join(seen[i] for i in range(first, index)), "".join(seen[i] for i in range(index + 1, min(first + fanout, stack.counts[level])))

        for r in kinds[0]:
            grp = r["grp"]
            stack, index = stacks[grp], starts[grp]
            starts[grp] += 1
            tallest = len(stack.counts) - 1
            key = (grp, index // fanout)
            if key not in uppers:
                uppers[key] = [sides(stack, level, index // fanout**level) for level in range(1, tallest)] + beyond.get(grp, ([], None))[0]
            path = ([sides(stack, 0, index)] if tallest else []) + uppers[key]
            out.append(fn(r, path, stack.seen[tallest][0], beyond.get(grp, ([], None))[1]))
        return pa.table(list(map(list, zip(*out, strict=True))) if out else [[]] * len(arrow), schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return _joined(tree.rows, tree.parts, more, walk, schema)


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaves(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, grp, leaf, tampered, uid``, written: a leaf's digest, and (else null) that of the tampered row."""
    of = lambda text: F.sha2(F.concat(*(field(F.col(c)) for c in (id_col, "source", "lang", "n_chars")), field(text)), 256)
    text = F.col(text_col)
    tampered = F.when((id_remainder(F.col(id_col), 3) == 0) & text.rlike("[A-Z]"), of(F.translate(text, UPPER, LOWER)))
    grp = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return written(docs.select(F.col(id_col).alias("doc_id"), grp.alias("grp"), of(text).alias("leaf"), tampered.alias("tampered"), F.monotonically_increasing_id().alias("uid")), "leaves")


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that follows from a leaf and what stands beside its path."""
    for before, after in path:
        leaf = digest(before + leaf + after)
    return leaf


def proof_of(path: list[tuple[str, str]]) -> str:
    return digest("".join(x for sides in path for x in sides))


def forest(docs: DataFrame, fanout: int = FANOUT, rows_each: int = ROWS_EACH, id_col: str = "doc_id", text_col: str = "text") -> tuple[Tree, DataFrame]:
    """The trees of all languages, and ``grp, path, root`` of each language's place in the tree over them."""
    tree = build(leaves(docs, id_col, text_col), ["doc_id", "leaf", "uid"], fanout, rows_each)
    tops = tree.tops().select(F.lit("").alias("grp"), F.col("digest").alias("leaf"), F.col("grp").alias("of"))
    over = build(tops, ["of"], fanout, rows_each)
    above = prove(over, None, lambda r, path, top, _: (r["of"], [list(x) for x in path], top), "grp string, path array<array<string>>, root string")
    return tree, written(above, "above")


def verify(docs: DataFrame, fanout: int = FANOUT, rows_each: int = ROWS_EACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    The columns doc_id, source, lang, n_chars and text make a leaf; null values count as ``-``. Languages are groups (null
    first); leaves ascend by id (null first), then by digest. Rows that are equal in all five are neighbours, each
    with its own place and proof. A row is tampered with if 3 divides the crc32 of its id (null: empty): A to Z
    in its text become small letters. Further columns are not read. An empty table gives no rows.
    """
    tree, above = forest(docs, fanout, rows_each, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def result(r: dict, path: list[tuple[str, str]], top: str, root: str) -> tuple:
        folded = fold(r["tampered"] or r["leaf"], path)
        return r["doc_id"], r["leaf"], top, root, proof_of(path), folded, folded == root

    return prove(tree, above, result, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").withColumnRenamed("doc_id", id_col)


def manifest(docs: DataFrame, fanout: int = FANOUT, rows_each: int = ROWS_EACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``lang, rows, subroot, root``: what a dataset is checked against; lang ascends, null first."""
    tree, above = forest(docs, fanout, rows_each, id_col, text_col)
    lang = F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30))
    return tree.tops().join(above.select("grp", "root"), "grp").select(lang.alias("lang"), F.col("size").alias("rows"), F.col("digest").alias("subroot"), "root")
