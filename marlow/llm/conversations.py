"""Repair of conversation structure: cheapest edits by Dial's bucket queue, and the least of their audits.

A conversation is a string of symbols, one a row. Positions and what has been said last make a graph whose arcs are
edits of small whole costs. Distances to the end come from a bucket queue; the audit follows tight arcs, the least
letter first. A state and a letter have one successor, so that there is one walk.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlow.llm.common import arrow_map, indexed, slices, written
from marlow.llm.components import hub_join

ROWS_EACH = 20_000
INITIALS, FAULTS = "sua?", ("", "truncated", "blank", "duplicate")
#: Costs of edits, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: States: nothing yet, after the system's turn, after the user's, after the assistant's. Audits may end in 0 or 3.
ENDS = (0, 3)
STATES = range(4)
SPEAKS = (2, 2, 3, 2)  # state after the next turn of user or assistant
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FAR = 1 << 60
WORD = r"[^\x20\x09-\x0D]"


def symbol(initial: Column, fault: Column) -> Column:
    """A letter for the first letter of the role (s, u, a or another) and the row's fault (0 to 3)."""
    i = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.char(65 + 4 * i + fault)


def of_symbol(code: str) -> tuple[str, int]:
    n = ord(code) - 65
    return INITIALS[n // 4], n % 4


def arcs(code: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, state after, cost) of the edits that take the row ``code``, by letter."""
    initial, fault = of_symbol(code)
    out = [("D", state, DELETE)]
    if fault < 2:
        if (state, initial) in AFTER:
            out.append(("K", AFTER[state, initial], KEEP + CUT * fault))
        out.append(("R", SPEAKS[state], REROLE + CUT * fault))
    return out


def distances(codes: str, ends: dict[int, int]) -> list[list[int]]:
    """[row][state]: the least cost from there to the end, where a state costs what ``ends`` says.

    Dial: a bucket for each cost; arcs cost 7 at most, so buckets are emptied in order of cost, in a ring of as many
    as the largest arc and the ends' costs need. Arcs are walked backwards.
    """
    n = len(codes)
    back = {c: [[(s, cost) for s in STATES for _, t, cost in arcs(c, s) if t == to] for to in STATES] for c in set(codes)}
    speak_back = [[s for s in STATES if SPEAKS[s] == to] for to in STATES]
    least = [[FAR] * 4 for _ in range(n + 1)]
    if not ends:
        return least
    base = min(ends.values())
    width = max(8, max(ends.values()) - base + 1)
    ring: list[list[tuple[int, int]]] = [[] for _ in range(width)]
    waiting = 0
    for s, c in ends.items():
        ring[c - base].append((n, s))
        least[n][s] = c
        waiting += 1
    cost, base_end = base, n
    while waiting:
        bucket = ring[(cost - base) % width]
        while bucket:
            i, s = bucket.pop()
            waiting -= 1
            if least[i][s] != cost:
                continue
            # turns are inserted before a row; at the end of all rows, ``ends`` has them
            if i < base_end:
                for t in speak_back[s]:
                    if cost + INSERT < least[i][t]:
                        least[i][t] = cost + INSERT
                        ring[(cost + INSERT - base) % width].append((i, t))
                        waiting += 1
            if i:
                row = least[i - 1]
                for t, c in back[codes[i - 1]][s]:
                    if cost + c < row[t]:
                        row[t] = cost + c
                        ring[(cost + c - base) % width].append((i - 1, t))
                        waiting += 1
        cost += 1
    return least


#: What is left to pay after the last row: user and assistant may still be inserted.
LAST = {0: 0, 1: 2 * INSERT, 2: INSERT, 3: 0}


def walk(codes: str, least: list[list[int]], state: int) -> tuple[str, int]:
    """(audit, state at the end): tight arcs, the least letter first, until the last row is taken."""
    out, i = [], 0
    while i < len(codes):
        here = least[i][state]
        choices = [(x, i + 1, s, c) for x, s, c in arcs(codes[i], state)] + [("I", i, SPEAKS[state], INSERT)]
        letter, i, state = min((x, j, s) for x, j, s, c in choices if least[j][s] + c == here)
        out.append(letter)
    return "".join(out), state


def tail(state: int) -> tuple[str, int]:
    """Inserts after the last row."""
    return "I" * (LAST[state] // INSERT), LAST[state]


def cheapest(codes: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    least = distances(codes, LAST)
    audit, state = walk(codes, least, 0)
    return least[0][0], audit + tail(state)[0]


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with every row's damage by crc32(conv_id:turn) modulo 20: 0 is dropped, 1 loses its
    text, 2 its sentence marks, 3 stands twice, 4 speaks as user. Nulls count as one space; the turn stays null."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text, role = blank("text"), blank("role")
    out = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), kind.alias("kind"),
    ).where("kind <> 0")
    return out.withColumn("twice", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "twice")


def conv_key(c: Column) -> Column:
    """A text that is null for no id, and tells null from all ids."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def marked(rows: DataFrame) -> DataFrame:
    """What the structure needs of each row: ``conv, turn, role, mark, initial, fault`` (0, 1 truncated, 2 blank)."""
    text = F.col("text")
    last = F.regexp_extract(text, rf"({WORD})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~text.rlike(WORD), 2).when(~last.isin(".", "!", "?"), 1).otherwise(0)
    return rows.select(conv_key(F.col("conv_id")).alias("conv"), "turn", "role", F.md5(text.cast("binary")).alias("mark"), F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))


def pieces(rows: DataFrame, rows_each: int = ROWS_EACH) -> DataFrame:
    """``conv, part, codes, turn, role, mark``: runs of a conversation's rows, in order, as symbols, each with the order key
    of its first row; a long conversation is several pieces of at most about ``rows_each`` rows.

    Rows are put in ranges of (conversation, turn, role, text's digest). A duplicate is a row whose conversation, role
    and text stand before it: the first of each is found by a partial aggregate, and only those that repeat are joined.
    """
    at = indexed(marked(rows).withColumn("uid", F.monotonically_increasing_id()), ["conv", "turn", "role", "mark", "uid"], rows_each)
    repeated = at.groupBy("conv", "role", "mark").agg(F.min("at").alias("earliest"), F.count("*").alias("n")).where("n > 1")
    repeated = written(repeated, "repeats")
    again = hub_join(at.select("conv", "role", "mark", "at"), repeated, ["conv", "role", "mark"]).where("at > earliest").select("at", F.lit(True).alias("again"))
    rows = at.join(again, "at", "left")
    fault = F.when(F.col("fault") == 2, 2).when(F.col("again"), 3).otherwise(F.col("fault"))
    row = F.struct("at", symbol(F.col("initial"), fault).alias("code"))
    g = rows.groupBy("conv", "part").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.min_by(F.struct("turn", "role", "mark"), "at").alias("first"))
    return g.select("conv", "part", F.array_join(F.col("rows.code"), "").alias("codes"), "first.turn", "first.role", "first.mark")


def solved(found: DataFrame) -> DataFrame:
    """``pieces`` with ``audit`` (inserts after the last row belong to the last piece) and ``cost`` (of the conversation,
    on its first piece).

    Conversations of one piece are solved at once. Of the others, each piece gives its 4 x 4 table of costs from state to
    state; tables are combined from the last piece backwards, a row a piece in one task; with the costs beyond each
    piece known, pieces say which state follows from which, and then where the walk goes.
    """
    found = written(found.withColumn("n", F.count("*").over(Window.partitionBy("conv"))), "pieces")
    columns = ["conv", "part", "codes", "turn", "role", "mark"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.select(*columns).schema)

    def with_columns(b: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
        keep = [c for c in columns if c in b.schema.names]
        return pa.record_batch([*(b.column(c) for c in keep), *more.values()], names=[*keep, *more])

    def whole(batches):
        for b in slices(batches, 2000):
            got = [cheapest(c) for c in b.column("codes").to_pylist()]
            yield with_columns(b, audit=pa.array([a for _, a in got], pa.string()), cost=pa.array([c for c, _ in got], pa.int64()))

    short = arrow_map(found.where("n = 1").select(*columns), whole, f"{schema}, audit string, cost long")
    parts = found.where("n > 1")
    # column j of a piece's table: costs of each state at its first row, if it is left in state j
    def tables(batches):
        for b in slices(batches, 200):
            got = [[x for j in STATES for x in distances(c, {j: 0})[0]] for c in b.column("codes").to_pylist()]
            yield pa.record_batch([b.column("conv"), b.column("part"), pa.array(got, pa.list_(pa.int64()))], names=["conv", "part", "table"])

    costs = arrow_map(parts.select("conv", "part", "codes"), tables, "conv string, part int, table array<long>")

    def backwards(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["part"].to_pylist(), table["table"].to_pylist(), strict=True), reverse=True)
        beyond, out = [LAST[s] for s in STATES], []
        for part, t in rows:
            out.append((part, beyond))
            beyond = [min(FAR, *(t[4 * j + s] + beyond[j] for j in STATES)) for s in STATES]
        conv = table["conv"][0].as_py()
        return pa.table({"conv": [conv] * len(out), "part": pa.array([p for p, _ in out], pa.int32()), "beyond": [b for _, b in out]})

    ends = costs.groupBy("conv").applyInArrow(backwards, "conv string, part int, beyond array<long>")
    priced = written(parts.join(ends, ["conv", "part"]).select(*columns, "beyond"), "priced")

    def steps(batches):
        for b in slices(batches, 200):
            got, first = [], []
            for codes, beyond in zip(b.column("codes").to_pylist(), b.column("beyond").to_pylist(), strict=True):
                least = distances(codes, {s: c for s, c in enumerate(beyond) if c < FAR})
                got.append([walk(codes, least, s)[1] if least[0][s] < FAR else -1 for s in STATES])
                first.append(least[0][0])
            yield pa.record_batch([b.column("conv"), b.column("part"), pa.array(got, pa.list_(pa.int32())), pa.array(first, pa.int64())], names=["conv", "part", "next", "cost"])

    moves = arrow_map(priced.select("conv", "part", "codes", "beyond"), steps, "conv string, part int, next array<int>, cost long")

    def forwards(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["part"].to_pylist(), table["next"].to_pylist(), table["cost"].to_pylist(), strict=True))
        state, out = 0, []
        for part, step, cost in rows:
            out.append((part, state, cost if part == rows[0][0] else 0, part == rows[-1][0]))
            state = step[state]
        conv = table["conv"][0].as_py()
        cols = list(zip(*out, strict=True))
        return pa.table({"conv": [conv] * len(out), "part": pa.array(cols[0], pa.int32()), "state": pa.array(cols[1], pa.int32()), "cost": pa.array(cols[2], pa.int64()), "last": pa.array(cols[3], pa.bool_())})

    starts = moves.groupBy("conv").applyInArrow(forwards, "conv string, part int, state int, cost long, last boolean")

    def walked(batches):
        for b in slices(batches, 200):
            audits = []
            for codes, beyond, state, last in zip(*(b.column(c).to_pylist() for c in ("codes", "beyond", "state", "last")), strict=True):
                audit, end = walk(codes, distances(codes, {s: c for s, c in enumerate(beyond) if c < FAR}), state)
                audits.append(audit + (tail(end)[0] if last else ""))
            yield with_columns(b, audit=pa.array(audits, pa.string()), cost=b.column("cost"))

    long = arrow_map(priced.join(starts, ["conv", "part"]), walked, f"{schema}, audit string, cost long")
    return short.unionByName(long)


REPORT = "conv_key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}


class Conversation:
    """Counts of one conversation, and the digest of its repaired text, as its rows come by in order."""

    def __init__(self, key: str):
        self.key, self.sha, self.state = key, sha256(), 0
        self.audit: list[str] = []
        self.edits: list[str] = []
        self.at, self.cost, self.illegal, self.turns, self.lines = 0, 0, 0, 0, 0
        self.faults = [0, 0, 0, 0]
        self.low = self.high = self.before = None

    def piece(self, codes: str, audit: str, cost: int) -> None:
        self.audit.append(audit)
        self.edits = self.edits[self.at:] + list(audit)
        self.at = 0
        self.cost += cost
        for c in set(codes):
            self.faults[of_symbol(c)[1]] += codes.count(c)

    def say(self, role: bytes, text: bytes) -> None:
        self.sha.update((b"\n" if self.lines else b"") + role + b":" + text)
        self.lines += 1

    def insert(self) -> None:
        """The inserts that come next."""
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            self.state = SPEAKS[self.state]
            self.say(b"user" if self.state == 2 else b"assistant", b"")

    def row(self, turn: int | None, role: str, text: bytes) -> None:
        if turn is not None:
            if turn != self.high:
                self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        self.insert()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.state = AFTER[self.state, role[:1]]
            self.say(role.encode(), text)
        elif edit == "R":
            self.state = SPEAKS[self.state]
            self.say(b"user" if self.state == 2 else b"assistant", text)

    def result(self) -> tuple:
        self.insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.key, gaps, self.faults[2], self.faults[3], self.faults[1], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def repair(rows: DataFrame, rows_each: int = ROWS_EACH) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation, after
    ``damage``.

    Rows stand by turn (null first), then role and digest of the text, which also settles turns that repeat. A null id
    is a conversation of its own. Null role or text count as one space; a role whose first letter is not s, u or a,
    or that has none, is never kept as it is. A conversation that has lost all its rows has zeros, an empty
    audit and the digest of nothing. Further columns are not read. An empty table gives no rows.

    A conversation's rows pass one task one after the other, for its digest is of its whole text in order; nothing of
    them is held but the edits of the pieces that are in reach.
    """
    hurt = damage(rows)
    edits = solved(pieces(hurt, rows_each)).select(
        "conv", F.lit(1).alias("kind"), "turn", "role", "mark", F.col("codes").alias("text"), "audit", "cost", "part",
    )
    text = hurt.select(conv_key(F.col("conv_id")).alias("conv"), F.lit(2).alias("kind"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("mark"), "text")
    ids = rows.select("conv_id").distinct().select("conv_id", conv_key(F.col("conv_id")).alias("conv"))
    every = ids.select("conv", F.lit(0).alias("kind"))
    stream = every.unionByName(edits, allowMissingColumns=True).unionByName(text, allowMissingColumns=True)
    # the mark of all conversations first; then by order key, a piece before its rows
    order = [F.col("conv"), F.when(F.col("kind") == 0, 0).otherwise(1), F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark"), F.col("kind"), F.col("part")]
    stream = stream.repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "turn", "role", "text", "audit", "cost")

    def read(batches):
        now: Conversation | None = None
        out: list[tuple] = []
        names = [x.split()[0] for x in REPORT.split(", ")]

        def flush() -> pa.RecordBatch:
            b = pa.record_batch(list(map(pa.array, zip(*out, strict=True))), names=names)
            out.clear()
            return b

        for b in slices(batches, 1000):
            cols = [b.column(c).to_pylist() for c in ("conv", "kind", "turn", "role")] + [b.column("text").cast(pa.binary()).to_pylist()] + [b.column(c).to_pylist() for c in ("audit", "cost")]
            for conv, kind, turn, role, text, audit, cost in zip(*cols, strict=True):
                if kind == 0:
                    if now is not None:
                        out.append(now.result())
                        if len(out) >= 2000:
                            yield flush()
                    now = Conversation(conv)
                elif kind == 1:
                    now.piece(text.decode(), audit, cost)
                else:
                    now.row(turn, role, text)
        if now is not None:
            out.append(now.result())
        if out:
            yield flush()

    told = arrow_map(stream, read, REPORT)
    kind = rows.schema["conv_id"].dataType
    conv_id = F.when(F.col("conv_key") != "", F.substring("conv_key", 2, 1 << 30)).cast(kind)
    return told.select(conv_id.alias("conv_id"), *(x.split()[0] for x in REPORT.split(", ")[1:]))
