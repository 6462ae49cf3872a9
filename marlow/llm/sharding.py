"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitions.

Native: DataFrame functions only. The law that holds is ``bytes``: sizes of shards are near equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlow.llm.common import written

OVERHEAD = 16
U32 = 1 << 32


def shard_by_splitters(docs: DataFrame, shards: int = 40, ranges_per_shard: int = 8, samples_per_range: int = 25, leaf_rows: int = 16, leaves: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    Texts are read once: what sharding needs of them is written to the shared folder as rows of a few
    numbers. The key is (crc32 of the text, a hash of the id and of how many equal rows came before): equal texts lie side
    by side, and a group of copies larger than a shard is divided by the second part, also where ids repeat or are null.
    1. A row is sampled with a chance in proportion to its size (from a hash, so a rerun draws the same).
    2. The quantiles of the sample are boundaries of shards * ranges_per_shard ranges.
    3. Each range is cut into slices of equal width, more where it holds more. Slices that are still
       overfull are subdivided by key, and a key with many rows by the second hash. A leaf has about ``leaf_rows`` rows, more where that
       would make over ``leaves`` of them, so sums over leaves stay small at any size. Leaves follow the order of keys.
    4. The bytes before a row, of the leaves before its own and within it, give its shard: the one in which
       the middle of the row lies. Where a shard ends inside a group of equal texts that is no larger than the largest
       row, the group goes where its own middle lies. So shards differ from the mean by no more than the largest row.
    Slots count from 0 in key order within the shard.

    Size is UTF-8 bytes plus 16, null text counts as none. The result depends on the rows alone, not on how the table
    is cut into partitions; rows that are equal in id and text are told apart by a number only. Further
    columns are not read. An empty table gives no rows.
    """
    size = (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + OVERHEAD).cast("long")
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = numbered(docs.select(F.col(id_col).alias("id"), size.alias("size"), crc.alias("text_crc32")))
    total = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("size").alias("largest")).first()
    n_ranges = shards * ranges_per_shard
    boundaries: list[int] = []
    if total.n:
        leaf_rows = max(leaf_rows, -(-total.n // leaves))
        chance = F.col("size") * (samples_per_range * n_ranges / total.b)
        drawn = F.pmod(F.xxhash64("text_crc32", "tie", F.lit(11)), F.lit(U32)) / float(U32)
        # at most samples_per_range * n_ranges keys are expected, whatever the input holds
        points = [i / n_ranges for i in range(1, n_ranges)]
        got = rows.where(drawn < chance).agg(F.percentile_approx("text_crc32", points, 10_000)).first()[0]
        # each boundary key gets a range of its own, so that a hot key can be divided by the second hash
        boundaries = sorted({b for k in got or [] for b in (k - 1, k) if b >= 0})
    rows = rows.withColumn("range", _range_of(F.col("text_crc32"), boundaries))
    counts = rows.groupBy("range").agg(F.count("*").alias("n"))
    # a row a range, 2 * n_ranges at most, so it may be broadcast; so may all sums by range below
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / leaf_rows)).cast("long")
    rows = rows.join(F.broadcast(counts.select("range", slices.alias("slices"))), "range")
    # A range that is more than one key is cut by key first: the slice follows the key's place in the range.
    rows = rows.withColumn("slice", F.floor(_place(boundaries) * F.col("slices")).cast("long"))
    # the keys of overfull slices, each with as many parts as it needs
    by_key = rows.groupBy("range", "slice", "text_crc32").agg(F.count("*").alias("n"))
    in_slice = F.sum("n").over(Window.partitionBy("range", "slice"))
    full = by_key.withColumn("all", in_slice).where(F.col("all") > 2 * leaf_rows).select("range", "slice", "text_crc32", F.ceil(F.col("n") / leaf_rows).alias("parts"))
    rows = rows.join(full, ["range", "slice", "text_crc32"], "left")
    sub = F.when(F.col("parts").isNotNull(), F.col("text_crc32")).otherwise(-1)
    part = F.coalesce(F.floor(F.col("tie") / float(U32) * F.col("parts")), F.lit(0)).cast("long")
    rows = rows.select("id", "size", "text_crc32", "tie", "range", "slice", sub.alias("sub"), part.alias("part"))
    leaf = ["range", "slice", "sub", "part"]
    sums = rows.groupBy(*leaf).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    by_range = sums.groupBy("range").agg(F.sum("bytes").alias("b"), F.sum("n").alias("n"))
    by_range = by_range.select("range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"r{c}") for c in "bn"))
    inside = Window.partitionBy("range").orderBy("slice", "sub", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.join(F.broadcast(by_range), "range").select(
        *leaf, (F.col("rb") + F.coalesce(F.sum("bytes").over(inside), F.lit(0))).alias("start"), (F.col("rn") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("first"),
    )
    in_leaf = Window.partitionBy(*leaf).orderBy("text_crc32", "tie", "id", "size")
    ranked = rows.withColumn("rank", F.row_number().over(in_leaf) - 1).withColumn("upto", F.sum("size").over(in_leaf.rowsBetween(Window.unboundedPreceding, 0)))
    shard_at = lambda middle: F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(total.b or 1)))).cast("int")
    began = F.col("start") + F.col("upto") - F.col("size")
    placed = ranked.join(starts, leaf).select("id", "size", "text_crc32", began.alias("began"), shard_at(began + F.col("size") / 2).alias("shard"), (F.col("first") + F.col("rank")).alias("place"))
    placed = written(placed, "placed")
    # Keys are in order, so that a shard's end cuts one group at most: fewer than ``shards`` groups.
    ends = placed.groupBy("shard").agg(F.max("text_crc32").alias("text_crc32")).select("text_crc32").distinct()
    cut = placed.join(F.broadcast(ends), "text_crc32").groupBy("text_crc32").agg(F.sum("size").alias("b"), F.min("began").alias("began"), F.min("shard").alias("low"), F.max("shard").alias("high"))
    moved = cut.where((F.col("low") < F.col("high")) & (F.col("b") <= (total.largest or 0))).select("text_crc32", shard_at(F.col("began") + F.col("b") / 2).alias("whole"))
    placed = placed.join(F.broadcast(moved), "text_crc32", "left").withColumn("shard", F.coalesce("whole", "shard"))
    # shards follow the order of places, so a shard's places are without a gap
    firsts = placed.groupBy("shard").agg(F.min("place").alias("least"))
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("least")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


#: Rows of equal id and text that one task numbers.
RUN = 1 << 16


def numbered(rows: DataFrame) -> DataFrame:
    """``id, size, text_crc32, tie``, written: equal rows are counted (with a partial aggregate), and made again with a number
    each, from which and the id ``tie`` is hashed. Very many equal rows are made by several tasks."""
    counted = written(rows.groupBy("id", "size", "text_crc32").agg(F.count("*").alias("n")), "counted")
    few = counted.where(F.col("n") <= RUN).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    many = counted.where(F.col("n") > RUN).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN)))).repartition("id", "text_crc32", "b")
    many = many.withColumn("k", F.explode(F.sequence(F.col("b") * RUN, F.least(F.col("n"), (F.col("b") + 1) * RUN) - 1))).drop("b")
    tie = F.pmod(F.xxhash64("id", "text_crc32", "k"), F.lit(U32))
    return written(few.unionByName(many).select("id", "size", "text_crc32", tie.alias("tie")), "sizes")


def _range_of(key: Column, boundaries: list[int]) -> Column:
    """How many boundaries are below the key, by two steps: of about sqrt(n) coarse ones, then in one block."""
    if not boundaries:
        return F.lit(0)
    step = max(1, round(len(boundaries) ** 0.5))
    blocks = [boundaries[i:i + step] for i in range(0, len(boundaries), step)]
    below = lambda some: F.size(F.filter(F.array(*map(F.lit, some)), lambda b: b < key))
    out = F.lit(None)
    for i, block in reversed(list(enumerate(blocks))):
        out = F.when(key <= block[-1], i * step + below(block)).otherwise(out if i < len(blocks) - 1 else F.lit(len(boundaries)))
    return out.cast("int")


def _place(boundaries: list[int]) -> Column:
    """In [0, 1): the row's place in its range, by key, or by the second hash where the range is one key."""
    lo = F.element_at(F.array(*map(F.lit, [-1, *boundaries])), F.col("range") + 1)
    hi = F.element_at(F.array(*map(F.lit, [*boundaries, U32 - 1])), F.col("range") + 1)
    return (F.col("text_crc32") - lo - 1 + F.col("tie") / float(U32)) / F.greatest(hi - lo, F.lit(1))
