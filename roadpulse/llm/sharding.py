"""Sharding (operator 3): minimax contiguous partition of atomic groups."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import Scratch, small

#: Hex digits of a group's key in the first table of cells, and by how many a cell is refined.
FIRST, STEP, DIGITS = 4, 2, 32


class Cells:
    """Sizes of consecutive cells, each a run of groups in key order; a cell of one group is atomic."""

    def __init__(self, rows: list[tuple[str, int, int]]) -> None:
        self.rows = sorted(rows)
        self.ends = list(accumulate(r[1] for r in self.rows))
        self.total = self.ends[-1] if rows else 0

    def cuts(self, capacity: int, shards: int) -> list[int] | None:
        """Greedy check: cell numbers where the shards after the first begin, or None if ``capacity`` is too small."""
        cuts, start = [], 0
        for _ in range(shards):
            k = bisect_right(self.ends, start + capacity)
            if k == len(self.ends):
                return cuts
            if (self.ends[k - 1] if k else 0) <= start:
                return None
            start = self.ends[k - 1]
            cuts.append(k)
        return None

    def smallest(self, shards: int) -> int:
        """Binary search for the smallest capacity for which whole cells fit."""
        low, high = -(-self.total // shards), max(1, self.total)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.cuts(mid, shards) is not None else (mid + 1, high)
        return low

    def open(self, low: int, high: int, shards: int) -> list[str]:
        """Cells of several groups in which a cut may lie for some capacity from ``low`` to ``high``."""
        found: set[int] = set()
        a = b = 0
        for _ in range(shards):
            k = bisect_right(self.ends, a + low)
            a = self.ends[k - 1] if k else 0  # no cut lies before
            b = min(b + high, self.total)  # nor after
            first, last = bisect_right(self.ends, a), bisect_right(self.ends, b)
            found.update(range(first, min(last, len(self.rows) - 1) + 1))
            if a >= self.total:
                break
        return [self.rows[k][0] for k in sorted(found) if k < len(self.rows) and self.rows[k][2] > 1]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """Keys at which the shards after the first begin, and the capacity: the smallest for which a
    contiguous partition of ``groups`` (key of hex digits, size) into ``shards`` exists.

    Cells are prefixes of the key, so they need no sort: first the sums of 16^4 cells come to the
    driver, then only cells in which a cut can still lie are split by two more digits, until each of
    these is one group.  The driver holds some 10^5 numbers whatever the count of groups.
    """

    def cells(digits: int, within: list[str] | None) -> list[tuple[str, int, int]]:
        g = groups
        if within is not None:
            lists: dict[int, list[str]] = {}
            for p in within:
                lists.setdefault(len(p), []).append(p)
            g = g.where(" or ".join(f"substring(key, 1, {n}) in ({', '.join(repr(p) for p in ps)})" for n, ps in lists.items()))
        return [tuple(r) for r in g.groupBy(F.substring("key", 1, digits)).agg(F.sum("size").cast("long"), F.count("*")).collect()]

    now, digits = Cells(cells(FIRST, None)), FIRST
    while True:
        if not now.rows:
            return [], 0
        high = now.smallest(shards)
        low = max(-(-now.total // shards), max((r[1] for r in now.rows if r[2] == 1), default=0))
        split = now.open(min(low, high), high, shards) if digits < DIGITS else []
        if not split:
            return [now.rows[k][0] for k in now.cuts(high, shards)], high
        digits += STEP
        gone = set(split)
        now = Cells([r for r in now.rows if r[0] not in gone] + cells(digits, split))


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """Put documents into shards 0 to ``shards`` - 1 whose sizes are nearly equal (law ``bytes``).

    Size: UTF-8 bytes of the text plus 1.  Documents with equal texts are one atomic group and stay
    together; null counts as the empty text here (size 1, crc 0).  Groups are ordered by a hash of the
    text.  A group larger than an equal share of what is left gets a shard of its own (at most
    ``shards`` - 1 such groups exist, the largest first); the rest is cut contiguously at the smallest
    feasible capacity.

    Returns ``id_col``, size, text_crc32 (unsigned, UTF-8), law, shard, slot (gapless from 0 in each
    shard, by group and id), grown_shard (null: this law moves rows when shards are added).  Repeated
    rows and null ids each get a slot; other columns are not carried; an empty table gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.put(
        df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.substring(F.sha2(text.cast("binary"), 256), 1, DIGITS).alias("key")),
        "rows",
    )
    groups = scratch.put(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    large, left = [], total
    for key, size in groups.orderBy(F.desc("size"), "key").limit(shards - 1).collect():
        if size * (shards - len(large)) <= left:
            break
        large.append(key)
        left -= size
    rest = groups.where(~F.col("key").isin(large)) if large else groups
    cuts, _ = minimax_cuts(rest, shards - len(large))
    shard = sum((F.when(F.col("key") >= c, 1).otherwise(0) for c in cuts), F.lit(len(large)))
    for k, key in enumerate(large):
        shard = F.when(F.col("key") == key, k).otherwise(shard)
    # Ordered over the whole table, so that a large group spreads over tasks; then numbered by task.
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["shard", "key", "id", "size", "crc"]
    placed = scratch.put(rows.withColumn("shard", shard.cast("int")).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)
    runs = placed.groupBy("shard", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n")).orderBy("shard", "part").collect()
    offsets, seen = [], {}
    for s, p, first, k in runs:  # one row for each task and shard in it
        offsets.append((s, p, seen.get(s, 0) - first))
        seen[s] = seen.get(s, 0) + k
    shift = small(spark, offsets, "shard int, part long, shift long")
    out = placed.withColumn("part", part).join(F.broadcast(shift), ["shard", "part"])
    scratch.drop(rows, groups)
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
