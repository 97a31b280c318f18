"""Minimax contiguous partition: documents into shards of near equal bytes.

Documents with equal texts form one atomic group. The groups stand in one fixed
order (by the MD5 of their text), and each shard takes a run of consecutive
groups. The largest shard is as small as such runs allow: its capacity is found
by search over capacities, each checked greedily against the prefix sums of the
group sizes, and the cuts are where the greedy check of the smallest feasible
capacity cut. Only DataFrame functions; the driver sees prefix sums of a bounded
number of parts of the table.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import Scratch, table

SALTS = 64  # parts of a group, so that no task numbers all rows of a frequent text
DIGITS = 3  # of the key, by which prefix sums are refined: 4,096 parts of a part


class PrefixSums:
    """Prefix sums of the groups, as far as the search needs them.

    The driver starts with the sums at the ends of the 4,096 blocks of keys and
    refines a part only if a cut falls into it, so it holds a few thousand sums
    for each refined part and never those of all groups."""

    def __init__(self, placed: DataFrame):
        self.placed = placed
        found = self._parts([""])
        self.ends, self.counts, self.names = map(list, zip(*found, strict=True))

    def _parts(self, names: list[str]) -> list[tuple[int, int, str]]:
        """Ends, numbers of groups and names of the parts of the named parts, in order."""
        k = len(names[0])
        inside = self.placed if not k else self.placed.where(F.substring("key", 1, k).isin(names))
        parts = inside.groupBy(F.substring("key", 1, k + DIGITS).alias("part")).agg(F.max("end").alias("end"), F.count("*").alias("n"))
        return sorted((r["end"], r["n"], r["part"]) for r in parts.collect())

    def reach(self, limit: int, unsure: set[str]) -> tuple[int, int]:
        """The least and greatest that the largest sum up to limit can be; the part, if they differ, goes to unsure."""
        i = bisect.bisect_right(self.ends, limit)
        low = self.ends[i - 1] if i else 0
        if i == len(self.ends) or self.counts[i] == 1:
            return low, low
        unsure.add(self.names[i])
        return low, min(limit, self.ends[i] - 1)

    def refine(self, names: set[str]) -> None:
        for k in {len(n) for n in names}:
            new = defaultdict(list)
            for part in self._parts([n for n in names if len(n) == k]):
                new[part[2][:k]].append(part)
            for name, parts in new.items():
                i = self.names.index(name)
                for held, at in ((self.ends, 0), (self.counts, 1), (self.names, 2)):
                    held[i : i + 1] = [p[at] for p in parts]

    def fill(self, capacity: int, shards: int, total: int) -> tuple[list[int], int, set[str]]:
        """Cuts of greedy filling at their least, the greatest total it can reach, and the parts in doubt."""
        cuts, most, unsure = [0], 0, set()
        for _ in range(shards):
            cuts.append(self.reach(cuts[-1] + capacity, unsure)[0])
            most = self.reach(most + capacity, unsure)[1]
        return cuts, most, unsure


def smallest_capacity(sums: PrefixSums, shards: int, total: int, largest: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and the cuts of greedy filling with it, by binary search.

    A capacity of the mean plus the largest group is always feasible, as greedy
    filling then leaves every shard but the last above the mean. A capacity is
    decided by bounds where they suffice; else the parts in doubt are refined."""
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest
    while low < high:
        mid = (low + high) // 2
        cuts, most, unsure = sums.fill(mid, shards, total)
        if cuts[-1] >= total:
            high = mid
        elif most < total:
            low = mid + 1
        else:
            sums.refine(unsure)
    while (found := sums.fill(high, shards, total))[2]:
        sums.refine(found[2])
    return high, found[0]


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs.

    Size is the UTF-8 length of the text plus 1. A null text counts as an empty
    one (size 1, CRC 0) and shares its group. Repeated rows stay and have slots
    of their own; a null doc_id is kept. With fewer groups than shards the last
    shards stay empty; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("key"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    rows = scratch.keep("rows", rows)

    groups = rows.groupBy("key").agg(F.sum("size").alias("g_size"), F.count("*").alias("g_rows"))
    groups = groups.withColumn("block", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    groups = scratch.keep("groups", groups)
    of_all = groups.agg(F.sum("g_size"), F.max("g_size")).first()
    if of_all[0] is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    total, largest = of_all

    # Prefix sums in two levels: over the 4,096 blocks of the key's first three digits, then in each block.
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = groups.groupBy("block").agg(F.sum("g_size").alias("b_size"), F.sum("g_rows").alias("b_rows"))
    blocks = blocks.select("block", F.coalesce(F.sum("b_size").over(upto), F.lit(0)).alias("b_end"), F.coalesce(F.sum("b_rows").over(upto), F.lit(0)).alias("b_row"))
    inside = Window.partitionBy("block").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    placed = groups.repartitionByRange("block").select("key", "block", "g_rows", F.sum("g_size").over(inside).alias("i_end"), F.sum("g_rows").over(inside).alias("i_rows"))
    placed = placed.join(F.broadcast(blocks), "block").select("key", (F.col("b_end") + F.col("i_end")).alias("end"), (F.col("b_row") + F.col("i_rows") - F.col("g_rows")).alias("first_row"))
    placed = scratch.keep("placed", placed)

    _, cuts = smallest_capacity(PrefixSums(placed), shards, total, largest)
    shard = F.lit(0)
    for cut in cuts[1:-1]:
        shard = shard + (F.col("end") > cut).cast("int")
    firsts = {r["shard"]: r["f"] for r in placed.groupBy(shard.alias("shard")).agg(F.min("first_row").alias("f")).collect()}
    starts = F.create_map(*(F.lit(x) for kv in firsts.items() for x in kv))
    placed = placed.select("key", shard.alias("shard"), (F.col("first_row") - starts[shard]).alias("first_slot"))

    before = Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("key", "salt").agg(F.count("*").alias("n"))
    parts = parts.join(placed, "key").select("key", "salt", "shard", (F.col("first_slot") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("first_slot"))
    number = F.row_number().over(Window.partitionBy("key", "salt").orderBy("doc_id")) - 1
    numbered = rows.withColumn("number", number).join(parts, ["key", "salt"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("first_slot") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
