"""Reports over counts and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 32


def probability_histogram(dists: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, symbols, percent): emitted symbols by their probability, empty buckets included."""
    bucket = F.expr(f"n * {buckets - 1} div total")
    found = dists.groupBy(bucket.cast("int").alias("bucket")).agg(F.sum("n").alias("symbols"))
    spark = dists.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(F.broadcast(found), "bucket", "left").select("bucket", F.coalesce("symbols", F.lit(0)).alias("symbols"))
    return both.withColumn("percent", 100.0 * F.col("symbols") / F.sum("symbols").over(Window.partitionBy()))


def entropy(dists: DataFrame, context: list[str]) -> DataFrame:
    """(context, symbols, instances, bits): Shannon entropy of each context in bits a symbol."""
    p = F.col("n") / F.col("total")
    return dists.groupBy(*context).agg(F.count("*").alias("symbols"), F.sum("n").alias("instances"), F.sum(-p * F.log2(p)).alias("bits"))


def ideal_bytes(dists: DataFrame) -> DataFrame:
    """The size of all emitted symbols under ideal coding: the sum of -log2 p over emissions, in bytes."""
    return dists.agg((F.sum(-F.col("n") * F.log2(F.col("n") / F.col("total"))) / 8).alias("ideal_bytes"))


def stream_sizes(symbols: DataFrame, stream: str, size: str) -> DataFrame:
    """(stream, symbols, bytes, percent_symbols, percent_bytes, bits_per_symbol)."""
    each = symbols.groupBy(stream).agg(F.count("*").alias("symbols"), F.sum(size).alias("bytes"))
    whole = Window.partitionBy()
    return each.select(
        stream, "symbols", "bytes",
        (100.0 * F.col("symbols") / F.sum("symbols").over(whole)).alias("percent_symbols"),
        (100.0 * F.col("bytes") / F.sum("bytes").over(whole)).alias("percent_bytes"),
        (8.0 * F.col("bytes") / F.col("symbols")).alias("bits_per_symbol"),
    )


def usage_histogram(counts: DataFrame) -> DataFrame:
    """(uses, strings): distinct values by number of uses."""
    return counts.groupBy(F.col("n").alias("uses")).agg(F.count("*").alias("strings"))


def list_lengths(parents: DataFrame, children: DataFrame, parent: str, child: str) -> DataFrame:
    """(length, lists): how many parents have that many children, those without any included."""
    n = children.groupBy(F.col(child).alias("_p")).agg(F.count("*").alias("_n"))
    each = parents.join(n, F.col(parent) == F.col("_p"), "left").select(F.coalesce("_n", F.lit(0)).alias("length"))
    return each.groupBy("length").agg(F.count("*").alias("lists"))


def merge_statistics(parts: DataFrame, keys: list[str], sums: list[str], maxima: list[str]) -> DataFrame:
    """Adds up statistics: sums are summed, maxima maximised; associative, so parts may be merged in any order."""
    return parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in maxima))


def size_rollup(files: DataFrame, *levels: str) -> DataFrame:
    """Totals of size for each prefix of levels; nulls in all levels mark the grand total."""
    return files.rollup(*levels).agg(F.sum("size").alias("size"), F.count("*").alias("files"))


def sharded_totals(files: DataFrame, level: str, shards: int = 32) -> DataFrame:
    """Totals of a level with few values, added up in shards first, for a level that holds most of the rows."""
    part = files.groupBy(level, F.pmod(F.xxhash64("file_id"), F.lit(shards)).alias("_s")).agg(F.sum("size").alias("size"), F.count("*").alias("files"))
    return part.groupBy(level).agg(F.sum("size").alias("size"), F.sum("files").alias("files"))


def ranked(table: DataFrame, share: str, key: str, name: str, bits: int = 20) -> DataFrame:
    """Adds the place from 1 by share (0 to 1, largest first), then by key (unique, long), without sorting all rows in one task.

    Rows are numbered inside groups of one share and 2^bits keys. Sizes of groups
    are added up inside thousandths of the share, sizes of thousandths over all."""
    t = table.withColumn("_b", F.floor(F.col(share) * 1000)).withColumn("_g", F.shiftright(F.col(key), bits))
    before = [Window.unboundedPreceding, -1]
    own = F.row_number().over(Window.partitionBy(share, "_g").orderBy(key))
    groups = t.groupBy("_b", F.col(share).alias("_s"), F.col("_g").alias("_h")).agg(F.count("*").alias("_n"))
    blocks = groups.groupBy(F.col("_b").alias("_c")).agg(F.sum("_n").alias("_m"))
    blocks = blocks.select("_c", F.coalesce(F.sum("_m").over(Window.orderBy(F.desc("_c")).rowsBetween(*before)), F.lit(0)).alias("_upto"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_b").orderBy(F.desc("_s"), "_h").rowsBetween(*before)), F.lit(0))
    groups = groups.select("_s", "_h", F.col("_b").alias("_k"), inside.alias("_in")).join(F.broadcast(blocks), F.col("_k") == F.col("_c")).select("_s", "_h", (F.col("_in") + F.col("_upto")).alias("_at"))
    placed = t.withColumn("_own", own).join(groups, (F.col(share) == F.col("_s")) & (F.col("_g") == F.col("_h")))
    return placed.withColumn(name, (F.col("_at") + F.col("_own")).cast("long")).select(*table.columns, name)
