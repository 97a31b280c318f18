"""Token tables: an ordered row for each value of a file, with its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens_of(docs: DataFrame, *path: str) -> DataFrame:
    """(file_id, seq, value, *path): the words of documents; path columns are outermost first."""
    words = docs.select(F.col("doc_id").alias("file_id"), *path, F.posexplode(F.split("text", r"\s+")).alias("seq", "value"))
    return words.where("value <> ''").select("file_id", F.col("seq").cast("long").alias("seq"), "value", *path)


def path_tail(path: Column, k: int) -> Column:
    """The last k items of an array of path items, all of them if there are fewer; k = 0 ignores the path."""
    if k == 0:
        return F.slice(path, 1, 0)
    n = F.least(F.lit(k), F.size(path))
    return F.when(n > 0, F.slice(path, F.greatest(F.lit(1), F.size(path) - n + 1), n)).otherwise(path)


def instances(tokens: DataFrame, *keys: str) -> DataFrame:
    """n per combination of the keys; null is a value like any other."""
    return tokens.groupBy(*keys).agg(F.count("*").alias("n"))


def file_frequency(tokens: DataFrame, *keys: str) -> DataFrame:
    """files: in how many files a key occurs; instances: how often.

    Counted from the counts of each file, so both come out of one shuffle by
    key after a partial aggregation by (file, key)."""
    each = tokens.groupBy("file_id", *keys).agg(F.count("*").alias("n"))
    return each.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("n").alias("instances"))


def previous(tokens: DataFrame, group: str, order: list[str], value: str, name: str = "prev") -> DataFrame:
    """Adds the value before in the group's order; null for the first."""
    return tokens.withColumn(name, F.lag(value).over(Window.partitionBy(group).orderBy(*order)))


def first_seen(tokens: DataFrame, group: str, value: str, order: str = "seq") -> DataFrame:
    """(group, value, first, idx): values of each group in the order they are first seen."""
    first = tokens.groupBy(group, value).agg(F.min(order).alias("first"))
    return first.withColumn("idx", (F.row_number().over(Window.partitionBy(group).orderBy("first")) - 1).cast("long"))
