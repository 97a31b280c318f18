"""Training a dictionary on a sample of files and measuring it on the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dictionary, statistics, tokens
from ..sources.files import split_sample


@dataclass
class Trained:
    table: DataFrame  # value, files, idx
    dists: DataFrame  # context, value, n, symbol_index, lo, hi, total


def train(sample: DataFrame, context: list[str], threshold: int = 2) -> Trained:
    """Linear table and distributions of a sample (file_id, value, *context)."""
    table = dictionary.linear_table(tokens.file_frequency(sample, "value"), threshold)
    return Trained(table, dictionary.distributions(tokens.instances(sample, *context, "value"), context, "value"))


def evaluate(files: DataFrame, context: list[str], ratio: float = 0.5, threshold: int = 2, seed: int = 0) -> DataFrame:
    """(file_id, symbols, hits, size): files outside the sample under the sample's dictionary, worst first."""
    sample, rest = split_sample(files, ratio, seed)
    found = dictionary.hits(rest, train(sample, context, threshold).table)
    return found.groupBy("file_id").agg(F.count("*").alias("symbols"), F.count("idx").alias("hits"), F.sum(F.octet_length("value")).alias("size")).orderBy(F.col("hits") / F.col("symbols"))


def report(measured: DataFrame) -> DataFrame:
    """Each file's totals and the grand total."""
    return statistics.size_rollup(measured, "file_id")
