"""Counts over streams: the same aggregations, kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(tokens: DataFrame, *keys: str) -> DataFrame:
    """n per key over a stream of tokens; write it in update or complete mode."""
    return tokens.groupBy(*keys).agg(F.count("*").alias("n"))


def running_file_frequency(tokens: DataFrame, value: str, arrived: str, late: str = "1 hour") -> DataFrame:
    """files per value over a stream, each (file, value) once.

    Repeats of a file's value are dropped while the watermark holds it in state:
    tokens of one file must arrive within `late` of each other."""
    once = tokens.withWatermark(arrived, late).dropDuplicatesWithinWatermark(["file_id", value])
    return once.groupBy(value).agg(F.count("*").alias("files"))


def windowed_counts(events: DataFrame, at: str, value: str, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """n per value and window of event time; append mode gives each window once, when it is past."""
    w = events.withWatermark(at, late).groupBy(F.window(at, length), value).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), value, "n")
