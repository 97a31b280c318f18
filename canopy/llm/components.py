"""Connected components of a graph given as an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Scratch


def _both(e: DataFrame) -> DataFrame:
    return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest of its neighbours and itself."""
    both = _both(e)
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.where("b > a").join(least, "a")
    return joined.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of these."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (a, b long); root is the component's smallest node.

    Large-star and small-star steps alternate until the edges no longer change,
    which takes a logarithmic number of rounds; each round's edges are a written
    table, and the driver sees only their number and a checksum. Smallest
    neighbours are found by partial aggregation, so a node with very many
    neighbours does not gather them in one task."""
    held = scratch.keep(f"{name}-0", edges.select("a", "b").where("a <> b").distinct())
    seen, i = None, 0
    while True:
        state = tuple(held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return held.select(F.col("a").alias("node"), F.col("b").alias("root")).union(held.select("b", "b")).distinct()
        seen, i = state, i + 1
        held = scratch.keep(f"{name}-{i}", _small_star(_large_star(held)), free=False)
        scratch.drop(f"{name}-{i - 1}")
