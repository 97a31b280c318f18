"""Prefix codes: lengths by merging, canonical codes, and what coding with them costs."""

from __future__ import annotations

import heapq
import math
from collections.abc import Hashable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def code_lengths(counts: dict[Hashable, int], limit: int | None = None) -> dict[Hashable, int]:
    """symbol -> bits; a lone symbol has 0. Ties merge in order of the symbols. Lengths above limit are refused."""
    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(counts.items(), key=lambda x: (x[0] is not None, x[0]))) if n > 0]
    lengths = {s: 0 for _, _, (s,) in heap}
    heapq.heapify(heap)
    fresh = len(heap)
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            lengths[s] += 1
        heapq.heappush(heap, (n + m, fresh, a + b))
        fresh += 1
    if limit is not None and max(lengths.values(), default=0) > limit:
        raise ValueError(f"a code of {max(lengths.values())} bits is longer than {limit}")
    return lengths


def canonical(lengths: dict[Hashable, int]) -> dict[Hashable, int]:
    """symbol -> code, given in order of length, then symbol (None first)."""
    out, code, last = {}, -1, 0
    for s, n in sorted(lengths.items(), key=lambda x: (x[1], x[0] is not None, x[0])):
        code = (code + 1) << (n - last)
        out[s], last = code, n
    return out


def lengths_by_context(counts: DataFrame, context: str, value: str) -> DataFrame:
    """(context, value, n, bits) for each context; a context's distinct symbols are coded in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = code_lengths(dict(zip(pdf[value], pdf["n"], strict=True)))
        return pdf.assign(bits=pdf[value].map(lengths).astype("int32"))

    shape = f"{context} string, {value} string, n long, bits int"
    return counts.select(context, value, "n").groupBy(context).applyInPandas(run, shape)


def canonical_codes(lengths: DataFrame, context: str, value: str) -> DataFrame:
    """Adds code: 2^bits times the sum of 2^-bits over the symbols before, in order of bits, then value."""
    before = Window.partitionBy(context).orderBy("bits", F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("bits"))).over(before), F.lit(0.0))
    return lengths.withColumn("code", F.round(upto * F.pow(F.lit(2.0), F.col("bits"))).cast("long"))


def coding_cost(lengths: DataFrame, context: str) -> DataFrame:
    """(context, symbols, instances, huffman_bits)."""
    return lengths.groupBy(context).agg(F.count("*").alias("symbols"), F.sum("n").alias("instances"), F.sum(F.col("n") * F.col("bits")).alias("huffman_bits"))


def model_cost(lengths: dict[Hashable, int], universe: int) -> float:
    """Estimated bits that describe a code of these lengths over a universe of that many symbols.

    A lone symbol is named; a code over at most half of the universe names each
    symbol with its length; a denser one only lists lengths."""
    named = math.log2(universe)
    if len(lengths) == 1:
        return named
    listed = sum(math.log2(n) for n in lengths.values() if n > 0)
    return listed + (named * len(lengths) if 2 * len(lengths) <= universe else 0)


def encode_cost(lengths: dict[Hashable, int], universe: int, symbols: Iterable[Hashable]) -> float:
    """Bits of the code's description and of the symbols."""
    return model_cost(lengths, universe) + sum(lengths[s] for s in symbols)
