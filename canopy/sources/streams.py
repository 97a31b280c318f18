"""Sinks: split streams, sections of bytes, size reports, dictionaries."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs


def write_streams(tokens: DataFrame, folder: str) -> None:
    """A folder for each kind of token; Parquet keeps each stream's order by file and seq."""
    tokens.repartition("kind", F.pmod(F.xxhash64("file_id"), F.lit(64))).sortWithinPartitions("kind", "file_id", "seq").write.partitionBy("kind").mode("overwrite").parquet(folder)


def write_dictionary(table: DataFrame, folder: str) -> None:
    table.write.mode("overwrite").parquet(folder)


def read_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def compressed_sizes(files: DataFrame, names: list[str], content: str = "content") -> DataFrame:
    """(file_id, raw, and a column for each codec): bytes of each file as it is and compressed."""
    for name in names:
        codecs.codec(name)  # an unknown codec fails here, not in the tasks

    def run(batches):
        for pdf in batches:
            data = [(t or "").encode() for t in pdf[content]]
            out = {"file_id": pdf["file_id"], "raw": [len(d) for d in data]}
            yield pd.DataFrame(out | {n: [len(codecs.codec(n)[0](d)) for d in data] for n in names})

    return files.select("file_id", content).mapInPandas(run, "file_id long, raw long, " + ", ".join(f"{n} long" for n in names))


def size_report(sizes: DataFrame, compressed: str, folder: str | None = None) -> DataFrame:
    """(file_id, size, compressed, ratio), also as CSV with a header if a folder is given."""
    report = sizes.select("file_id", F.col("raw").alias("size"), F.col(compressed).alias("compressed"), (F.col(compressed) / F.greatest("raw", F.lit(1))).alias("ratio"))
    if folder:
        report.write.mode("overwrite").option("header", "true").csv(folder)
    return report


def write_sections(sections: dict[str, dict[str, bytes]], codec: str = "gzip") -> bytes:
    """[[section]], then [stream], method, length and data of each of its streams by name; [[]] ends all."""
    out = bytearray()
    for section, streams in sections.items():
        out += f"[[{section}]]".encode()
        for name in sorted(streams):
            out += f"[{name}]".encode() + codecs.compress_section(codec, streams[name])
    return bytes(out) + b"[[]]"


def read_sections(data: bytes) -> dict[str, dict[str, bytes]]:
    out: dict[str, dict[str, bytes]] = {}
    section, at = None, 0
    while True:
        m = re.compile(rb"\[\[([^\]]*)\]\]").match(data, at)
        if m:
            if not m[1]:
                return out
            section, at = m[1].decode(), m.end()
            out[section] = {}
            continue
        m = re.compile(rb"\[([^\]]+)\]").match(data, at)
        if not m or section is None:
            raise ValueError(f"no section or stream at byte {at}")
        _, out[section][m[1].decode()], at = codecs.decompress_section(data, m.end())


def write_multipart(tree_tokens: bytes, strings: list[str], grammar: list[str], codec: str = "gzip") -> bytes:
    """Three sections: grammar, strings, tree."""
    return write_sections({"grammar": {"names": codecs.write_strings(grammar)}, "strings": {"values": codecs.write_strings(strings)}, "tree": {"tokens": tree_tokens}}, codec)


def structure_dump(tokens: DataFrame) -> DataFrame:
    """(file_id, seq, hex, structure): each token's value in hex beside its path and kind, in order."""
    path = F.array_join(F.transform("path", lambda p: F.concat(p["interface"], F.lit("."), p["field"])), "/")
    return tokens.select("file_id", "seq", F.hex(F.coalesce("value_str", F.col("value_num").cast("string"))).alias("hex"), F.concat(path, F.lit(":"), F.col("kind")).alias("structure")).orderBy("file_id", "seq")
