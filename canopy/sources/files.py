"""Sources: directories of files, and trees in JSON."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, folder: str, extension: str = "js") -> DataFrame:
    """(path, relative, snapshot, size, content): files with the extension below folder, each whole.

    snapshot is the first folder below, null for files right in it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").load(folder)
    base = folder.rstrip("/").split("://")[-1]
    relative = F.substring_index("path", base + "/", -1)
    snapshot = F.when(relative.contains("/"), F.substring_index(relative, "/", 1))
    return raw.select("path", relative.alias("relative"), snapshot.alias("snapshot"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))


def with_ids(files: DataFrame) -> DataFrame:
    """Adds file_id: a hash of the path, the same in every run."""
    return files.withColumn("file_id", F.xxhash64("path"))


def at_least(files: DataFrame, size: int = 3072) -> DataFrame:
    return files.where(F.col("size") >= size)


def split_sample(files: DataFrame, ratio: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sample, rest) by a hash of file_id, the same on every run and cluster."""
    place = F.pmod(F.xxhash64("file_id", F.lit(seed)), F.lit(1_000_000))
    return files.where(place < int(ratio * 1_000_000)), files.where(place >= int(ratio * 1_000_000))


def readable(files: DataFrame) -> DataFrame:
    """Files whose content is JSON; others are skipped."""
    return files.where(F.try_parse_json("content").isNotNull())


LEAVES = ("string", "enum", "identifier name", "property key", "float", "unsigned long", "bool")


def to_tagged(value: object) -> object:
    """A plain tree in tagged form: tuples, lists and typed leaves."""
    if isinstance(value, list):
        return {"@TYPE": "list", "@VALUE": [to_tagged(v) for v in value]}
    if isinstance(value, dict):
        fields = [{"@FIELD_NAME": k, "@FIELD_VALUE": to_tagged(v)} for k, v in value.items() if k != "type"]
        return {"@TYPE": "tagged tuple", "@INTERFACE": value["type"], "@FIELDS": fields}
    if value is None:
        return {"@TYPE": "tagged tuple", "@INTERFACE": "", "@FIELDS": []}
    kind = "bool" if isinstance(value, bool) else "float" if isinstance(value, int | float) else "string"
    return {"@TYPE": kind, "@VALUE": value}


def from_tagged(value: dict) -> object:
    kind = value.get("@TYPE")
    if kind == "list":
        return [from_tagged(v) for v in value["@VALUE"]]
    if kind == "tagged tuple":
        if value["@INTERFACE"] == "":
            return None
        return {"type": value["@INTERFACE"]} | {f["@FIELD_NAME"]: from_tagged(f["@FIELD_VALUE"]) for f in value["@FIELDS"]}
    if kind in LEAVES:
        return value["@VALUE"]
    raise ValueError(f"unknown tag {kind!r}")


#: Bytes of texts that a task holds before it hands them on: a batch of files may be many times as long once rewritten.
PIECE = 4_000_000


def map_texts(files: DataFrame, change: Callable, skipped: tuple[type[Exception], ...], source: str = "json", made: str = "json", keep: str | None = None) -> DataFrame:
    """(file_id, made) of the files' source column, changed one by one; those at which change raises one of skipped are left out.

    keep: a column of texts that goes along; then no file is left out, made is null instead."""
    texts = {"json": "string", "content": "binary"}
    kind = {"json": pa.string(), "content": pa.binary()}[made]
    columns = [keep] if keep else []

    def batch(rows):
        ids, values, kept = zip(*rows, strict=True)
        arrays = [pa.array(ids, pa.int64()), pa.array(values, kind), pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays(arrays[: 3 if keep else 2], names=["file_id", made, *columns])

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for i, (f, v) in enumerate(zip(b.column(0), b.column(1), strict=True)):
                kept = b.column(2)[i].as_py() if keep else None
                try:
                    value = change(v.as_py())
                except skipped:
                    if not keep:
                        continue
                    value = None
                rows.append((f.as_py(), value, kept))
                size += len(value or "") + len(kept or "")
                if size >= PIECE:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    return files.select(F.col("file_id").cast("long").alias("file_id"), F.col(source).cast(texts[source]).alias(source), *columns).mapInArrow(run, ", ".join(["file_id long", f"{made} {texts[made]}", *(f"{c} string" for c in columns)]))


def rewrite(files: DataFrame, change: Callable[[str], str], keep: str | None = None) -> DataFrame:
    """(file_id, json) with each text changed; texts that change cannot read, null ones and those nested too deeply are skipped. keep: as in map_texts."""
    return map_texts(files, change, (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError), keep=keep)


def convert(files: DataFrame, *to: str, keep: str | None = None) -> DataFrame:
    """files (file_id, json) from the plain into the tagged form (to="tagged") or back (to="plain"); broken ones and those nested too deeply are skipped.

    Of several forms each is read from the text of the one before, in one task:
    tagged texts are many times as long as plain ones and need not travel. keep: as in map_texts."""
    changes = [to_tagged if form == "tagged" else from_tagged for form in to]

    def change(text):
        for each in changes:
            text = json.dumps(each(json.loads(text)))
        return text

    return rewrite(files, change, keep)
