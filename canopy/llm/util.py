"""Shared pieces: scratch tables, word splitting, Arrow chunking, file access."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pathlib
import posixpath
import re
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Maps A-Z only; other letters keep their case.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, whose Python need not have it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = pathlib.Path(__file__).resolve().parents[1]
    target = pathlib.Path(tempfile.mkdtemp(prefix="canopy-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        held = sc._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="canopy-scratch-")
        sc.setCheckpointDir(root)
    # With its scheme, so that Python on the executors opens the file system that Spark means.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole


_opened: list[Scratch] = []


class Scratch:
    """A folder below the shared one for the tables between the steps of one run.

    A written table cuts lineage: an executor lost later costs only the tasks
    of the running step. `drop` removes tables that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = posixpath.join(scratch_root(spark), f"canopy-{name}-{uuid.uuid4().hex[:12]}")
        _opened.append(self)

    def sub(self, name: str) -> str:
        return posixpath.join(self.path, name)

    def keep(self, name: str, df: DataFrame, free: bool = True) -> DataFrame:
        """Writes df and reads it back; free: shuffle files that it needed may go now, which takes a collection in the JVM."""
        df.write.parquet(self.sub(name))
        schema = df.schema
        del df
        if free:
            free_shuffles(self.spark)
        return self.spark.read.schema(schema).parquet(self.sub(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.sub(name))

    def close(self) -> None:
        """Removes the whole folder. To be called by whoever made it, once no result of it is read any more."""
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def closing_scratch():
    """Removes on leaving the folders that operators made inside: for a step whose result has been written elsewhere by then.

    Operators give tables that are read from their folders, so whoever calls them owns these."""
    before = len(_opened)
    try:
        yield
    finally:
        for scratch in _opened[before:]:
            scratch.close()
        del _opened[before:]


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's context cleaner remove shuffle files that no live plan reads."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone. `lower` is the fast way and equal where all text is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def open_fs(uri: str):
    """(pyarrow file system, path in it) of a path or URI that every executor sees."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8; bytes.split() cuts at just those six bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(a: np.ndarray, k: int, multiplier: np.uint64 = MULTIPLIER) -> np.ndarray:
    """Hash of every k consecutive items of a."""
    n = len(a) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * multiplier + a[j : j + n]
    return mix(h)


def chunks(batches, size, limit: int = 400_000):
    """Python rows of Arrow batches, in lists whose sizes (size(row)) add up to about limit at most."""
    held, total = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            held.append(row)
            total += size(row)
            if total >= limit:
                yield held
                held, total = [], 0
    if held:
        yield held


def tidy(run):
    """run, which gives freed memory back to the system when its task ends: the worker may live on for other tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def text_chunks(batches, limit: int):
    """(keys, texts) of Arrow batches of two columns, as arrays that hold about limit bytes of texts at most.

    A text above the limit is a chunk of its own."""
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        chunk = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.nonzero(np.diff(chunk))[0] + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield keys.slice(a, b - a), texts.slice(a, b - a)


HOT_KEYS = 10_000  # at most so many keys are broadcast by join_labels


def join_labels(rows: DataFrame, labels: DataFrame, key: str, floor: int = 256, how: str = "inner") -> DataFrame:
    """rows joined with labels (key, n: how many rows have it, and more) on key; no key gathers its rows in one task.

    Keys of more than total / HOT_KEYS rows are fewer than HOT_KEYS, whatever
    the input, so their labels are broadcast; the others are joined by a shuffle,
    in which no key has more rows than that. floor: keys of fewer rows are never
    hot; how: "left" keeps rows without a label."""
    total = labels.agg(F.sum("n")).first()[0] or 0
    least = max(floor, total // HOT_KEYS)
    hot = F.broadcast(labels.where(F.col("n") > least).drop("n"))
    cold = labels.where(F.col("n") <= least).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, how))
