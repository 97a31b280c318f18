"""SimHash near-duplicates by a range join in a space of segment bit counts.

A fingerprint is cut into 32 segments of two bits, and each segment's number of
set bits (0 to 2) is one coordinate. The Manhattan distance of two such points
is at most the Hamming distance of the fingerprints, so links can be sought
among near points. The grid: the coordinates form 8 groups of four, and points
at a distance of 4 or less agree entirely in at least four groups. Each choice
of four groups is one grid, its cells the values there; every distinct
fingerprint stands in one cell of each of the 70 grids, and two that link share
a cell of at least one. Inside a cell the Manhattan distance of two points is the
bound: only pairs within it are verified by their fingerprints. Written in unary
(0, 1, 3 for counts of 0, 1, 2), a point is one word of 64 bits, and the distance
of two is the number of bits in which their words differ.

A cell never sends out its pairs, only edges that connect what is linked: up to
9 members are compared directly, more are first gathered around hubs, and only
hubs that can still be connected are compared further.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .util import ASCII_LOWER, Scratch, chunks, join_labels, table, tidy

SEED = 42
RADIUS = 4
SEGMENTS = 32  # of two bits
GROUPS = 8  # of segments; to be raised with the logarithm of the corpus, as cells then hold more
LAGS = 8  # cells of up to LAGS + 1 members are compared directly


def fingerprint(text: str | None, width: int = 4) -> int:
    """The fingerprint of a whole text; without words it is zero."""
    words = text.encode("utf-8").translate(ASCII_LOWER).split() if text else []
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[: len(words) - width] + 1])
        shingles = [line[a:b] for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)]
    counts, n = np.zeros(64, np.int64), len(shingles)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 32_768):  # bounds the memory of very long texts
        part = shingles[at : at + 32_768]
        h = np.fromiter([digest(s, SEED) for s in part], "<u8", len(part))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp (64 bits as a signed long) of every row."""

    def run(batches):
        for rows in chunks(batches, lambda r: len(r[1] or "") // 6 + 20, 200_000):
            fps = np.array([fingerprint(t, width) for _, t in rows], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, fp long")


ODD_BITS = 0x5555555555555555


def counts_word(fp: Column) -> Column:
    """All 32 coordinates in one long: in each two bits the number of set bits there, in unary."""
    odd = F.lit(ODD_BITS)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseOR(high))


def counts_words(fp: np.ndarray) -> np.ndarray:
    """counts_word of an array."""
    low, high = fp & np.uint64(ODD_BITS), fp >> np.uint64(1) & np.uint64(ODD_BITS)
    return (low & high) << np.uint64(1) | low | high


def grid_masks(groups: int = GROUPS, radius: int = RADIUS) -> list[int]:
    """For each grid the bits that its cells agree in, as signed longs: all choices of groups - radius groups."""
    if not radius < groups <= SEGMENTS:
        raise ValueError("there must be more groups than the radius, and no more than segments")
    edges = [SEGMENTS * g // groups for g in range(groups + 1)]
    masks = []
    for kept in combinations(range(groups), groups - radius):
        mask = sum(3 << (2 * s) for g in kept for s in range(edges[g], edges[g + 1]))
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def grid_cells(fps: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(cell, fp): a row for each grid (70 with 8 groups) of each distinct fingerprint."""
    word = counts_word(F.col("fp"))
    cells = F.array(*(F.xxhash64(F.lit(i), F.col("word").bitwiseAND(F.lit(m))) for i, m in enumerate(grid_masks(groups))))
    return fps.select("fp", word.alias("word")).select(F.explode(cells).alias("cell"), "fp")


def _near(x: np.ndarray, y) -> np.ndarray:
    """Whether fingerprints link: first the Manhattan bound, then, of what is within it, the fingerprints themselves."""
    out = np.bitwise_count(counts_words(x) ^ counts_words(y)) <= RADIUS
    found = np.nonzero(out)[0]
    out[found] = np.bitwise_count(x[found] ^ (y[found] if np.ndim(y) else y)) <= RADIUS
    return out


def cell_edges(x: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect whatever links in one cell of distinct fingerprints, len(x) - 1 at most.

    Each step takes the first fingerprint left as a hub and ties all near it to
    it. Then balls whose hubs are within 3 * RADIUS are compared, but only until
    one link between them is found, and not at all if they are connected yet."""
    edges, balls = [], []
    rest = x
    while len(rest):
        hub = rest[0]
        near = _near(rest, hub)
        ball = rest[near]
        edges += [(int(hub), int(o)) for o in ball[1:]]
        balls.append(ball)
        rest = rest[~near]
    hubs = np.array([b[0] for b in balls], np.uint64)
    parent = list(range(len(balls)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(balls) - 1):
        for j in (np.nonzero(np.bitwise_count(hubs[i + 1 :] ^ hubs[i]) <= 3 * RADIUS)[0] + i + 1).tolist():
            if find(i) == find(j):
                continue
            a, b = (balls[i], balls[j]) if len(balls[i]) < len(balls[j]) else (balls[j], balls[i])
            b = b[np.bitwise_count(b ^ a[0]) <= 2 * RADIUS + RADIUS]
            for one in a:
                hit = np.nonzero(_near(b, one))[0]
                if len(hit):
                    edges.append((int(one), int(b[hit[0]])))
                    parent[find(i)] = find(j)
                    break
    return edges


def _edges(batches):
    """Edges of the cells of one partition, which come sorted by cell and fingerprint."""
    cell, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in _with_end(batches):
        if batch is not None:
            cell = np.concatenate([cell, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            if not len(cell):
                continue
            done = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
        else:
            done = len(cell)
        if done:
            yield _cells_done(cell[:done], fp[:done])
            cell, fp = cell[done:], fp[done:]


def _with_end(batches):
    yield from batches
    yield None


def _cells_done(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    starts = np.nonzero(np.r_[True, cell[1:] != cell[:-1]])[0]
    sizes = np.diff(np.r_[starts, len(cell)])
    small = np.repeat(sizes <= LAGS + 1, sizes)
    found_a, found_b = [], []
    word = counts_words(fp)
    for lag in range(1, min(LAGS, int(sizes.max()) - 1) + 1):
        within = (cell[lag:] == cell[:-lag]) & small[lag:] & (np.bitwise_count(word[lag:] ^ word[:-lag]) <= RADIUS)
        hit = np.nonzero(within)[0]
        hit = hit[np.bitwise_count(fp[hit] ^ fp[hit + lag]) <= RADIUS]
        found_a.append(fp[hit])
        found_b.append(fp[hit + lag])
    for s, n in zip(starts[sizes > LAGS + 1].tolist(), sizes[sizes > LAGS + 1].tolist(), strict=True):
        more = np.array(cell_edges(np.unique(fp[s : s + n])), np.uint64).reshape(-1, 2)
        found_a.append(more[:, 0])
        found_b.append(more[:, 1])
    a = np.concatenate(found_a or [fp[:0]]).view(np.int64)
    b = np.concatenate(found_b or [fp[:0]]).view(np.int64)
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    both = both[both[:, 0] != both[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def link_edges(fps: DataFrame, groups: int = GROUPS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links."""
    cells = grid_cells(fps, groups).repartition("cell").sortWithinPartitions("cell", "fp")
    return cells.mapInArrow(tidy(_edges), "a long, b long").distinct()


def simhash_components(docs: DataFrame, width: int = 4, groups: int = GROUPS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs.

    Fingerprints link at RADIUS differing bits or fewer; component_id is the
    smallest doc_id reachable over links, itself included. Null and wordless
    texts have fingerprint zero and link like others. Repeated rows stay. A null
    doc_id is kept and counts as larger than any other: only a component without
    another has component_id null. An empty table gives no rows. Ties do not
    occur: the result does not depend on which edges connect a component.
    width: words of a shingle; groups: see GROUPS.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep("fps", fingerprints(docs, width))
    firsts = scratch.keep("firsts", fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    edges = scratch.keep("edges", link_edges(firsts.select("fp"), groups))
    roots = components(edges, scratch)
    linked = roots.join(firsts, roots["node"] == firsts["fp"]).select("node", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(least, "root").select(F.col("node").alias("fp"), "least")
    labels = scratch.keep("labels", firsts.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), "n"))
    scratch.drop("firsts", "edges")
    return join_labels(fps, labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
