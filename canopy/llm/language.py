"""Language identification with hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of +1 and -1, drawn
from its code point alone. A trigram is bound by multiplying the vectors of its
letters, the first rotated by two places and the second by one, so that order
counts. A text is the bundle (sum) of its trigrams; a language's prototype is the
bundle of its training texts, each at unit length so that long texts do not drown
short ones. The common part of all prototypes is taken off them, and a text gets
the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import chunks, table, tidy

DIMENSIONS = 1024
UNKNOWN = "und"
GAP = 32
PIECE = 500_000  # letter codes that are bundled at a time
SHARES = 1 << 40  # of the hash of a doc_id, for choosing training texts
GRAMS = 4_096  # trigrams whose vectors are held at a time
TRAIN_DOCS = 20_000  # bound on the expected number of training texts of a language

_fold = np.zeros(0, np.uint32)  # code point -> letter code: its lower case, GAP for all others


def fold_table() -> np.ndarray:
    """Letters map to their lower case, everything else to the gap."""
    global _fold
    if not len(_fold):
        made = np.full(0x110000, GAP, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                made[c] = ord(low) if len(low) == 1 else c
        _fold = made
    return _fold


def letter_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row of +1 and -1 for each code point, the same on every machine."""
    h = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange((dimensions + 63) // 64, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
    h += np.uint64(0x8CB92BA72F3D8DD7)
    for _ in range(2):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8), axis=1)[:, :dimensions]
    return bits.astype(np.int8) * 2 - 1


def _pieces(texts: list[str]):
    """(number of the text, letter codes) piece by piece; a piece begins with the last two codes of that before it."""
    fold = fold_table()
    for i, t in enumerate(texts):
        t, tail = f" {t} ", np.zeros(0, np.uint32)
        for at in range(0, len(t), PIECE):
            c = fold[np.frombuffer(t[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
            keep = c != GAP
            keep[1:] |= c[:-1] != GAP  # one gap for a run of them
            keep[0] |= not len(tail) or tail[-1] != GAP
            c = np.concatenate([tail, c[keep]])
            tail = c[-2:]
            yield i, c


def text_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, whether the text has a letter): the bundles of whole texts, one row each.

    Texts are taken in pieces, and some PIECE codes are held at a time, however long texts are."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    has = np.zeros(len(texts), bool)
    held: list[np.ndarray] = []
    of: list[int] = []
    size = 0
    for i, c in _pieces(texts):
        has[i] |= bool((c != GAP).any())
        if size + len(c) > PIECE and held:
            _bundle(held, of, out)
            held, of, size = [], [], 0
        held.append(c)
        of.append(i)
        size += len(c)
    if held:
        _bundle(held, of, out)
    return out, has


def _bundle(pieces: list[np.ndarray], of: list[int], out: np.ndarray) -> None:
    """Adds the trigrams of each piece to the row of out that `of` names."""
    flat = np.concatenate(pieces)
    if len(flat) < 3:
        return
    mark = np.zeros(0x110000, bool)
    mark[flat] = True
    letters = np.nonzero(mark)[0]
    small = (np.cumsum(mark, dtype=np.int32) - 1)[flat]
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(c) for c in pieces])
    k = len(letters)
    gram = (small[:-2].astype(np.int64) * k + small[1:-1]) * k + small[2:]
    inside = piece[:-2] == piece[2:]
    rows, row = np.unique(np.array(of, np.int64), return_inverse=True)
    grams, doc = gram[inside], row[piece[:-2][inside]]
    if not len(grams):
        return
    # Count each text's trigrams, then bundle: counts (texts x trigrams) times trigram vectors.
    if k**3 <= 1 << 22:
        seen = np.zeros(k**3, bool)
        seen[grams] = True
        kinds = np.nonzero(seen)[0]
        place = np.zeros(k**3, np.int64)
        place[kinds] = np.arange(len(kinds))
        col = place[grams]
    else:
        kinds, col = np.unique(grams, return_inverse=True)
    vectors = letter_vectors(letters)
    first, second = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    for at in range(0, len(kinds), GRAMS):  # bounds memory for texts of many scripts
        own = kinds[at : at + GRAMS]
        bound = first[own // (k * k)] * second[own // k % k] * vectors[own % k]
        here = (col >= at) & (col < at + len(own)) if len(kinds) > GRAMS else slice(None)
        counts = np.bincount(doc[here] * len(own) + (col[here] - at), minlength=len(rows) * len(own)).reshape(len(rows), len(own))
        out[rows] += counts.astype(np.float32) @ bound.astype(np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _groups(rows: list, most: int = 250) -> list[list]:
    return [rows[i : i + most] for i in range(0, len(rows), most)]


def _cuts(sizes: np.ndarray, most: int = 250, limit: int = 1_000_000) -> list[tuple[int, int]]:
    """(from, to) of slices of at most `most` rows and about `limit` bytes; a longer text is a slice of its own."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (i - start >= most or total + n > limit):
            out.append((start, i))
            start, total = i, 0
        total += n
    return [*out, (start, len(sizes))] if len(sizes) else out


def fit_prototypes(train: DataFrame, per_language: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """lang -> unit prototype, learned from train (doc_id, text, lang) alone.

    Rows with a null lang or text are left out. Of a language with more than
    per_language rows a share is taken, chosen by a hash of the doc_id, so that
    about that many remain. Sums of vectors are what is shuffled: a row for each
    language and partition."""
    train = train.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    rate = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(SHARES, max(1, SHARES * per_language // n)))))
    sample = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)) < rate[F.col("lang")])

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for part in chunks(batches, lambda r: len(r[0]), 1_000_000):
            for rows in _groups(part):
                vectors, has = text_vectors([r[0] for r in rows])
                vectors = unit(vectors)
                for i, (_, lang) in enumerate(rows):
                    if has[i]:
                        sums.setdefault(lang, np.zeros(DIMENSIONS))
                        sums[lang] += vectors[i]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = sample.select("text", "lang").mapInArrow(tidy(bundle), "lang string, v array<double>")
    each = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in each.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect():
        out[r["lang"]] = np.array([p["x"] for p in r["v"]])
    return {k: v / max(np.linalg.norm(v), 1e-12) for k, v in sorted(out.items())}


def _judge(prototypes: dict[str, np.ndarray]):
    """A function from texts to (languages, scores)."""
    names = list(prototypes)
    raw = (np.stack(list(prototypes.values())) if names else np.zeros((0, DIMENSIONS))).astype(np.float32)
    centred = unit(raw - raw.mean(axis=0)) if len(names) > 1 else raw

    def judge(texts: list[str]) -> tuple[list[str], np.ndarray]:
        vectors, has = text_vectors(texts)
        if not names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        vectors = unit(vectors)
        best = np.argmax(vectors @ centred.T, axis=1)
        score = np.clip(np.einsum("ij,ij->i", vectors, raw[best]), 0, 1).astype(np.float64)
        return [names[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, score, 0.0)

    return judge


def keep_identified(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """The rows of docs that are not `und`, all columns as they are but a null lang, which becomes the predicted one."""
    judge = _judge(prototypes)

    def run(batches):
        for whole in batches:
            names = whole.schema.names
            t, i = names.index("text"), names.index("lang")
            sizes = pc.fill_null(pc.binary_length(whole.column(t)), 0).to_numpy(zero_copy_only=False)
            for a, b in _cuts(sizes):
                batch = whole.slice(a, b - a)
                langs, _ = judge([x or "" for x in batch.column(t).to_pylist()])
                filled = pa.array([own if own is not None else told for own, told in zip(batch.column(i).to_pylist(), langs, strict=True)], batch.schema.field(i).type)
                batch = pa.RecordBatch.from_arrays([filled if k == i else c for k, c in enumerate(batch.columns)], schema=batch.schema)
                yield batch.filter(pa.array([told != UNKNOWN for told in langs]))

    return docs.mapInArrow(tidy(run), docs.schema)


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: str = "doc_id long") -> DataFrame:
    """docs (the columns of keep, then text) with lang_pred and score for the whole text.

    The score is the cosine with the chosen prototype before their common part is
    taken off, from 0 to 1. A null text, or one without a letter, is `und` with
    score 0, and so is every text if nothing was learned. Ties go to the language
    first in order."""
    judge = _judge(prototypes)
    kept = [f.split() for f in keep.split(", ")]

    def run(batches):
        for part in chunks(batches, lambda r: len(r[-1] or "") + 50, 1_000_000):
            for rows in _groups(part):
                langs, scores = judge([r[-1] or "" for r in rows])
                cols = {name: pa.array([r[i] for r in rows], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[kind]) for i, (name, kind) in enumerate(kept)}
                cols["lang_pred"], cols["score"] = pa.array(langs), pa.array(scores)
                yield pa.RecordBatch.from_pydict(cols)

    return docs.select(*(name for name, _ in kept), "text").mapInArrow(tidy(run), f"{keep}, lang_pred string, score double")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs (doc_id, text, lang).

    Learns only from rows whose crc32(doc_id as text) mod 3 is not 1. A null
    doc_id is not held out. Repeated rows stay; an empty table gives no rows."""
    rows = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    prototypes = fit_prototypes(rows.where(~F.col("held_out")))
    return predict(rows, prototypes, "doc_id long, held_out boolean")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
