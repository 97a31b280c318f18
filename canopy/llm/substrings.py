"""Substring dedup with repeated-phrase automata.

A window is 50 consecutive words. A word goes if a window over it also starts in a
document with a smaller id.

1. Anchors: of every run of windows' 16-word phrases the one with the least hash
   (a minimizer) is kept, so equal windows hold an equal anchor at an equal place.
   Anchors seen in two different word sequences mark the documents worth a look.
   Whole copies of a sequence are settled by its digest alone.
2. Confirming: windows around such anchors are counted by a 128-bit hash; those of
   two or more sequences recur, and each belongs to the smallest document that has
   it. Consecutive ones of a document are joined into passages.
3. Automata: documents are dealt into shards, and a shard gets the passages that
   its own documents hold. Each shard compiles the 25-word phrases of its passages
   into an Aho-Corasick automaton over word numbers and streams its documents
   through it. The automaton gives the places; windows around each are looked up
   among those of the passages and compared word by word; what a smaller document
   has is removed.

Every document is streamed by step 1, and by step 3 all that can hold an occurrence:
a window that two sequences share has in both the same anchor (its phrase of least
hash depends on its words alone, the last of equal ones), so that anchor is counted
for two sequences. A document without such an anchor shares no window, holds no
passage, and would cross any automaton without a hit that counts.

What a shard holds is bounded by its own documents, also where one passage is in a
third of all documents: then each shard has that passage once. Passages are cut
once for each set of up to SHARDS_IN_SET shards, and only they are replicated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import MULTIPLIER, SECOND, Scratch, chunks, mix, rolling, table, tidy, word_hashes, words_of

WINDOW = 50
ANCHOR = 16
PHRASE = 25  # any 50 words hold a whole phrase of a passage cut into such
SHARD_BYTES = 8 << 20  # of texts that a shard's automaton is made for
MOST_TASKS = 100_000  # beyond so many shards a task takes several, one after the other
SHARDS_IN_SET = 1024  # shards named in one row
PIECE = 256  # windows of a passage at most
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """Places of the least value (the last of equal ones) of each width consecutive values, distinct and in order.

    A window minimum by doubling: log2(width) passes over the array."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # The least of 2^k values from each place, then two overlapping runs of them.
    at = np.arange(len(h))
    span = 1
    while span * 2 <= width:
        a, b = at[: len(at) - span], at[span:]
        at = np.where(h[b] <= h[a], b, a)
        span *= 2
    a, b = at[:n], at[width - span : width - span + n]
    return np.unique(np.where(h[b] <= h[a], b, a))


def anchors_of(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(places, phrase hashes) of a document's anchors."""
    h = rolling(hashes, anchor)
    places = minimizers(h, window - anchor + 1)
    return places, h[places]


def text_hash(text: str | None) -> int:
    """What F.xxhash64 makes of a text; of null it is the seed."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def _sequences(batches):
    """A row a document: the hash of its text (as F.xxhash64), its words' number and digest, its distinct anchors."""
    for rows in chunks(batches, lambda r: len(r[1] or "") // 6, 200_000):
        out = []
        for doc_id, text in rows:
            words = words_of(text)
            anchors = np.unique(anchors_of(word_hashes(words))[1]).view(np.int64) if len(words) >= WINDOW else np.zeros(0, np.int64)
            out.append((doc_id, text_hash(text), len(words), hashlib.sha256(b" ".join(words)).hexdigest(), anchors))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([r[i] for r in out], pa.int64()) for i in range(3)), pa.array([r[3] for r in out]), _lists([r[4] for r in out])],
            names=["doc_id", "text_hash", "n_words", "sha", "anchors"],
        )


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))


def _candidate_windows(batches):
    """(w1, w2, doc_id, start) of every window that holds a recurring anchor."""
    for rows in chunks(batches, lambda r: len(r[1]) // 6, 100_000):
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for doc_id, text, recurring in rows:
            h = word_hashes(words_of(text))
            places, own = anchors_of(h)
            places = places[np.isin(own.view(np.int64), np.array(recurring, np.int64))]
            edge = np.zeros(len(h) + 1, np.int64)
            np.add.at(edge, np.maximum(places - (WINDOW - ANCHOR), 0), 1)
            np.add.at(edge, places + 1, -1)
            starts = np.nonzero(np.cumsum(edge)[: len(h) - WINDOW + 1] > 0)[0]
            cols[0].append(rolling(h, WINDOW, MULTIPLIER)[starts].view(np.int64))
            cols[1].append(rolling(h, WINDOW, SECOND)[starts].view(np.int64))
            cols[2].append(np.full(len(starts), doc_id, np.int64))
            cols[3].append(starts.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["w1", "w2", "doc_id", "start"])


def _passages(batches):
    """Cuts runs of consecutive windows, PIECE at most, out of the texts: (doc_id, part, text, shards) for each.

    Rows: doc_id, part, text, and places, a list of (start, shards that hold this window)."""
    for batch in batches:
        places = batch.column(3)
        each = places.flatten()
        begins = places.offsets.to_numpy() - places.offsets[0].as_py()
        starts, lists = each.field("start").to_numpy(), each.field("shards")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        shards = lists.flatten().to_numpy()
        out: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for r, (doc_id, part) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            words = words_of(batch.column(2)[r].as_py())
            order = begins[r] + np.argsort(starts[begins[r] : begins[r + 1]], kind="stable")
            own = starts[order]
            new_run = np.r_[True, np.diff(own) > 1]
            since = np.arange(len(own)) - np.maximum.accumulate(np.where(new_run, np.arange(len(own)), 0))
            for group in np.split(np.arange(len(own)), np.nonzero(new_run | (since % PIECE == 0))[0][1:]):
                found = np.unique(np.concatenate([shards[ends[i - 1] if i else 0 : ends[i]] for i in order[group].tolist()]))
                text = b" ".join(words[own[group[0]] : own[group[-1]] + WINDOW]).decode("utf-8", "surrogatepass")
                for column, value in zip(out, (doc_id, part, text, found.astype(np.int32)), strict=True):
                    column.append(value)
                size += len(text) + 4 * len(found)
            if size > 4 << 20:
                yield _cut(out)
                out, size = ([], [], [], []), 0
        yield _cut(out)


def _cut(out: tuple[list, list, list, list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(out, kinds, strict=True)], names=["doc_id", "part", "text", "shards"])


class PhraseAutomaton:
    """The passages of a shard: an automaton of their phrases, and a sorted table of their windows.

    The automaton tells where a document holds a phrase. Only windows around such
    places are looked up in the table, each once, and compared word by word; so a
    document's cost does not grow with the number of passages that share a phrase."""

    def __init__(self, window: int = WINDOW, phrase: int = PHRASE):
        self.window, self.phrase = window, phrase
        self.numbers: dict[bytes, int] = {}
        self.passages: list[tuple[int, np.ndarray]] = []
        self.machine = None

    def add(self, doc_id: int, text: str) -> None:
        words = words_of(text)
        ids = np.fromiter((self.numbers.setdefault(w, len(self.numbers) + 1) for w in words), np.int64, len(words))
        if len(ids) >= self.window:
            self.passages.append((doc_id, ids))

    def _hashes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = mix(ids.astype(np.uint64) + SECOND)
        return rolling(own, self.window, MULTIPLIER), rolling(own, self.window, SECOND)

    def compile(self) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        if not self.passages:
            return
        for _, ids in self.passages:
            for at in range(0, len(ids) - self.phrase + 1, self.phrase):
                self.machine.add_word(tuple(ids[at : at + self.phrase].tolist()), True)
        self.machine.make_automaton()
        n = np.array([len(ids) for _, ids in self.passages])
        begins = np.cumsum(n) - n
        self.flat = np.concatenate([ids for _, ids in self.passages])
        place = np.concatenate([b + np.arange(k - self.window + 1) for b, k in zip(begins, n, strict=True)])
        owner = np.repeat([doc_id for doc_id, _ in self.passages], n - self.window + 1)
        h1, h2 = (h[place] for h in self._hashes(self.flat))
        order = np.lexsort((owner, h2, h1))
        h1, h2 = h1[order], h2[order]
        first = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]  # of equal windows that of the smallest document
        self.h1, self.h2, self.owner, self.place = h1[first], h2[first], owner[order][first], place[order][first]

    def covered(self, doc_id: int, words: list[bytes]) -> np.ndarray:
        """For each word whether a window that a smaller document has covers it."""
        edge = np.zeros(len(words) + 1, np.int64)
        if len(self.machine) and len(words) >= self.window:
            get = self.numbers.get
            ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
            ends = np.fromiter((end for end, _ in self.machine.iter(tuple(ids.tolist()))), np.int64)
            starts = self._windows_at(ends, len(ids) - self.window)
            h1, h2 = (h[starts] for h in self._hashes(ids))
            # Equal first hashes are rare; all of them are tried in turn.
            at = np.searchsorted(self.h1, h1)
            hit = np.zeros(len(starts), bool)
            while len(at):
                inside = at < len(self.h1)
                same = inside & (self.h1[np.where(inside, at, 0)] == h1)
                if not same.any():
                    break
                i = np.nonzero(same & ~hit)[0]
                i = i[(self.h2[at[i]] == h2[i]) & (self.owner[at[i]] < doc_id)]
                hit[i] = self._equal(ids, starts[i], self.place[at[i]])
                at = np.where(same, at + 1, len(self.h1))
            np.add.at(edge, starts[hit], 1)
            np.add.at(edge, starts[hit] + self.window, -1)
        return np.cumsum(edge[:-1]) > 0

    def _windows_at(self, ends: np.ndarray, last: int) -> np.ndarray:
        """Starts of all windows that hold a phrase which ends at one of ends."""
        edge = np.zeros(last + 2, np.int64)
        np.add.at(edge, np.clip(ends - self.window + 1, 0, last + 1), 1)
        np.add.at(edge, np.clip(ends - self.phrase + 2, 0, last + 1), -1)
        return np.nonzero(np.cumsum(edge[:-1]) > 0)[0]

    def _equal(self, ids: np.ndarray, starts: np.ndarray, places: np.ndarray) -> np.ndarray:
        out = np.ones(len(starts), bool)
        for k in range(self.window):
            out &= ids[starts + k] == self.flat[places + k]
        return out


def _stream(batches):
    """Rows (shard, kind, doc_id, sha, text) in order of shard and kind: a shard's passages (kind 0), then its documents."""
    shard, machine = None, None
    for rows in chunks(batches, lambda r: len(r[4]) // 6, 100_000):
        out = []
        for s, kind, doc_id, sha, text in rows:
            if s != shard:
                shard, machine = s, PhraseAutomaton()
            if kind == 0:
                machine.add(doc_id, text)
                continue
            if machine.machine is None:
                machine.compile()
            words = words_of(text)
            gone = machine.covered(doc_id, words)
            if gone.any():
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                out.append((doc_id, sha, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "sha", "n_removed", "kept_sha256", "kept"])


def shard_of(n_shards: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int")


def passages_of(texts: DataFrame, n_shards: int, scratch: Scratch) -> DataFrame:
    """(doc_id, part, text, shards): the confirmed passages, and the shards whose documents hold a window of them.

    A window's shards stand in sets of SHARDS_IN_SET (part), so that no row grows
    with the corpus where a window is everywhere."""
    windows = texts.select("doc_id", "text", "recurring").mapInArrow(tidy(_candidate_windows), "w1 long, w2 long, doc_id long, start int")
    windows = windows.withColumn("shard", shard_of(n_shards))
    first = (F.min(F.struct("doc_id", "start")).alias("m"), F.max("doc_id").alias("last"))
    if n_shards <= SHARDS_IN_SET:
        owned = windows.groupBy("w1", "w2").agg(*first, F.collect_set("shard").alias("shards")).where("m.doc_id < last").withColumn("part", F.lit(0))
    else:
        part = F.floor(F.col("shard") / SHARDS_IN_SET).cast("int").alias("part")
        parts = scratch.keep("parts", windows.groupBy("w1", "w2", part).agg(*first, F.collect_set("shard").alias("shards")))
        recurring = parts.groupBy("w1", "w2").agg(F.min("m").alias("m"), F.max("last").alias("last")).where("m.doc_id < last")
        owned = parts.select("w1", "w2", "part", "shards").join(recurring, ["w1", "w2"])
    owned = scratch.keep("owned", owned.select(F.col("m.doc_id").alias("doc_id"), F.col("m.start").alias("start"), "part", "shards"))
    places = owned.groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "shards")).alias("places"))
    sources = texts.select(F.col("doc_id").alias("t_id"), "text")
    cut = places.join(sources, F.expr("doc_id = t_id")).select("doc_id", "part", "text", "places")
    cut = cut.mapInArrow(tidy(_passages), "doc_id long, part int, text string, shards array<int>")
    if n_shards > SHARDS_IN_SET:
        cut = cut.repartition("doc_id", "part", F.xxhash64("text"))  # so that no one task replicates a passage to all shards
    passages = scratch.keep("passages", cut)
    scratch.drop("owned", "parts")
    return passages


def repeated_words(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(every row: doc_id, text_hash, n_words, sha, first; edited: doc_id, sha, n_removed, kept_sha256, kept).

    sha is the digest of a row's words, first the smallest doc_id with the same
    words. edited has the documents, one of each sequence, of which words go."""
    rows = scratch.keep("sequences", docs.select("doc_id", "text").mapInArrow(tidy(_sequences), "doc_id long, text_hash long, n_words long, sha string, anchors array<long>"))
    known = rows.where("doc_id is not null")
    firsts = scratch.keep("firsts", known.groupBy("sha").agg(F.min("doc_id").alias("first")))

    # Anchors of two different word sequences. One partial row for each anchor and task is shuffled.
    long_ones = known.where(f"n_words >= {WINDOW}")
    each = long_ones.select(F.explode("anchors").alias("anchor"), F.xxhash64("sha").alias("s"))
    shared = each.groupBy("anchor").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a < b").select("anchor")
    shared = scratch.keep("shared", shared)
    owners = long_ones.join(firsts.withColumnRenamed("sha", "f_sha"), F.expr("sha = f_sha and doc_id = first"))
    owners = owners.groupBy("doc_id", "sha").agg(F.min("text_hash").alias("text_hash"), F.first("anchors").alias("anchors"))
    held = owners.select("doc_id", "sha", "text_hash", F.explode("anchors").alias("anchor")).join(shared, "anchor")
    held = held.groupBy("doc_id", "sha", "text_hash").agg(F.collect_list("anchor").alias("recurring"))
    held = scratch.keep("held", held)

    named = held.select(F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash"), "sha", "recurring")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = texts.join(named, F.expr("doc_id = h_id and text_hash = h_hash")).select("doc_id", "sha", "text", "recurring")
    texts = scratch.keep("texts", texts)
    scratch.drop("shared", "held")
    n_shards = max(1, -(-int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    passages = passages_of(texts, n_shards, scratch)

    dealt = passages.select(F.explode("shards").alias("shard"), F.lit(0).alias("kind"), "doc_id", F.lit("").alias("sha"), "text")
    dealt = dealt.union(texts.select(shard_of(n_shards).alias("shard"), F.lit(1), "doc_id", "sha", "text"))
    tasks = min(n_shards, MOST_TASKS)
    dealt = dealt.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", "kind")
    edited = dealt.mapInArrow(tidy(_stream), "doc_id long, sha string, n_removed long, kept_sha256 string, kept string")
    edited = scratch.keep("edited", edited)
    scratch.drop("texts", "passages")
    return rows.drop("anchors").join(firsts, "sha", "left"), edited


def is_copy() -> Column:
    """All of a row's words go: another document with the same words has a smaller id."""
    return F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)) & (F.col("n_words") >= WINDOW)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs (doc_id, text).

    Windows are judged on the input. Null and empty texts have no words. A row
    with a null doc_id loses nothing and takes nothing. Rows with one doc_id do
    not take words from each other, repeated rows stay and lose the same words.
    An empty table gives no rows; other columns are ignored."""
    rows, edited = repeated_words(docs, Scratch(docs.sparkSession, "substrings"))
    edited = edited.groupBy("doc_id", "sha").agg(F.max("n_removed").alias("e_removed"), F.max("kept_sha256").alias("e_sha"))
    out = rows.join(edited, ["doc_id", "sha"], "left")
    removed = F.when(is_copy(), F.col("n_words")).otherwise(F.coalesce("e_removed", F.lit(0)))
    kept = F.when(is_copy(), EMPTY_SHA).otherwise(F.coalesce("e_sha", "sha"))
    return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), kept.alias("kept_sha256"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated words taken out of the texts, where there are any; columns as before.

    A text that loses words is its kept words joined by one space; others stay as they are."""
    rows, edited = repeated_words(docs, Scratch(docs.sparkSession, "substrings"))
    edited = edited.groupBy("doc_id", "sha").agg(F.max("kept").alias("kept"))
    new = rows.join(edited, ["doc_id", "sha"], "left").withColumn("kept", F.when(is_copy(), "").otherwise(F.col("kept"))).where("kept is not null")
    new = new.select(F.col("doc_id").alias("_r_id"), F.col("text_hash").alias("_r_hash"), F.col("kept").alias("_r_kept")).distinct()
    out = docs.withColumn("_hash", F.xxhash64("text")).join(new, F.expr("doc_id = _r_id and _hash = _r_hash"), "left")
    changed = {"text": F.coalesce("_r_kept", "text"), "n_chars": F.coalesce(F.length("_r_kept").cast("long"), "n_chars")}
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
