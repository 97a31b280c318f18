"""Token ids in a binary file format of compressed bit planes.

A file holds the ids of consecutive documents in blocks of 65,536. A block is
transposed: plane k has bit k of all its ids (or byte k, with kind="byte"), and
each plane is compressed on its own with zstandard, as planes of high bits
compress far better than the ids they come from. The footer has the chunk index
(each block's place, number of ids and plane lengths) and the document index
(ids and lengths of the documents), so that any block can be read alone.

    magic | planes of block 0 | planes of block 1 | ... | footer | footer length (u64) | magic
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .util import Scratch, open_fs, table, text_chunks, tidy

MAGIC = b"IDPLANE1"
BLOCK = 65_536
FILE_IDS = 1 << 26  # a file is closed after so many ids
CHUNK_BYTES = 8 << 20  # of texts that are encoded at a time
JOINED = 1024  # distinct fragments that are merged in one call
#: A space before any other than white space always begins a new word of the byte-level pattern.
BREAK = re.compile(r" (?=\S)")
#: A space before white space (in the widest sense) or the end, for Arrow's expressions.
ODD = r" (?:[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"
#: The normaliser and pre-tokenizer of the file for which the short way holds.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: ASCII without apostrophes (which begin contractions), two-byte Latin letters, and single line breaks.
_SHORT = r"[!-&(-~\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{1bf}]+"
SHORT = rf"\A{_SHORT}(?:\n{_SHORT})*\n?\z"
#: A token, byte by byte, that holds a place where the pattern cuts such text: between letter, digit and others, or at white space.
_LETTER, _OTHER = "(?:[A-Za-z]|(?:^|[\xc3-\xc6])[\x80-\xbf])", "!-&(-/:-@\\[-`{-~"
CROSSES = re.compile(f"{_LETTER}[ \n0-9{_OTHER}]|[0-9][ \nA-Za-z\xc3-\xc6{_OTHER}]|[{_OTHER}][ \nA-Za-z\xc3-\xc60-9]|\n[ -~\xc3-\xc6]")


class FragmentEncoder:
    """Ids of texts, which are cut at spaces into fragments; all but a text's first begin with the space cut off.

    Arrow cuts the texts and finds the distinct fragments of a chunk, each of
    which is encoded once; numpy puts the ids together. Nothing is kept between
    chunks. Fragments are merged many at a time, without the pattern: where no
    token of the vocabulary `CROSSES` a place at which the pattern cuts such
    text, merges cannot either. Where one does, or where a fragment has other
    characters, the library encodes the fragment alone."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        letters = byte_alphabet()
        self.letters = {b: c for c, b in letters.items()}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.begins = np.zeros(max(vocab.values()) + 1, bool)  # with a space
        self.short = spec["normalizer"] is None and spec["pre_tokenizer"] == PRE_TOKENIZER
        for token, i in vocab.items():
            self.begins[i] = token[0] == self.letters[32]
            if self.short and token not in added and CROSSES.search("".join([chr(letters[c]) for c in token])):
                self.short = False

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def fragments(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths): where in ids those of each fragment are, the space before it included."""
        short = np.zeros(len(distinct), bool)
        if self.short:
            short = pc.and_not(pc.match_substring_regex(distinct, SHORT), pc.match_substring(distinct, "<|")).to_numpy(zero_copy_only=False)
        pool, lengths, n = [np.zeros(0, np.uint32)], np.zeros(len(distinct), np.int64), 0
        own = distinct.filter(pa.array(short)).to_pylist()
        begun = [np.zeros(0, np.int64)]
        for at in range(0, len(own), JOINED):
            line = " " + " ".join(own[at : at + JOINED])
            ids = np.array([t.id for t in self.model.tokenize(line.encode().decode("latin-1").translate(self.letters))], np.uint32)
            begun.append(np.nonzero(self.begins[ids])[0] + n)
            pool.append(ids)
            n += len(ids)
        bounds = np.concatenate([*begun, [n]])
        if len(bounds) != len(own) + 1:
            raise ValueError("a fragment's ids do not begin with the space before it")
        lengths[short] = np.diff(bounds)
        alone = [np.array(self.plain(" " + f), np.uint32) for f in distinct.filter(pa.array(~short)).to_pylist()]
        lengths[~short] = [len(ids) for ids in alone]
        starts = np.zeros(len(distinct), np.int64)
        starts[short] = bounds[:-1]
        starts[~short] = n + np.cumsum(lengths[~short]) - lengths[~short]
        return np.concatenate([*pool, *alone]), starts, lengths

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts, and where each text's end."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(texts, " ")
        if odd.any():
            cut = pa.array([BREAK.split(t) for t in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
            parts = pa.concat_arrays([parts.filter(pa.array(~odd)), cut])
            parts = parts.take(pa.array(np.argsort(np.concatenate([np.nonzero(~odd)[0], np.nonzero(odd)[0]]))))
        sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)  # at least 1
        flat = parts.flatten()
        heads = np.cumsum(sizes) - sizes
        coded = flat.dictionary_encode()
        pool, starts, lengths = self.fragments(coded.dictionary)
        which = coded.indices.to_numpy(zero_copy_only=False)
        start, length = starts[which], lengths[which]
        # A text's first fragment has no space before it.
        first = [np.array(self.plain(h) if h else [], np.uint32) for h in flat.take(pa.array(heads)).to_pylist()]
        length[heads] = [len(ids) for ids in first]
        start[heads] = len(pool) + np.cumsum(length[heads]) - length[heads]
        pool = np.concatenate([pool, *first])
        ends = np.cumsum(length)
        source = np.repeat(start - ends + length, length) + np.arange(ends[-1])
        return pool[source], ends[heads + sizes - 1]

    def text(self, text: str | None) -> bytes:
        return self.texts(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


_encoders: dict[str, FragmentEncoder] = {}


def encoder(path: str) -> FragmentEncoder:
    if path not in _encoders:
        _encoders[path] = FragmentEncoder(path)
    return _encoders[path]


def to_planes(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """Planes of one block, the lowest first; planes above the highest used are left out."""
    if kind == "byte":
        octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        used = (int(ids.max(initial=0)).bit_length() + 7) // 8
        return [octets[:, k].tobytes() for k in range(used)]
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1).tobytes() for k in range(int(ids.max(initial=0)).bit_length())]


def from_planes(planes: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        if kind == "byte":
            ids |= np.frombuffer(plane, np.uint8, n).astype(np.uint32) << np.uint32(8 * k)
        else:
            ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return ids


class PlaneWriter:
    """Appends documents' ids; `close` writes the indices."""

    def __init__(self, stream, kind: str = "bit", level: int = 3):
        self.stream, self.kind, self.zip = stream, kind, zstandard.ZstdCompressor(level=level)
        self.at, self.blocks, self.docs, self.held, self.n_held, self.n_ids = len(MAGIC), [], [], [], 0, 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        while self.n_held >= BLOCK:
            flat = np.concatenate(self.held)
            self._block(flat[:BLOCK])
            self.held, self.n_held = [flat[BLOCK:]], len(flat) - BLOCK

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.zip.compress(p) for p in to_planes(ids, self.kind)]
        self.blocks.append([self.at, len(ids), [len(p) for p in packed]])
        for p in packed:
            self.stream.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        footer = self.zip.compress(json.dumps({"kind": self.kind, "block": BLOCK, "n_ids": self.n_ids, "blocks": self.blocks, "docs": self.docs}).encode())
        self.stream.write(footer)
        self.stream.write(len(footer).to_bytes(8, "little"))
        self.stream.write(MAGIC)
        self.stream.close()


class PlaneReader:
    """Random access to a file: `block(i)`; `documents()` streams them all."""

    def __init__(self, stream, size: int):
        self.stream, self.zip = stream, zstandard.ZstdDecompressor()
        stream.seek(size - 16)
        tail = stream.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a file of id planes, or cut short")
        n = int.from_bytes(tail[:8], "little")
        stream.seek(size - 16 - n)
        footer = json.loads(self.zip.decompress(stream.read(n)))
        self.kind, self.blocks, self.docs, self.n_ids = footer["kind"], footer["blocks"], footer["docs"], footer["n_ids"]

    def block(self, i: int) -> np.ndarray:
        at, n, lengths = self.blocks[i]
        self.stream.seek(at)
        data, planes, p = self.stream.read(sum(lengths)), [], 0
        for x in lengths:
            planes.append(self.zip.decompress(data[p : p + x]))
            p += x
        return from_planes(planes, n, self.kind)

    def documents(self):
        i, held = 0, np.zeros(0, np.uint32)
        for doc_id, n in self.docs:
            parts = [held]
            have = len(held)
            while have < n:
                parts.append(self.block(i))
                have += len(parts[-1])
                i += 1
            flat = np.concatenate(parts) if len(parts) > 1 else held
            held = flat[n:]
            yield doc_id, flat[:n]


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = 0, kind: str = "bit") -> DataFrame:
    """Encodes docs (doc_id, text) and writes files below folder, in ascending doc_id (null first).

    Gives the manifest, a row a file: part and file_no (which order the files),
    path, n_docs and n_ids. Each attempt of a task writes under names of its own,
    and only files of the manifest count, so retried tasks do no harm."""

    def run(batches):
        enc, part, w, file_no, target = encoder(path), TaskContext.get().partitionId(), None, 0, ""
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)

        def close():
            w.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file_no": pa.array([file_no], pa.int32()), "path": [target], "n_docs": pa.array([len(w.docs)], pa.int64()), "n_ids": pa.array([w.n_ids], pa.int64())})

        for doc_ids, texts in text_chunks(batches, CHUNK_BYTES):
            ids, ends = enc.texts(texts)
            for doc_id, start, end in zip(doc_ids.to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if w is None:
                    target = f"{folder}/{part:06d}-{file_no:03d}-{uuid.uuid4().hex[:8]}.idp"
                    w = PlaneWriter(fs.open_output_stream(open_fs(target)[1]), kind)
                w.add(doc_id, np.append(ids[start:end], np.uint32(end_id)))
                if w.n_ids >= FILE_IDS:
                    yield close()
                    w, file_no = None, file_no + 1
        if w is not None:
            yield close()

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"))
    return ordered.mapInArrow(tidy(run), "part int, file_no int, path string, n_docs long, n_ids long")


def read_ids(manifest: DataFrame, real: bool = False) -> DataFrame:
    """Reads the files of a manifest: doc_id, start, n_tokens, ids_crc32, with real=True also ids.

    start counts the ids of all documents before; the manifest has a row a file,
    and its running sum is all that is computed in one task."""
    n = manifest.count()
    upto = Window.orderBy("part", "file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(upto), F.lit(0)).cast("long").alias("base")).repartition(max(1, n))

    def run(batches):
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, p = open_fs(file)
                with fs.open_input_file(p) as stream:
                    out, size = [], 0
                    for doc_id, ids in PlaneReader(stream, stream.size()).documents():
                        out.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids if real else None))
                        base += len(ids)
                        size += len(ids)
                        if size > 1_000_000:
                            yield _batch(out, real)
                            out, size = [], 0
                    if out:
                        yield _batch(out, real)

    return files.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if real else ""))


def _batch(out: list, real: bool) -> pa.RecordBatch:
    cols = {k: pa.array([r[i] for r in out], pa.int64()) for i, k in enumerate(("doc_id", "start", "n_tokens", "ids_crc32"))}
    if real:
        cols["ids"] = pa.array([r[4].tolist() for r in out], pa.list_(pa.int64()))
    return pa.RecordBatch.from_pydict(cols)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_planes(docs: DataFrame, path: str | None = None, end_id: int = 0, kind: str = "bit", real: bool = False) -> DataFrame:
    """Encodes every whole text of docs, writes the ids as files, and reads them back.

    A null text counts as empty and has the end id alone. Null doc_ids come
    first; repeated rows stay, next to each other; an empty table gives no rows.
    Other columns are ignored. The files stay in the shared scratch folder."""
    scratch = Scratch(docs.sparkSession, "planes")
    manifest = scratch.keep("manifest", write_ids(docs, scratch.sub("ids"), path or default_path(), end_id, kind))
    return read_ids(manifest, real)


def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes(table(spark, sf_dir, "documents"))
