"""BPE encoding and decoding with forced boundaries.

Two bytes that stand next to each other inside no vocabulary token can never end
up in one token, so the text may be cut between them, the fragments encoded on
their own, and the results concatenated. Two levels of such cuts are used:

1. ASCII white space occurs inside no token, so the whole text is cut there
   first, before normalisation (it neither composes with marks nor joins words).
2. A fragment that is not yet known is normalised and split into words, and each
   word is cut at every byte pair that no token holds. All fragments of a word
   but the last are encoded by the same merges without the end-of-word suffix.

Fragments repeat far more often than texts, so Arrow finds the distinct ones of a
chunk, and each is encoded once. Of their words a bounded table is kept until the
task ends.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .util import table, text_chunks, tidy

CHUNK_BYTES = 8 << 20  # of texts that are encoded at a time
KNOWN_WORDS = 200_000  # some 50 MB a worker; the table is emptied beyond this, and when a task ends
LONGEST_KNOWN = 64  # characters; longer words are not kept
#: Latin letters, digits and marks that NFC leaves alone and whose lower case does not depend on neighbours.
LATIN = re.compile("[!-~\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u012f\u0131-\u024f]+")
#: What the file's pattern finds in such text, in lower case.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: The normaliser and pattern of the file for which the short way holds.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Fragment (without ASCII white space) -> (ids, tokens), both joined by spaces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.last = self.whole.model
        self.inner = BPE(self.vocab, merges) if self.suffix else self.last
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.letters = byte_alphabet()
        #: [x, y]: byte y follows byte x inside some token.
        self.joined = np.zeros((256, 256), bool)
        for token in self.vocab:
            b = [self.letters.get(c) for c in token.removesuffix(self.suffix)]
            for x, y in zip(b, b[1:], strict=False):
                if x is not None and y is not None:
                    self.joined[x, y] = True
        white = [9, 10, 11, 12, 13, 32]
        if self.joined[white].any() or self.joined[:, white].any():
            raise ValueError(f"{path}: white space occurs inside tokens, and is no forced boundary")
        pairs = {c: i for c, i in self.letters.items()}
        self.cut = {x + y for x in pairs for y in pairs if not self.joined[pairs[x], pairs[y]]}
        self.forget()
        self.signs = {b: c for c, b in self.letters.items()}
        self.latin = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == PATTERN

    def forget(self) -> None:
        """Empties the table of words."""
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def _piece(self, piece: str, last: bool) -> list[int]:
        return [t.id for t in (self.last if last else self.inner).tokenize(piece)]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word in the byte alphabet: cut at the forced boundaries, then joined."""
        out: list[int] = []
        start, cut = 0, self.cut
        for i in [i for i, pair in enumerate(map(add, word, word[1:]), 1) if pair in cut]:
            out += self._piece(word[start:i], False)
            start = i
        return out + self._piece(word[start:], True)

    def word(self, word: str) -> tuple[bytes, bytes]:
        found = self.known.get(word)
        if found is None:
            ids = self.encode_word(word)
            found = " ".join(map(str, ids)).encode(), " ".join(map(self.tokens.__getitem__, ids)).encode()
            if len(self.known) >= KNOWN_WORDS:
                self.forget()
            if len(word) <= LONGEST_KNOWN:
                self.known[word] = found
        return found

    def words(self, text: str) -> list[str]:
        """The words of a normalised fragment, in the byte alphabet.

        Latin text takes a short way, where lower case is all that the normaliser
        changes and the pattern needs no classes of other scripts."""
        if self.latin and LATIN.fullmatch(text):
            found = WORD.findall(text.lower())
            return found if text.isascii() else [w if w.isascii() else w.encode().decode("latin-1").translate(self.signs) for w in found]
        if self.whole.normalizer is not None:
            text = self.whole.normalizer.normalize_str(text)
        return [w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(text)]

    def fragment(self, text: str) -> tuple[bytes, bytes]:
        if "<|" in text and any(a in text for a in self.added):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return b" ".join(b"%d" % i for i in ids), " ".join(self.tokens[i] for i in ids).encode()
        parts = [self.word(w) for w in self.words(text)]
        return parts[0] if len(parts) == 1 else (b" ".join([p[0] for p in parts]), b" ".join([p[1] for p in parts]))

    def texts(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Ids as decimals joined by spaces, and the decoded texts, of whole texts; both binary."""
        parts = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = parts.flatten().dictionary_encode()
        made = [self.fragment(f) if f else (b"", b"") for f in coded.dictionary.to_pylist()]
        which = coded.indices.to_numpy(zero_copy_only=False)
        kept = np.array([bool(ids) for ids, _ in made], bool)[which]  # a fragment may have no token at all
        of = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)[kept]
        offsets = np.zeros(len(texts) + 1, np.int32)
        np.cumsum(np.bincount(of, minlength=len(texts)), out=offsets[1:])
        which = pa.array(which[kept])

        def joined(k: int) -> pa.Array:
            each = pa.array([m[k] for m in made], pa.binary()).take(which)
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), each), b" ")

        return joined(0), joined(1)

    def text(self, text: str | None) -> tuple[bytes, bytes]:
        ids, decoded = self.texts(pa.array([text], pa.string()))
        return ids[0].as_py(), decoded[0].as_py()


_encoders: dict[str, ForcedBoundaryBPE] = {}


def encoder(path: str) -> ForcedBoundaryBPE:
    if path not in _encoders:
        _encoders[path] = ForcedBoundaryBPE(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, real: bool = False) -> DataFrame:
    """Encodes and decodes every whole text of docs (doc_id, text).

    Gives doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space) and
    decoded_sha256 (of the decoded text, which for a vocabulary without a decoder
    is its tokens joined by a space); with real=True also `ids` and `decoded`. A
    null text counts as empty: no tokens, digests of the empty string. Repeated
    rows and null doc_ids stay; other columns are ignored. Needs no shuffle.
    path: a tokenizer file that all executors have, by default the public one.
    """
    path = path or default_path()

    def run(batches):
        bpe = encoder(path)
        try:
            for doc_ids, texts in text_chunks(batches, CHUNK_BYTES):
                ids, decoded = (column.to_pylist() for column in bpe.texts(texts))
                cols = {
                    "doc_id": doc_ids,
                    "n_tokens": pa.array([i.count(b" ") + 1 if i else 0 for i in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                }
                if real:
                    cols["ids"] = pa.array([list(map(int, i.split())) for i in ids], pa.list_(pa.int32()))
                    cols["decoded"] = pa.array([d.decode() for d in decoded])
                yield pa.RecordBatch.from_pydict(cols)
        finally:
            bpe.forget()  # the worker may live on for other tasks

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema + (", ids array<int>, decoded string" if real else ""))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
