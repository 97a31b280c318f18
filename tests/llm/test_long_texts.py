"""Texts longer than what the operators hold at a time."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from canopy.llm import bpe, language, quality, simhash, substrings, token_planes
from canopy.llm.util import text_chunks


def long_text(n, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta,", "naïve", "it's", "x1", "(gamma)", "日本", "end.\n", "don't", "  "]
    return " ".join(rng.choices(words, k=n))


def test_pieces_do_not_change_vectors(monkeypatch):
    texts = [long_text(300), "", "1 2", long_text(5_000, 2), "é"]
    whole, has = language.text_vectors(texts)
    for piece in (7, 1_000):
        monkeypatch.setattr(language, "PIECE", piece)
        got, own = language.text_vectors(texts)
        assert (got == whole).all() and (own == has).all()


def test_slices_of_rows():
    sizes = np.array([5, 5, 30, 1, 1, 1, 1], np.int64)
    cuts = language._cuts(sizes, most=3, limit=10)
    assert cuts == [(0, 2), (2, 3), (3, 6), (6, 7)] and language._cuts(sizes[:0]) == []


def test_chunks_of_texts():
    texts = ["a" * n for n in (3, 3, 50, 1, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["k", "t"])
    got = [(k.to_pylist(), t.to_pylist()) for k, t in text_chunks([batch], 10)]
    assert sum((k for k, _ in got), []) == list(range(6)) and sum((t for _, t in got), []) == texts and len(got) >= 2


@pytest.mark.parametrize("n", [0, 1, 3, 200_000])
def test_tokens_of_long_texts(n):
    from tokenizers import Tokenizer

    text = long_text(n)
    t = Tokenizer.from_file(token_planes.default_path())
    assert token_planes.encoder(token_planes.default_path()).text(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    library = Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    ids = library.encode(text, add_special_tokens=False).ids
    own = bpe.encoder(bpe.default_path())
    assert own.text(text) == (" ".join(map(str, ids)).encode(), library.decode(ids, skip_special_tokens=False).encode())
    own.forget()


def test_long_documents_pass_all_operators(spark):
    text = long_text(400_000)
    assert len(text) > 2 * language.PIECE
    rows = [(1, text, "en", "s", len(text)), (2, text + " more", "en", "s", len(text) + 5), (3, None, None, "s", 0), (4, "kurz und gut", "de", "s", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    assert got[3] == "und" and set(got) == {1, 2, 3, 4}
    kept = language.keep_identified(docs, language.fit_prototypes(docs)).collect()
    assert {r.doc_id: r.text for r in kept} == {1: text, 2: text + " more", 4: "kurz und gut"}
    assert {r.doc_id: r.component_id for r in simhash.simhash_components(docs).collect()}[2] == 1
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.substring_dedup(docs).collect()}
    n = len(text.split())
    assert removed[2] == (n + 1, n) and removed[1] == (n, 0)
    assert {r.doc_id: r.n_words for r in quality.measures(docs).collect()} == {1: n, 2: n + 1, 3: 0, 4: 3}
