from __future__ import annotations

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canopy.functions import codecs, scalars
from canopy.operators import huffman, ordered


@given(st.integers(0, 2**32 - 1))
def test_varnum_round_trip(v):
    assert codecs.read_varnum(codecs.write_varnum(v)) == (v, len(codecs.write_varnum(v)))


@pytest.mark.parametrize("data", [b"\x01\x01\x00", b"\x01\x01\x01\x00", b"\x01"])
def test_varnum_refuses(data):
    with pytest.raises(ValueError):
        codecs.read_varnum(data)


def test_varnum_zero_and_null():
    assert codecs.read_varnum(b"\x00") == (0, 1)
    assert codecs.read_varnum(codecs.write_maybe_varnum(None)) == (None, 2)


@given(st.one_of(st.none(), st.floats(allow_nan=False), st.integers(-(2**31) + 1, 2**31 - 1).map(float)))
def test_varfloat_round_trip(v):
    got, _ = codecs.read_maybe_varfloat(codecs.write_maybe_varfloat(v))
    assert got == v and (v is None or math.copysign(1, got) == math.copysign(1, v))
    assert codecs.float_of_bytes(codecs.bytes_of_float(v)) == v


@given(st.integers(0, 2**40))
def test_varuint_round_trip(v):
    assert codecs.read_varuint(codecs.write_varuint(v))[0] == v


@given(st.lists(st.tuples(st.integers(0, 255), st.integers(8, 12))))
def test_bits_round_trip(items):
    w = codecs.BitWriter()
    for v, n in items:
        w.write(v, n)
    r = codecs.BitReader(w.done())
    assert [r.read(n) for _, n in items] == [v for v, _ in items]


def test_escape():
    assert codecs.escape(b"\xed\xa0\xbe") == "\x7fD83E" and codecs.escape(b"\x7f") == "\x7f007F"


@given(st.text(st.characters(codec=None)))
def test_escape_round_trip(text):
    data = text.encode("utf-8", "surrogatepass")
    assert codecs.unescape(codecs.escape(data)).decode("utf-8", "surrogatepass") == text


@given(st.lists(st.text()))
def test_strings_round_trip(strings):
    assert codecs.read_strings(codecs.write_strings(strings))[0] == strings


@pytest.mark.parametrize("name", list(codecs.CODECS))
def test_codecs(name):
    assert codecs.decompress_section(codecs.compress_section(name, b"abc" * 99))[:2] == (name, b"abc" * 99)


def test_missing_codec():
    with pytest.raises(ValueError, match="brotli"):
        codecs.codec("brotli")


def test_lengths_match_bytes(spark):
    values = [0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 2**28, None]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", scalars.varnum_length(F.col("v")).alias("n")).collect()
    assert all(r.n == len(codecs.write_maybe_varnum(r.v)) for r in rows)
    floats = [0.0, -0.0, 1.5, -3.0, 2.0**31, 64.0, -64.0, 1e300, None, float("inf")]
    rows = spark.createDataFrame([(v,) for v in floats], "v double").select("v", scalars.varfloat_length(F.col("v")).alias("n")).collect()
    assert all(r.n == len(codecs.write_maybe_varfloat(r.v)) for r in rows), rows


def test_unicode_escapes(spark):
    row = spark.createDataFrame([("a\x7fD83Eb",)], "s string").select(scalars.to_unicode_escape(F.col("s")).alias("u"))
    assert row.first().u == "a\\uD83Eb"
    assert row.select(scalars.from_unicode_escape(F.col("u")).alias("s")).first().s == "a\x7fD83Eb"


def test_huffman_cases():
    assert huffman.code_lengths({"a": 47}) == {"a": 0}
    assert huffman.code_lengths({"a": 20, "b": 3, "c": 1}) == {"a": 1, "b": 2, "c": 2}
    lengths = huffman.code_lengths({"a": 1, "p": 2, "l": 1})
    assert lengths == {"p": 1, "a": 2, "l": 2} and huffman.canonical(lengths) == {"p": 0b0, "a": 0b10, "l": 0b11}
    with pytest.raises(ValueError, match="2 bits"):
        huffman.code_lengths({"a": 1, "p": 2, "l": 1}, limit=1)
    assert [huffman.model_cost(t, 1024) for t in ({"a": 1}, {"a": 1, "b": 1}, {"a": 1, "b": 2, "c": 2})] == [10, 20, 32]


@given(st.dictionaries(st.integers(0, 99), st.integers(1, 1000), min_size=2))
def test_huffman_invariants(counts):
    lengths = huffman.code_lengths(counts)
    assert sum(2.0**-n for n in lengths.values()) == 1
    total = sum(counts.values())
    entropy = -sum(n / total * math.log2(n / total) for n in counts.values())
    mean = sum(counts[s] * lengths[s] for s in counts) / total
    assert entropy - 1e-9 <= mean < entropy + 1


def test_mru_case():
    got = ["NA"[seen] + str(n) for seen, n in ordered.mru_ages("aaabbaacaab")]
    assert got == "N0 A0 A0 N1 A0 A1 A0 N2 A1 A0 A1".split()[:9] + got[9:] and got[8:10] == ["A1", "A0"]


def test_block_split_case():
    values = list("a man aa plaaan a canal panama")
    blocks = ordered.split_blocks(values)
    assert blocks[0][0] == 0 and blocks[-1][1] == len(values) and all(a[1] == b[0] for a, b in zip(blocks, blocks[1:], strict=False))
    from collections import Counter

    cost = sum(ordered._block_cost(Counter(values[a:b]), a, b) for a, b in blocks)
    assert int(cost) <= 90 < 115
    assert ordered.split_blocks(list("aaaaaa")) == [(0, 6)]


@given(st.lists(st.tuples(st.sampled_from(["prelude", "shared"]), st.integers(0, 9))), st.integers(0, 9))
def test_references_round_trip(refs, window):
    a, b = ordered.References(window, 10, 10), ordered.References(window, 10, 10)
    assert [b.decode(a.encode(r)) for r in refs] == refs
