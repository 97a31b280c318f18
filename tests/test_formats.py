from __future__ import annotations

import json
import math
import xml.etree.ElementTree as ET

import pytest
from hypothesis import given
from hypothesis import strategies as st

from canopy.sources import formats

leaves = st.one_of(st.none(), st.booleans(), st.floats(allow_nan=False), st.text(max_size=5))
names = st.sampled_from(["a", "b", "c", "[[x]]"])
trees = st.recursive(leaves, lambda t: st.one_of(st.lists(t, max_size=4), st.builds(lambda i, d: {"type": i} | d, names, st.dictionaries(names, t, max_size=3))), max_leaves=30)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b and math.copysign(1, a) == math.copysign(1, b)
    if isinstance(a, list):
        return isinstance(b, list) and len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict):
        return isinstance(b, dict) and list(a) == list(b) and all(same(a[k], b[k]) for k in a)
    return a == b and type(a) is type(b)


@pytest.mark.parametrize("name", ["multipart", "streams"])
@given(trees)
def test_round_trip(name, tree):
    write, read = formats.FORMATS[name]
    assert same(read(write(tree)), tree)


@pytest.mark.parametrize("codec", ["identity", "gzip", "zstd"])
def test_codecs_and_damage(codec):
    data = formats.encode_multipart({"type": "A", "x": ["s"] * 20}, codec)
    assert formats.decode_multipart(data) == {"type": "A", "x": ["s"] * 20}
    with pytest.raises(ValueError):
        formats.decode_multipart(data[:40])


def test_deep_tree():
    deep = None
    for _ in range(3000):
        deep = {"type": "N", "v": [deep]}
    back, n = formats.decode_streams(formats.encode_streams(deep)), 0
    while back is not None:
        back, n = back["v"][0], n + 1
    assert n == 3000


def test_xml():
    x = ET.fromstring(formats.to_xml({"type": "A", "x": [1.5, "<&>"], "y": None}))
    assert [c.tag for c in x] == ["list", "value"] and json.loads(x[0][1].text) == "<&>"


@pytest.mark.parametrize("name", ["multipart", "streams", "json"])
def test_tables(spark, name):
    tree = {"type": "Script", "statements": [{"type": "Lit", "v": 1.0}, None]}
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, "junk")], "file_id long, json string")
    back = formats.decode_files(formats.encode_files(df, name), name).collect()
    assert [(r.file_id, json.loads(r.json)) for r in back] == [(1, tree)]
