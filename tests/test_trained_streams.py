"""Trees encoded with a dictionary that writer and reader share."""

from __future__ import annotations

import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canopy.functions import codecs
from canopy.operators import trees
from canopy.sources import formats
from canopy.sources.streams import read_sections

VALUES = st.none() | st.booleans() | st.sampled_from(["a", "b", "", "😀"]) | st.sampled_from([0.0, -0.0, 1.5, 1e300, float("inf"), 3.0])
TREES = st.recursive(VALUES, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from("xyz"), x, max_size=3).map(lambda d: {"type": "T", **d}), max_leaves=25)


@settings(max_examples=150, deadline=None)
@given(TREES)
def test_round_trip(tree):
    shared = formats.SharedTables({"strings": ["a", "😀"], "floats": [0.0, 3.0, -0.0], "list_lengths": [2, 3]})
    back = formats.decode_streams(formats.encode_streams(tree, shared=shared), shared=shared)
    assert json.dumps(back) == json.dumps(tree, default=float) or back == tree
    assert math.copysign(1, formats.decode_streams(formats.encode_streams({"type": "T", "x": -0.0}, shared=shared), shared=shared)["x"]) == -1


def test_training_saves_preludes(spark):
    rng = random.Random(1)
    words = [f"word-{i}" for i in range(40)]
    made = [(i, json.dumps({"type": "T", "x": [rng.choice(words) for _ in range(20)], "y": rng.choice([1.5, 2.5]), "z": f"only {i}"})) for i in range(50)]
    files = spark.createDataFrame(made, "file_id long, json string")
    shared = formats.train_tables(trees.shred_tokens(files), 2)
    assert set(shared.values["strings"]) <= set(words) and shared.values["floats"] == [1.5, 2.5] and shared.values["list_lengths"] == [20]
    encoded = formats.encode_files(files, "streams", shared)
    plain = formats.encode_files(files, "streams")
    size = lambda df: df.selectExpr("sum(length(content))").first()[0]
    assert size(encoded) < size(plain)
    # Preludes hold what is not shared, and nothing else.
    for r in encoded.collect():
        held, _ = codecs.read_strings(read_sections(bytes(r.content))["prelude"]["strings"])
        assert f"only {r.file_id}" in held and not set(held) & set(shared.values["strings"])
    back = {r.file_id: json.loads(r.json) for r in formats.decode_files(encoded, "streams", shared).collect()}
    assert back == {i: json.loads(j) for i, j in made}
    with pytest.raises(ValueError):
        formats.train_tables(trees.shred_tokens(files), 2, most=3)


@pytest.mark.parametrize("name", ["multipart", "streams", "json"])
def test_broken_files_are_skipped(spark, name):
    files = spark.createDataFrame([(i, json.dumps({"type": "T", "x": [str(i), i, None]})) for i in range(6)], "file_id long, json string")
    rows = [(r.file_id, bytes(r.content)) for r in formats.encode_files(files, name).collect()]
    rng = random.Random(2)
    broken = [(i, c if i < 3 else c[: len(c) // 2] if i == 3 else rng.randbytes(30) if i == 4 else b"") for i, c in rows]
    back = formats.decode_files(spark.createDataFrame(broken, "file_id long, content binary"), name).collect()
    assert {0, 1, 2} <= {r.file_id for r in back} <= {0, 1, 2, 3}
