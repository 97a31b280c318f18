"""Substring dedup where a passage is in very many shards."""

from __future__ import annotations

import random

import pytest
from test_brute_force import plain_removal

from canopy.llm import substrings


@pytest.mark.parametrize(("in_set", "tasks"), [(2, 100_000), (1024, 3)])
def test_shards_in_sets(spark, monkeypatch, in_set, tasks):
    monkeypatch.setattr(substrings, "SHARD_BYTES", 3_000)
    monkeypatch.setattr(substrings, "SHARDS_IN_SET", in_set)
    monkeypatch.setattr(substrings, "MOST_TASKS", tasks)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    everywhere, long_one = rng.choices(vocabulary, k=70), rng.choices(vocabulary, k=900)
    made = {}
    for i in range(60):
        at = rng.randint(0, 700)
        parts = [rng.choices(vocabulary, k=rng.randint(0, 40)), everywhere, long_one[at : at + rng.randint(40, 200)] if i else long_one]
        rng.shuffle(parts)
        made[i * 13 % 61] = " ".join(sum(parts, []))
    want = plain_removal(made)
    assert sum(0 < v[1] < v[0] for v in want.values()) > 40
    got = substrings.substring_dedup(spark.createDataFrame(list(made.items()), "doc_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == want
