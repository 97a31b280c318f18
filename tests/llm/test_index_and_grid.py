"""The positional index step by step, the grid's bound, and labels of hot keys."""

from __future__ import annotations

import random
from itertools import pairwise

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canopy.llm import decontaminate, simhash
from canopy.llm.util import Scratch, join_labels

LONGS = st.integers(0, 2**64 - 1)


@given(st.lists(LONGS, min_size=2, max_size=20))
def test_the_bound_is_the_manhattan_distance_of_counts(fps):
    x = np.array(fps, np.uint64)
    words = simhash.counts_words(x)
    for (a, wa), (b, wb) in pairwise(zip(fps, words.tolist(), strict=True)):
        counts = [[(f >> 2 * s & 3).bit_count() for s in range(32)] for f in (a, b)]
        distance = sum(abs(p - q) for p, q in zip(*counts, strict=True))
        assert (wa ^ wb).bit_count() == distance <= (a ^ b).bit_count()


def test_counts_word_is_that_of_arrays(spark):
    fps = [random.Random(1).getrandbits(64) for _ in range(1)] + [0, 2**64 - 1, 2**63, 0x5555555555555555]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = spark.createDataFrame([(f,) for f in signed], "fp long").select("fp", simhash.counts_word(simhash.F.col("fp")).alias("w")).collect()
    want = simhash.counts_words(np.array([r.fp for r in got]).view(np.uint64)).view(np.int64)
    assert [r.w for r in got] == want.tolist()


@pytest.mark.parametrize("groups", [5, 7, 10])
def test_any_number_of_groups_finds_all_links(spark, groups):
    rng = random.Random(groups)
    near = {rng.getrandbits(64) for _ in range(30)}
    near |= {c ^ sum(1 << b for b in rng.sample(range(64), 4)) for c in list(near) for _ in range(8)}
    signed = [f - (1 << 64) if f >> 63 else f for f in near]
    got = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in simhash.link_edges(spark.createDataFrame([(f,) for f in signed], "fp long"), groups).collect()}
    up = {f: f for f in near}

    def find(f):
        while up[f] != f:
            f = up[f]
        return f

    for a, b in got:
        assert (a ^ b).bit_count() <= 4
        up[find(a)] = find(b)
    assert all(find(a) == find(b) for a in near for b in near if (a ^ b).bit_count() <= 4)
    with pytest.raises(ValueError):
        simhash.grid_masks(4)


def test_labels_of_hot_and_cold_keys(spark):
    rows = [(k, i) for k, n in ((1, 50), (2, 3), (3, 1)) for i in range(n)]
    labels = spark.createDataFrame([(1, "a", 50), (2, "b", 3), (3, "c", 1), (4, "d", 0)], "k long, label string, n long")
    got = join_labels(spark.createDataFrame(rows, "k long, i long"), labels, "k", floor=10)
    assert sorted(map(tuple, got.collect())) == sorted((k, i, " abc"[k]) for k, i in rows)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=25), min_size=1, max_size=8), st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=6), min_size=1, max_size=4))
def test_lists_are_intersected(spark, docs, items):
    """With windows of three words: agreed starts are those at which both rarest terms stand; matches are all exact ones."""
    texts = {i: [f"w{k}" for k in d] for i, d in enumerate(docs)}
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(f"w{k}" for k in w)) for i, w in enumerate(items)], "item_id long, text string")
    index, anchored = decontaminate.indexed(frame, bench, 2, 3, Scratch(spark, "test"))
    windows = {r.window: r for r in anchored.collect()}
    at = {r.posting: r for r in index.collect()}
    agreed = {(at[r.posting].doc_id, r.window, r.start) for r in decontaminate.intersect(index, anchored).collect()}

    def stands(w, start, offset, term):
        return 0 <= start + offset < len(w) and w[start + offset] == term

    want = set()
    for i, w in texts.items():
        for k, r in windows.items():
            for start in range(len(w)):
                if stands(w, start, r.first_at, r.first) and (r.second is None or stands(w, start, r.second_at, r.second)):
                    want.add((i, k, start))
    assert agreed == want
    found = decontaminate.phrase_matches(index, anchored, decontaminate.intersect(index, anchored))
    got = {(r.doc_id, r.phrase, r.start) for r in found.collect()}
    assert got == {(i, r.phrase, s) for i, w in texts.items() for r in windows.values() for s in range(len(w) - r.n + 1) if w[s : s + r.n] == r.terms}


def test_proximity_against_brute_force(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    items = [(0, "a b c"), (1, "j"), (2, "d d e f")]
    reach = 4
    got = decontaminate.proximity_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), reach)
    count = {}
    for _, t in docs:
        for w in t.split():
            count[w] = count.get(w, 0) + 1
    want = set()
    for _, item in items:
        terms = item.split()
        lead = min(enumerate(terms), key=lambda x: (count[x[1]], x[0]))[1]
        for i, t in docs:
            w = t.split()
            for p, x in enumerate(w):
                if x == lead and set(terms) <= set(w[max(0, p - reach) : p + reach + 1]):
                    want.add((i, item, p))
    assert {tuple(r) for r in got.collect()} == want and want
