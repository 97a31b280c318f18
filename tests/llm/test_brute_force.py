"""Operators against plain Python on small data."""

from __future__ import annotations

import hashlib
import io
import os
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canopy.llm import bpe, decontaminate, language, quality, sharding, simhash, substrings, token_planes, url_filter, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# WARC


def archive_of(n, pack):
    parts = []
    for i in range(n):
        body = (b"<p>%d</p>" % i) * 20
        parts.append(pack(warc.page_record(i, f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), None)))
    return parts


@pytest.mark.parametrize("pack", [warc.member, lambda x: x])
@settings(max_examples=60, deadline=None)
@given(st.integers(0, 9), st.integers(0, 200), st.binary(min_size=1, max_size=40), st.booleans())
def test_salvage_recovers_all_but_the_damaged(pack, victim, at, junk, insert):
    parts = archive_of(10, pack)
    hit = parts[victim]
    at = min(at, len(hit) - 1)
    parts[victim] = hit[:at] + junk + hit[at + (0 if insert else len(junk)) :]
    data = b"".join(parts)
    found = list(warc.salvage(io.BytesIO(data)))
    whole = {x.headers["WARC-Record-ID"] for x in found if isinstance(x, warc.Record)}
    assert {f"<urn:page:{i}>" for i in range(10)} - whole <= {f"<urn:page:{victim}>", f"<urn:page:{victim + 1}>"}
    for gap in (x for x in found if isinstance(x, warc.Gap)):
        assert 0 <= gap.start < gap.end <= len(data) and gap.reason


def test_cut_archive_is_quarantined_to_its_end():
    data = b"".join(archive_of(4, warc.member))[:-9]
    *records, gap = warc.salvage(io.BytesIO(data))
    assert len(records) == 3 and isinstance(gap, warc.Gap) and gap.end == len(data)


def test_read_warc_logs_gaps(spark, tmp_path):
    parts = archive_of(5, warc.member)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(parts[0] + b"\x1f\x8b\x08junk" + b"".join(parts[1:]))
    read = warc.read_warc(spark.createDataFrame([(str(path),)], "path string"))
    assert warc.clean(read).count() == 5
    assert [tuple(r)[1:3] for r in warc.gaps(read).collect()] == [(len(parts[0]), len(parts[0]) + 7)]


# Language


def test_held_out_accuracy(spark, docs):
    got = language.identify(docs).where("held_out").collect()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) / len(got) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in language.identify(docs).collect())


def test_vectors_are_bound_and_bundled():
    text = "Abc abd"
    codes = [" ", *"abc", " ", *"abd", " "]
    v = {c: language.letter_vectors(np.array([ord(c)], np.uint32))[0].astype(int) for c in set(codes)}
    want = sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))
    got, has = language.text_vectors([text, "", "12"])
    assert (got[0] == want).all() and list(has) == [True, False, False]


# URLs


def test_url_scores(spark):
    weights = url_filter.fit_weights(url_filter.labelled_urls(spark))
    rows = url_filter.labelled_urls(spark).selectExpr("monotonically_increasing_id() as page_id", "concat('http://', host, path) as url", "bad")
    got = {r.page_id: r.score for r in url_filter.filter_urls(rows, {}, weights).collect()}
    assert sum((got[r.page_id] >= 0.5) == bool(r.bad) for r in rows.collect()) / len(got) > 0.97
    import xxhash

    r = rows.collect()[0]
    host, path = re.fullmatch(r"http://([^/]*)(.*)", r.url).groups()
    t = f"^{host}${path}$"
    grams = {(xxhash.xxh64_intdigest(t[i : i + n].encode(), 42) - (xxhash.xxh64_intdigest(t[i : i + n].encode(), 42) >> 63 << 64)) % url_filter.BUCKETS for n in url_filter.GRAMS for i in range(len(t) - n + 1)}
    assert got[r.page_id] == pytest.approx(1 / (1 + np.exp(-weights[-1] - sum(weights[g] for g in grams))))


def test_unseen_hosts(spark):
    urls = [("http://www.cheap-casino-pills.example.org/en/1", "block"), ("https://spam-bets.example.com/x", "block"), ("http://city-museum.example.org/en/3", "allow"), ("http://ththering.example.com/es/2", "allow")]
    got = url_filter.filter_urls(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string"), {})
    assert [r.verdict for r in sorted(got.collect())] == [v for _, v in urls]


# SimHash


def plain_fingerprint(text):
    import xxhash

    w = WORD.findall((text or "").translate(LOWER))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def test_components(docs, texts):
    got = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    links = [(i, j) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= 4]
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fps[i]:016x}", c) for i, c in roots(fps, links).items()}


def test_grid_keeps_every_component(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(60)]
    near = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(30)}
    signed = [f - (1 << 64) if f >> 63 else f for f in near]
    got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.link_edges(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    want = [(a, b) for a in near for b in near if a < b and (a ^ b).bit_count() <= 4]
    assert roots(near, got) == roots(near, want) and set(map(frozenset, got)) <= set(map(frozenset, want))
    one = np.array(sorted(near), np.uint64)
    assert roots(near, simhash.cell_edges(one)) == roots(near, want)


# Substrings


def plain_removal(texts):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        out[i] = len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()
    return out


def test_repeats_of_documents(docs, texts):
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_dedup(docs).collect()} == plain_removal(texts)


def test_planted_repeats(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    passages = [rng.choices(vocabulary, k=rng.randint(45, 130)) for _ in range(12)]
    made = {}
    for i in range(250):
        w = []
        for _ in range(rng.randint(0, 5)):
            p, x = rng.choice(passages), rng.random()
            a = rng.randint(0, len(p) // 2)
            w += p[a : rng.randint(a, len(p))] if x < 0.5 else ["x"] * rng.randint(1, 80) if x < 0.65 else rng.choices(vocabulary, k=rng.randint(1, 60))
        made[i * 7 % 307] = " ".join(w)
    got = substrings.substring_dedup(spark.createDataFrame(list(made.items()), "doc_id long, text string"))
    want = plain_removal(made)
    assert sum(0 < v[1] < v[0] for v in want.values()) > 50
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == want


@given(st.lists(st.integers(0, 6), max_size=60), st.integers(1, 9))
def test_minimizers(values, width):
    h = np.array(values, np.uint64)
    want = sorted({max(range(i, i + width), key=lambda k: (-values[k], k)) for i in range(len(values) - width + 1)})
    assert substrings.minimizers(h, width).tolist() == want


# Decontamination


def test_contamination(spark, docs, texts):
    items_df = spark.read.parquet(f"{SF}/benchmark.parquet")
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for r in items_df.collect():
        w = words.findall((r.text or "").translate(LOWER))
        for k in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(r.item_id))
    want = {}
    for i, t in texts.items():
        w, hit, own = words.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    own |= found
        want[i] = len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)
    assert any(v[4] for v in want.values())
    assert {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(docs, items_df).collect()} == want


# Sharding


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=60), st.integers(1, 6))
def test_smallest_capacity(spark, sizes, shards):
    class Sums(sharding.PrefixSums):
        def __init__(self):
            self.all = []
            at = 0
            for s in sizes:
                at += s + 1
                self.all.append(at)
            # Blocks of up to five groups, refined one by one.
            self.ends = [b[-1] for b in self._blocks()]
            self.counts = [len(b) for b in self._blocks()]
            self.names = list(range(len(self.ends)))

        def _blocks(self):
            return [self.all[i : i + 5] for i in range(0, len(self.all), 5)]

        def refine(self, names):
            for name in names:
                i = self.names.index(name)
                b = self._blocks()[name]
                self.ends[i : i + 1], self.counts[i : i + 1], self.names[i : i + 1] = b, [1] * len(b), [f"{name}.{k}" for k in range(len(b))]

    def greedy(capacity):
        n, held = 1, 0
        for s in sizes:
            if held + s + 1 > capacity:
                n, held = n + 1, 0
            held += s + 1
        return n

    want = min(c for c in range(max(sizes) + 1, sum(sizes) + len(sizes) + 1) if greedy(c) <= shards)
    capacity, cuts = sharding.smallest_capacity(Sums(), shards, sum(sizes) + len(sizes), max(sizes) + 1)
    assert capacity == want and cuts[-1] == sum(sizes) + len(sizes) and max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) <= capacity


def test_shards(docs, texts):
    got = {r.doc_id: r for r in sharding.shard_documents(docs).collect()}
    assert all(r.text_crc32 == zlib.crc32((texts[i] or "").encode()) and r.size == len((texts[i] or "").encode()) + 1 for i, r in got.items())
    by_text = {}
    for i, r in got.items():
        by_text.setdefault(texts[i], set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    # The order of the groups is that of the MD5 of their texts; the largest shard is as small as it can be.
    sizes = {}
    for i, r in got.items():
        key = hashlib.md5((texts[i] or "").encode()).hexdigest()
        sizes[key] = sizes.get(key, 0) + r.size
    ordered = [sizes[k] for k in sorted(sizes)]

    def greedy(capacity):
        n, held = 1, 0
        for s in ordered:
            if held + s > capacity:
                n, held = n + 1, 0
            held += s
        return n

    low, high = max(ordered), sum(ordered)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(mid) <= 16 else (mid + 1, high)
    load = {}
    for r in got.values():
        load[r.shard] = load.get(r.shard, 0) + r.size
    assert max(load.values()) <= low and greedy(max(load.values())) <= 16


# Token planes


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from(["bit", "byte"]))
def test_planes_round_trip(ids, kind):
    a = np.array(ids, np.uint32)
    assert (token_planes.from_planes(token_planes.to_planes(a, kind), len(a), kind) == a).all()


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_file_round_trip(kind, monkeypatch):
    monkeypatch.setattr(token_planes, "BLOCK", 64)
    rng = np.random.default_rng(1)
    docs = [(i if i % 7 else None, rng.integers(0, 50_000, int(n)).astype(np.uint32)) for i, n in enumerate(rng.integers(0, 200, 30))]

    class Kept(io.BytesIO):
        def close(self):
            self.data = self.getvalue()

    out = Kept()
    w = token_planes.PlaneWriter(out, kind)
    for i, ids in docs:
        w.add(i, ids)
    w.close()
    back = list(token_planes.PlaneReader(io.BytesIO(out.data), len(out.data)).documents())
    assert [(i, a.tolist()) for i, a in back] == [(i, a.tolist()) for i, a in docs]
    with pytest.raises(ValueError):
        token_planes.PlaneReader(io.BytesIO(out.data[:-3]), len(out.data) - 3)


def test_ids(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_planes.default_path())
    got, at = {r.doc_id: r for r in token_planes.token_planes(docs, real=True).collect()}, 0
    for i in sorted(texts):
        ids = [*t.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids, got[i].ids_crc32) == (at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


ODD = st.text(st.sampled_from("abeszqx'.,!_09²½ªºÀÉßñŁıİΣς\u0301 \n\t\u0085\u00a0\u00ad\x7f\x1c€日😀#$<|>\ufb01"), max_size=12)


@settings(deadline=None, max_examples=300)
@given(ODD, st.sampled_from(["", "<|endoftext|>", " <|startoftext|> "]), ODD)
def test_fragments(a, special, b):
    from tokenizers import Tokenizer

    text = a + special + b
    e = token_planes.encoder(token_planes.default_path())
    t = e.tokenizer
    assert e.text(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    own = bpe.encoder(bpe.default_path())
    library = Tokenizer.from_file(bpe.default_path()) if not hasattr(test_fragments, "t") else test_fragments.t
    test_fragments.t = library
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.text(text) == (" ".join(map(str, ids)).encode(), library.decode(ids, skip_special_tokens=False).encode())


# Quality


def test_measures(docs, texts):
    for r in quality.measures(docs).collect():
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        again = {x for x in windows if windows.count(x) > 1} if len(set(windows)) < len(windows) else set()
        covered = {i + k for i, x in enumerate(windows) if x in again for k in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))


@pytest.mark.parametrize(("x", "n", "delta"), [(0, 100, 0.05), (3, 200, 0.001), (50, 1000, 0.01)])
def test_upper_bound_is_exact(x, n, delta):
    from math import comb

    p = quality.upper_bound(x, n, delta)
    assert sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1)) == pytest.approx(delta, rel=1e-6)


def test_cutoffs_keep_their_promise(spark):
    rng = random.Random(4)
    rows = [(i, "a" if i % 5 else "few", 100, 500, int(rng.expovariate(1 / 20) * (1 + 5 * (i % 8 == 0))), rng.randint(0, 3), 0, False) for i in range(12_000)]
    measured = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    labels = spark.createDataFrame([(i, int(i % 8 > 0)) for i in range(12_000) if i % 5 or i < 100], "doc_id long, quality int")
    cutoffs = quality.fit_cutoffs(measured, labels)
    assert set(cutoffs) == {"a"} and set(cutoffs["a"]) == {"symbols_pm"}
    kept = quality.judge(measured, cutoffs)
    good, bad = (kept.where(f"stratum = 'a' and doc_id % 8 {c} 0") for c in (">", "="))
    assert good.where("not kept").count() <= 0.02 * good.count() and bad.where("not kept").count() > 0.1 * bad.count()
    assert kept.where("stratum = 'few' and not kept").count() == 0
