"""Whole results of queries without SQL against plain Python."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from test_brute_force import LOWER, SF, WORD, plain_removal, roots

from canopy.llm import bpe, language, quality, queries, url_filter

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


# op2


@needs_data
def test_op2(spark):
    docs = rows(spark, "documents")
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in docs}
    vectors, has = language.text_vectors([r.text or "" for r in docs])
    vectors = vectors.astype(float) / np.maximum(np.linalg.norm(vectors.astype(float), axis=1, keepdims=True), 1e-12)
    names = sorted({r.lang for r in docs if r.lang is not None and not held[r.doc_id]})
    raw = np.array([sum(v for v, h, r in zip(vectors, has, docs, strict=True) if h and r.lang == n and not held[r.doc_id]) for n in names])
    raw /= np.linalg.norm(raw, axis=1, keepdims=True)
    centred = raw - raw.mean(axis=0)
    centred /= np.linalg.norm(centred, axis=1, keepdims=True)
    want = {}
    for v, h, r in zip(vectors, has, docs, strict=True):
        best = int(np.argmax(centred @ v))
        want[r.doc_id] = (held[r.doc_id], names[best], float(raw[best] @ v)) if h else (held[r.doc_id], "und", 0.0)
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in queries.op2_language(spark, SF).collect()}
    assert {i: x[:2] for i, x in got.items()} == {i: x[:2] for i, x in want.items()}
    assert all(got[i][2] == pytest.approx(want[i][2], abs=1e-5) for i in want)


# op3


def plain_weights(labelled):
    """The same descent in plain Python; `labelled`: (host, path, bad)."""
    import xxhash

    def xx(text, seed):
        return xxhash.xxh64_intdigest(text.encode(), seed)

    def buckets(host, path):
        t = f"^{host}${path}$"
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        return sorted({signed(xx(t[i : i + n], 42)) % url_filter.BUCKETS for n in url_filter.GRAMS for i in range(max(1, len(t) - n + 1))})

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    ordered = sorted(labelled, key=lambda r: (signed(xx(r[1], xx(r[0], 42))), r[2]))
    w = np.zeros(url_filter.BUCKETS + 1)
    for _ in range(url_filter.EPOCHS):
        for host, path, bad in ordered:
            on = [*buckets(host, path), url_filter.BUCKETS]
            g = url_filter.RATE * (bad - 1 / (1 + math.exp(-w[on].sum())))
            w *= 1 - url_filter.DECAY
            w[on] += g
    return w, buckets


@needs_data
def test_op3(spark):
    w, buckets = plain_weights([(r.host, r.path, r.bad) for r in url_filter.labelled_urls(spark).collect()])
    near_half = 0
    got = {r.page_id: r for r in queries.op3_url_filter(spark, SF).collect()}
    pages = rows(spark, "pages")
    assert len(got) == len(pages)
    for r in pages:
        _, scheme, rest = (r.url or "").partition("://")
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups() if scheme else ("", "")
        host = host.translate(LOWER)
        fits = []
        for rule in url_filter.RULES:
            h, slash, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
                fits.append(rule)
        rule = max(fits, key=len, default=None)
        score = 1 / (1 + math.exp(-w[[*buckets(host, path), -1]].sum()))
        assert got[r.page_id].score == pytest.approx(score, abs=1e-6)
        near_half += abs(score - 0.5) < 1e-6
        verdict = url_filter.RULES[rule] if rule else "block" if score >= 0.5 else "allow"
        assert (got[r.page_id].host, got[r.page_id].path, got[r.page_id].rule) == (host, path, rule)
        assert got[r.page_id].verdict == verdict or abs(score - 0.5) < 1e-6
    assert near_half == 0


@needs_data
def test_no_labelled_host_is_of_the_tables(spark):
    own = {*url_filter.GOOD_NAMES, *url_filter.BAD_NAMES}
    assert len(own) == len(url_filter.GOOD_NAMES) + len(url_filter.BAD_NAMES) < 200
    names = {n.partition(".")[0] for n in own}
    for r in rows(spark, "pages"):
        host = re.sub(r"^(www|m|blog)\.", "", re.sub(r"^.*?://([^/?#]*).*", r"\1", r.url or ""))
        assert host not in own and host.partition(".")[0] not in names


def test_hosts_that_the_model_has_not_seen(spark):
    """Each fourth of the names is judged by a model of the other three."""
    every = [(r.host, r.path, r.bad) for r in url_filter.labelled_urls(spark).collect()]
    name = lambda host: re.sub(r"^(www|m|blog)\.", "", host)
    right = {0: 0, 1: 0}
    for fold in range(4):
        mine = [r for r in every if zlib.crc32(name(r[0]).encode()) % 4 == fold]
        w, buckets = plain_weights([r for r in every if r not in mine])
        for host, path, bad in mine:
            right[bad] += (w[[*buckets(host, path), -1]].sum() >= 0) == bool(bad)
    n_bad = sum(r[2] for r in every)
    assert right[0] / (len(every) - n_bad) > 0.9 and right[1] / n_bad > 0.7


# op9


def plain_upper(x, n, delta):
    """The largest share at which x or fewer of n have a chance above delta, by the binomial sum itself."""
    if x >= n:
        return 1.0
    low, high = x / n, 1.0
    for _ in range(50):
        p = (low + high) / 2
        chance = sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(x + 1))
        low, high = (p, high) if chance > delta else (low, p)
    return high


def plain_verdicts(measured, labels, risk, delta):
    told = {}
    for i, q in labels:
        if i is not None and q is not None:
            told[i] = min(q, told.get(i, q))

    def pm(r):
        share = lambda a, b: 1000 * a // b if b else 0
        return {"symbols_pm": share(r["n_symbols"], r["word_chars"]), "repeats_pm": share(r["n_repeat_words"], r["n_words"]), "dup_lines_pm": share(r["n_dup_lines"], r["n_words"]), "word_chars_pm": share(r["word_chars"], r["n_words"])}

    held = {}
    for r in measured:
        if not r["base_failed"] and r["doc_id"] in told:
            one = held.setdefault((r["stratum"], r["doc_id"]), dict.fromkeys(quality.MEASURES, 0))
            for k, v in pm(r).items():
                one[k] = max(one[k], v)
    strata = {s for s, _ in held}
    chosen = {}
    for s in strata:
        good = [m for (t, i), m in held.items() if t == s and told[i] == 1]
        bad = [m for (t, i), m in held.items() if t == s and told[i] != 1]
        each = delta / len(strata)
        last = None
        for step in range(max(map(len, quality.MEASURES.values()))):
            cut = {k: c[min(step, len(c) - 1)] for k, c in quality.MEASURES.items()}
            if not good or plain_upper(sum(any(m[k] > c for k, c in cut.items()) for m in good), len(good), each) > risk:
                break
            last = cut
        for k, c in (last or {}).items() if bad else ():
            lower = 1 - plain_upper(sum(m[k] <= c for m in bad), len(bad), each)
            if lower > plain_upper(sum(m[k] > c for m in good), len(good), each):
                chosen.setdefault(s, {})[k] = c
    return chosen, [not r["base_failed"] and not any(pm(r)[k] > c for k, c in chosen.get(r["stratum"], {}).items()) for r in measured]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_op9_verdicts(spark, seed):
    rng = random.Random(seed)
    names = ["doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    made, labels = [], []
    for i in range(1500):
        bad = rng.random() < 0.25
        stratum = rng.choice(["en", "en", "fr", "de", ""])
        words = rng.randint(10, 400)
        doc = (i, stratum, words, words * rng.randint(4, 7), int(rng.expovariate(1 / (words * (0.5 if bad else 0.01)))), rng.randint(0, words // 20) if bad and seed == 2 else 0, 0, words < 20)
        made += [doc] * (3 if rng.random() < 0.05 else 1)
        if rng.random() < 0.8:
            labels.append((i if rng.random() < 0.99 else None, int(not bad)))
    chosen, kept = plain_verdicts([dict(zip(names, r, strict=True)) for r in made], labels, 0.02, 0.05)
    measured = spark.createDataFrame(made, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    cutoffs = quality.fit_cutoffs(measured, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert cutoffs == chosen and chosen
    got = [(tuple(r)[:8], r.kept) for r in quality.judge(measured, cutoffs).collect()]
    assert sorted(got) == sorted(zip(made, kept, strict=True))


def test_220_good_labels_are_enough(spark):
    """With four strata, no good document rejected, and risk 0.02."""
    made = [(1000 * s + i, f"s{s}", 100, 500, 400 if i >= 225 else 0, 0, 0, False) for s in range(4) for i in range(300)]
    measured = spark.createDataFrame(made, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    labels = spark.createDataFrame([(r[0], int(r[4] == 0)) for r in made], "doc_id long, quality int")
    assert set(quality.fit_cutoffs(measured, labels)) == {"s0", "s1", "s2", "s3"}
    few = labels.where("doc_id % 1000 >= 50")
    assert quality.fit_cutoffs(measured, few) == {}


# op10


@needs_data
def test_op10(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    want = {}
    for r in rows(spark, "documents"):
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
    assert {r.doc_id: tuple(r)[1:4] for r in queries.op10_bpe(spark, SF).collect()} == want


# pipeline


@needs_data
def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    import xxhash
    from tokenizers import Tokenizer

    width = pipeline.WIDTH

    def fingerprint(text):
        w = WORD.findall(text.translate(LOWER))
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))] if w else []
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))

    docs = {r.doc_id: r.text for r in rows(spark, "documents") if r.text and any(c.isalpha() for c in r.text)}
    fps = {i: fingerprint(t) for i, t in docs.items()}
    component = roots(fps, [(i, j) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= 4])
    docs = {i: t for i, t in docs.items() if component[i] == i}
    removed = plain_removal(docs)
    first = {}
    for i in sorted(docs):
        w = docs[i].encode().split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    cut = {}
    for i, t in docs.items():
        w = t.encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        assert sum(gone) == removed[i][1]
        cut[i] = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode() if any(gone) else t
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in rows(spark, "benchmark"):
        w = words.findall((r.text or "").translate(LOWER))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    clean = {}
    for i, t in cut.items():
        w = words.findall(t.translate(LOWER))
        if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)):
            clean[i] = t
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    want = {}
    for i, text in clean.items():
        ids = t.encode(text, add_special_tokens=False).ids
        want[i] = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in pipeline.run(spark, SF).collect()} == want
