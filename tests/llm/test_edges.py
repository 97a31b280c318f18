"""Null, empty, long and repeated inputs of every operator and stage."""

from __future__ import annotations

import pytest

from canopy.llm import bpe, decontaminate, language, quality, sharding, simhash, substrings, token_planes, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, shard int, h_id long"
LONG = " ".join(f"w{i}" for i in range(30_000))
SAME = " ".join(f"same{i % 61}" for i in range(200))
ROWS = [
    (1, SAME, "en"), (2, SAME, "en"), (2, SAME, "en"), (3, None, None), (4, "", "en"), (5, " \n\t ", "de"), (6, LONG, "en"),
    (7, LONG + " end", None), (None, SAME, "fr"), (None, None, None), (8, "x", "fr"), (9, "Ünïcödé 日本 😀 \u00a0 \x1c", "de"), (10, "the a " * 40, "en"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), 0.5, True, 3, 4) for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_warc(spark):
    schema = "page_id long, url string, html string, first long, digest string"
    long = "<p>é</p>" * 50
    rows = [(3, "http://a", long), (2, None, long), (2, None, long), (5, "http://b\r\nX: y", "s"), (6, "", "s"), (7, "u", None), (None, "u", long), (None, None, None)]
    got = {}
    for r in warc.archive(spark.createDataFrame([(*r, 1, "d") for r in rows], schema)).collect():
        got.setdefault(r.page_id, []).append((r.record_type, r.refers_to, r.payload_bytes))
    n = len(long.encode())
    assert got[3] == [("revisit", 2, n)] and got[2] == [("response", None, n)] * 2
    assert got[5] == got[6] == [("response", None, 1)] and got[7] == [("response", None, 0)]
    assert sorted(got[None]) == [("response", None, 0), ("response", None, n)]
    assert warc.archive(spark.createDataFrame([], schema)).count() == 0


def test_language(docs, none):
    got = by_id(language.identify(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert [got[i][0].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and not got[None][0].held_out
    assert all(0 <= r.score <= 1 for rs in got.values() for r in rs)
    assert language.identify(none).count() == 0


def test_language_without_labels(spark):
    assert {r.lang_pred for r in language.identify(frame(spark, [(1, "abc def", None)])).collect()} == {"und"}


def test_urls(spark):
    schema = "page_id long, url string, rule string, host long"
    urls = [None, "", "no scheme", "HTTP://WWW.Example.NET/en/x?q#f", "http://net", "http://net/", "http://notnet/", "http://a.example.com/de/1", "http://b.org/fr/", "http://b.org/fr", "ß://É.ORG/fr/", "x://y://z", "http://h?/fr/"]
    rows = [(i, u, "r", 1) for i, u in enumerate(urls)]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, schema)).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == [
        ("", "", None), ("", "", None), ("", "", None), ("www.example.net", "/en/x", "example.net/en/"), ("net", "", None), ("net", "/", "net/"), ("notnet", "/", None),
        ("a.example.com", "/de/1", "example.com/de/"), ("b.org", "/fr/", "org/fr/"), ("b.org", "/fr", None), ("É.org", "/fr/", "org/fr/"), ("y:", "//z", None), ("h", "", None),
    ]
    assert [got[i].verdict for i in (3, 5, 7, 8)] == ["allow", "block", "block", "allow"] and all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filter.filter_urls(spark.createDataFrame([], schema)).count() == 0


def test_simhash(docs, none):
    got = by_id(simhash.simhash_components(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    zero = {got[i][0].component_id for i in (3, 4, 5)}
    assert got[3][0].fingerprint == "0" * 16 and zero == {3}
    assert {r.component_id for r in got[1] + got[2]} == {1} and {r.component_id for r in got[None]} == {1, 3}
    assert got[6][0].component_id == got[7][0].component_id == 6
    assert simhash.simhash_components(none).count() == 0


def test_substrings(docs, none):
    got = by_id(substrings.substring_dedup(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert [(r.n_words, r.n_removed) for i in (1, 2, 7) for r in got[i]] == [(200, 0), (200, 200), (200, 200), (30_001, 30_000)]
    assert {(r.n_words, r.n_removed) for r in got[None]} == {(200, 0), (0, 0)} and got[3][0].kept_sha256 == substrings.EMPTY_SHA
    assert substrings.substring_dedup(none).count() == 0
    texts = {r.doc_id: (r.text, r.n_chars) for r in substrings.remove_repeats(docs).collect() if r.doc_id is not None}
    assert texts[7] == ("end", 3) and texts[2] == ("", 0) and texts[9][0] == ROWS[11][1] and substrings.remove_repeats(none).count() == 0


def test_decontamination(spark, docs, none):
    schema = "item_id long, text string, n long"
    items = spark.createDataFrame([(1, "SAME0 same1, same2!", 1), (1, "same0 same1 same2", 1), (10, "", 1), (2, None, 1), (None, "x", 1), (3, " ".join(f"w{i}" for i in range(15)), 1), (4, "not there at all", 1)], schema)
    got = by_id(decontaminate.contamination(docs, items))
    assert sum(map(len, got.values())) == len(ROWS)
    assert {(r.n_hit, r.n_items) for r in got[2]} == {(12, 1)} and (got[6][0].n_hit, got[6][0].n_items) == (15, 1)
    assert (got[8][0].n_hit, got[8][0].n_items) == (1, 1) and not got[4][0].contaminated and got[3][0].n_words == 0
    assert {r.contaminated for r in got[None]} == {True, False}
    assert decontaminate.contamination(none, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, spark.createDataFrame([], schema)).collect())


def test_proximity(spark, docs):
    items = spark.createDataFrame([(1, "w7 w5 w9")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.proximity_matches(docs, items).collect()} == {6, 7}


def test_sharding(docs, none):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(ROWS)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and set(shards) <= set(range(16))
    assert len({r.shard for r in got if r.doc_id in (1, 2)}) == 1 and {r.size for r in got if r.doc_id in (3, 4)} == {1}
    assert sharding.shard_documents(none).count() == 0


def test_planes(docs, none):
    got = sorted(token_planes.token_planes(docs).collect(), key=lambda r: r.start)
    assert len(got) == len(ROWS) and [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert {r.n_tokens for r in got if r.doc_id in (3, 4)} == {1}
    assert token_planes.token_planes(none).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality.quality_rules(docs, labels))
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[3][0].base_failed and not got[3][0].kept and got[6][0].kept and got[1][0].n_repeat_words == 200
    assert quality.quality_rules(none, labels).count() == 0
    assert quality.quality_rules(docs, labels.limit(0)).count() == len(ROWS)


def test_bpe(docs, none):
    got = by_id(bpe.encode_documents(docs, real=True))
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[3][0].n_tokens == got[5][0].n_tokens == 0 and got[3][0].decoded == "" and len(got[6][0].ids) == got[6][0].n_tokens
    assert bpe.encode_documents(none).count() == 0


def test_pipeline_stages(spark, docs, none, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, "no such words in it")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, none):
        kept = start
        for i, (_, stage) in enumerate(pipeline.STAGES):
            kept = stage(spark, kept, str(tmp_path))
            path = str(tmp_path / f"{start is docs}-{i}")
            kept.write.parquet(path)
            kept = spark.read.parquet(path)
            assert i == len(pipeline.STAGES) - 1 or kept.columns == docs.columns
        ids = {r.doc_id for r in kept.collect()}
        assert ids == ({1, 6, 8, 9, 10, None} if start is docs else set())
