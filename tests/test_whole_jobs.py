"""Queries that answer for every word of every document, by SQL without subsets.

The SQL here counts and looks up all words; that of the catalogue may still be cut."""

from __future__ import annotations

import os

import pytest
from test_queries import SF, TABLES, plain

import __spark_entry__ as entry
from canopy import catalogue
from canopy.operators import dictionary

duckdb = pytest.importorskip("duckdb")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

SHARED = f"{catalogue.WORDS}, shared as (select value, row_number() over (order by value) - 1 as idx from (select value from words group by value having count(distinct file_id) > {catalogue.THRESHOLD}))"

WHOLE = {
    "dictionary_hits": f"with {SHARED} select w.file_id, w.seq, w.value, s.idx from words w join shared s on s.value = w.value",
    "dictionary_misses": f"with {SHARED}, m as (select file_id, value, min(seq) as first from words where value not in (select value from shared) group by all) "
    "select file_id, value, first, row_number() over (partition by file_id order by first) - 1 as idx from m",
    "prelude_table": f"with {SHARED}, p as (select value, row_number() over (order by value) - 1 as idx from (select distinct value from words where value not in (select value from shared))) "
    "select value, idx, 'shared' as origin from shared union all select value, idx, 'prelude' from p",
    "dictionary_union_fallback": f"with {catalogue.WORDS}, c as (select lang, source, value, count(*) as n from words group by all), b as (select distinct source, value from words), "
    "p as (select k.lang, k.source, b.value from (select distinct lang, source from c) k join b on k.source = b.source) "
    "select lang, source, value, n, 2 as depth from c union all select lang, source, value, 1, 2 from p where not exists (select 1 from c where c.lang is not distinct from p.lang and c.source = p.source and c.value = p.value) "
    "union all select null, source, value, 1, 1 from b",
    "fallback_lookup": f"with {catalogue.WORDS}, d as (select lang, source, value, count(*) as n, sum(count(*)) over (partition by lang, source) as total from words group by lang, source, value) "
    "select w.file_id, w.lang, w.source, w.value, 2 as used_depth, d.n, cast(d.total as bigint) as total from words w join d on d.lang is not distinct from w.lang and d.source is not distinct from w.source and d.value = w.value",
}


@needs_data
@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_job(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, found = entry.queries()[name](spark, SF), con.sql(WHOLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(found.columns)
    order = [found.columns.index(c) for c in cols]
    assert sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect()) == sorted(repr(tuple(plain(r[i]) for i in order)) for r in found.fetchall())


def test_lookup_falls_to_the_shorter_context(spark):
    """Contexts with nulls, a value that only the shorter context has, and repeated tokens."""
    deep = dictionary.with_total(spark.createDataFrame([("a", "s", "v", 1), (None, "s", "v", 2), (None, "s", "w", 3)], "l string, s string, value string, n long"), ["l", "s"])
    shallow = dictionary.with_total(spark.createDataFrame([("s", "v", 3), ("s", "w", 3)], "s string, value string, n long"), ["s"])
    asked = [(1, "a", "s", "v"), (1, "a", "s", "v"), (2, "a", "s", "w"), (3, "b", "s", "w"), (4, None, "s", "w"), (5, "b", "t", "v")]
    got = dictionary.fallback_lookup(spark.createDataFrame(asked, "file_id long, l string, s string, value string"), deep, shallow, ["l", "s"], ["s"], "value")
    want = [(2, 1, 1), (2, 1, 1), (2, None, None), (1, 3, 6), (2, 3, 5), (-1, None, None)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((a + b for a, b in zip(asked, want, strict=True)), key=repr)
