"""Damaged archives of several megabytes, mixed archives, and lengths that lie."""

from __future__ import annotations

import hashlib
import io
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canopy.llm import warc


def plain(data):
    return data


def record(i, size):
    body = random.Random(i).randbytes(size)
    return warc.page_record(i, f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), None)


def found(data):
    out = list(warc.salvage(io.BytesIO(data)))
    records = [x for x in out if isinstance(x, warc.Record)]
    gaps = [x for x in out if isinstance(x, warc.Gap)]
    assert all(0 <= g.start < g.end <= len(data) and g.reason for g in gaps)
    # Records and gaps lie in the order of the archive.
    places = [x.offset if isinstance(x, warc.Record) else x.start for x in out]
    assert places == sorted(places)
    return [warc.page_of(x.headers["WARC-Record-ID"]) for x in records], gaps


LARGE = {pack: [pack(record(i, 700_000 if i % 3 else 2_000)) for i in range(8)] for pack in (warc.member, plain)}


@pytest.mark.parametrize("pack", LARGE, ids=["packed", "plain"])
@settings(max_examples=40, deadline=None)
@given(victim=st.integers(0, 7), share=st.floats(0, 1), junk=st.binary(min_size=1, max_size=64) | st.sampled_from([warc.MAGIC, warc.MARK, warc.VERSION + b"\r\n"]), insert=st.booleans())
def test_large_archives(pack, victim, share, junk, insert):
    parts = list(LARGE[pack])
    hit, at = parts[victim], int(share * (len(parts[victim]) - 1))
    parts[victim] = hit[:at] + junk + hit[at + (0 if insert else len(junk)) :]
    # A plain record's headers have no checksum: that of the victim may come back with another id.
    ids, _ = found(b"".join(parts))
    assert set(range(8)) - set(ids) <= {victim, victim + 1} and len(ids) <= 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=14), st.integers(0, 400), st.binary(min_size=1, max_size=30))
def test_mixed_archives(packed, at, junk):
    parts = [(warc.member if p else plain)(record(i, 300)) for i, p in enumerate(packed)]
    assert found(b"".join(parts)) == (list(range(len(parts))), [])
    hit = parts[0]
    at = min(at, len(hit) - 1)
    ids, _ = found(hit[:at] + junk + hit[at + len(junk) :] + b"".join(parts[1:]))
    assert set(range(2, len(parts))) <= set(ids)


@pytest.mark.parametrize("length", ["1997952647", "9" * 19, "9" * 30, "9" * 5000, "-5", "", "٣", "0" * 18 + "1"])
@pytest.mark.parametrize("pack", [warc.member, plain], ids=["packed", "plain"])
def test_lengths_that_lie(pack, length):
    parts = [record(i, 900_000) for i in range(9)]
    parts[2] = re.sub(rb"(?<=\r\nContent-Length: )\d+(?=\r\n\r\nHTTP)", length.encode(), parts[2])
    ids, gaps = found(b"".join(map(pack, parts)))
    assert ids == [0, 1, 3, 4, 5, 6, 7, 8] and len(gaps) == 1


def test_a_lying_length_reads_in_pieces():
    asked = []

    class Stream(io.BytesIO):
        def read(self, n=-1):
            asked.append(n)
            return super().read(n)

    parts = [record(i, 1000) for i in range(3)]
    parts[0] = parts[0].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    list(warc.salvage(Stream(b"".join(parts))))
    assert set(asked) == {warc.READ}


def test_a_member_that_swells_is_no_record():
    data = warc.member(warc.VERSION + b"\r\n" + b"x: " + b"a" * (3 * warc.LONGEST_HEAD) + b"\r\n\r\n") + warc.member(record(1, 10))
    ids, gaps = found(data)
    assert ids == [1] and "headers" in gaps[0].reason


def test_many_records_cost_no_copies():
    data = record(0, 100) * 20_000
    import time

    start = time.process_time()
    assert len(found(data)[0]) == 20_000
    assert time.process_time() - start < 5


def test_random_bytes():
    rng = random.Random(3)
    for _ in range(200):
        data = b"".join(rng.choice([warc.MAGIC, warc.MARK, b"1.1\r\n", b"\r\n\r\n", rng.randbytes(9), b"Content-Length: 7\r\n", b"WARC-Type: x\r\nWARC-Record-ID: y\r\n"]) for _ in range(rng.randint(0, 60)))
        found(data)


@pytest.mark.parametrize("small", [0, warc.SMALL_MB])
def test_very_common_payloads(spark, monkeypatch, small):
    """The same records, whether the table of repeated payloads is broadcast or joined by a shuffle but for its hot keys."""
    monkeypatch.setattr(warc, "SMALL_MB", small)
    html = ["<p>common</p>" * 20] * 400 + ["<p>twice</p>" * 20] * 2 + ["short"] * 5 + [None] * 3 + [f"<p>{i}</p>" * 30 for i in range(20)]
    pages = spark.createDataFrame([(i * 7 % 1009, f"http://x/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    first = {}
    for i, h in enumerate(html):
        if h and len(h) >= 100:
            first[h] = min(first.get(h, 10**9), i * 7 % 1009)
    want = {}
    for i, h in enumerate(html):
        page, body = i * 7 % 1009, (h or "").encode()
        refers = first[h] if h in first and first[h] != page else None
        want[page] = len(body), hashlib.sha256(body).hexdigest(), "response" if refers is None else "revisit", refers
    assert {r.page_id: tuple(r)[1:] for r in warc.archive(pages).collect()} == want
