"""Archives whose start is damaged: what follows is found in either format."""

from __future__ import annotations

import hashlib
import io
import random

import pytest

from canopy.llm import warc


def parts_of(pack, first=3 << 19):
    bodies = [random.Random(0).randbytes(first), *(b"<p>%d</p>" % i * 20 for i in range(1, 5))]
    return [pack(warc.page_record(i, f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), None)) for i, body in enumerate(bodies)]


def found(data):
    """Page ids of the records, and (start, end) of the gaps."""
    out = list(warc.salvage(io.BytesIO(data)))
    return [warc.page_of(x.headers["WARC-Record-ID"]) for x in out if isinstance(x, warc.Record)], [(x.start, x.end) for x in out if isinstance(x, warc.Gap)]


@pytest.mark.parametrize("pack", [warc.member, lambda x: x], ids=["packed", "plain"])
@pytest.mark.parametrize("junk", [bytes(warc.READ + 9), b"\0", b"WARC/", warc.MAGIC + b"WARC/1.1\r\n"], ids=["zeros", "one byte", "version line", "both"])
def test_damaged_start_costs_one_record(pack, junk):
    first, *rest = parts_of(pack)
    assert len(first) > warc.READ
    assert found(junk + first[len(junk) :] + b"".join(rest)) in (([1, 2, 3, 4], [(0, len(first))]), ([0, 1, 2, 3, 4], []))


def test_members_inside_a_damaged_plain_record_do_not_decide():
    inner = b"".join(parts_of(warc.member, 10))
    first = warc.page_record(9, "http://x/9", inner, hashlib.sha256(inner).hexdigest(), None)
    rest = parts_of(lambda x: x, 10)
    ids, _ = found(b"\0" + first[1:] + b"".join(rest))
    assert ids[-5:] == [0, 1, 2, 3, 4]
    assert found(first + b"".join(rest)) == ([9, 0, 1, 2, 3, 4], [])
