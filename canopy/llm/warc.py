"""WARC archives: a writer, and a reader that salvages what damage leaves.

Each record is a gzip member of its own, as is usual. The reader checks every
record: the member must inflate and its CRC hold, the version line and headers
must parse, and Content-Length and the block digest must fit. Where a check
fails, it looks for the next place from which a whole record can be read (a gzip
magic that inflates to a version line, or a version line itself, whichever comes
first), goes on from there, and reports the bytes passed over as a gap.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import Scratch, join_labels, open_fs, table

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
MARK = b"WARC/"
VERSION_LINE = re.compile(rb"WARC/\d+\.\d+(?=\r\n|$)")
CONTROL = re.compile(rb"[\x00-\x08\x0a-\x1f\x7f]")
EITHER = re.compile(re.escape(MAGIC) + b"|" + MARK)
LONGEST_HEAD = 1 << 20  # bytes of a record's headers; a damaged archive may claim any
LONGEST_BLOCK = 1 << 30  # bytes of a record's block, which is held in memory
LEAST_SHARED = 100  # bytes from which equal payloads are written once
SMALL_MB = 8  # a table of repeated payloads up to this size is broadcast
FILE_BYTES = 256 << 20
READ = 1 << 20
DATE = "2020-01-01T00:00:00Z"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int = 0

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2] if self.block.startswith(b"HTTP/") else self.block

    def http_header(self, name: str) -> str | None:
        head = self.block.partition(b"\r\n\r\n")[0].decode("latin-1")
        m = re.search(rf"(?im)^{re.escape(name)}:[ \t]*(.*?)\r?$", head)
        return m[1] if m else None


@dataclass
class Gap:
    """Bytes from start to end that were passed over, and the check that failed at their start."""

    start: int
    end: int
    reason: str


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    headers = headers | {"WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(), "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Broken(Exception):
    pass


class Window:
    """Reads a stream forwards. What is passed is dropped when more is read, so a record costs no copy of what follows it."""

    def __init__(self, stream):
        self.stream, self.data, self.here, self.passed, self.ended = stream, bytearray(), 0, 0, False

    @property
    def at(self) -> int:
        """Offset of the current place in the stream."""
        return self.passed + self.here

    @property
    def left(self) -> int:
        return len(self.data) - self.here

    def fill(self, n: int) -> bool:
        """Whether n bytes are at hand from the current place. Reads in pieces, whatever n claims."""
        if self.left < n and not self.ended:
            del self.data[: self.here]
            self.passed, self.here = self.passed + self.here, 0
            while len(self.data) < n and not self.ended:
                more = self.stream.read(READ)
                self.ended = not more
                self.data += more
        return self.left >= n

    def starts(self, mark: bytes) -> bool:
        return self.fill(len(mark)) and self.data.startswith(mark, self.here)

    def take(self, n: int) -> bytes:
        return bytes(self.data[self.here : self.here + n])


def parse_headers(head: bytes) -> tuple[dict[str, str], int]:
    """Headers and Content-Length of what stands before the empty line. Broken if a check fails."""
    version, *lines = head.split(b"\r\n")
    if not VERSION_LINE.fullmatch(version):
        raise Broken("no version line")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or CONTROL.search(line):
            raise Broken("bad header line")
        headers[name.strip().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if "WARC-Record-ID" not in headers or "WARC-Type" not in headers:
        raise Broken("a required header is missing")
    length = headers.get("Content-Length", "")
    if not (length.isascii() and length.isdigit()) or len(length) > 18:
        raise Broken("bad Content-Length")
    if int(length) > LONGEST_BLOCK:
        raise Broken("block longer than the bound")
    return headers, int(length)


def checked(headers: dict[str, str], block: bytes, end: bytes, offset: int) -> Record:
    if end != b"\r\n\r\n":
        raise Broken("no end of record after the block")
    digest = headers.get("WARC-Block-Digest", "")
    if digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        raise Broken("block digest differs")
    return Record(headers, block, offset)


def _member(w: Window) -> tuple[Record, int]:
    """The record of the gzip member at the window's place, and the member's length."""
    z, out, used, step = zlib.decompressobj(31), bytearray(), 0, 1 << 14
    while not z.eof:
        if not w.fill(used + 1):
            raise Broken("member cut short")
        piece = bytes(w.data[w.here + used : w.here + used + step])
        used += len(piece)
        while piece and not z.eof:
            try:
                out += z.decompress(piece, READ)
            except zlib.error as e:
                raise Broken(f"gzip: {e}") from None
            piece = z.unconsumed_tail
            if not MARK.startswith(out[: len(MARK)]) or len(out) > LONGEST_HEAD + LONGEST_BLOCK:
                raise Broken("member is no record")
        step = min(2 * step, READ)
    head = out.find(b"\r\n\r\n", 0, LONGEST_HEAD)
    if head < 0:
        raise Broken("headers without end")
    headers, length = parse_headers(bytes(out[:head]))
    start, end = head + 4, head + 4 + length
    if len(out) != end + 4:
        raise Broken("block cut short" if len(out) < end + 4 else "no end of record after the block")
    return checked(headers, bytes(out[start:end]), bytes(out[end:]), w.at), used - len(z.unused_data)


def _plain(w: Window) -> tuple[Record, int]:
    """The record whose version line stands at the window's place, and its length."""
    w.fill(len(VERSION) + 2)
    if not VERSION_LINE.match(w.take(2 * len(VERSION))):
        raise Broken("no version line")
    while (head := w.data.find(b"\r\n\r\n", w.here, w.here + LONGEST_HEAD)) < 0:
        if w.left >= LONGEST_HEAD or not w.fill(w.left + 1):
            raise Broken("headers without end")
    head -= w.here
    headers, length = parse_headers(w.take(head))
    if not w.fill(head + length + 8):
        raise Broken("block cut short")
    start, end = w.here + head + 4, w.here + head + 4 + length
    return checked(headers, bytes(w.data[start:end]), bytes(w.data[end : end + 4]), w.at), head + length + 8


def _record(w: Window) -> tuple[Record, int]:
    """The record at the window's place, packed or plain as its first bytes say."""
    if w.starts(MAGIC):
        return _member(w)
    if w.starts(MARK):
        return _plain(w)
    raise Broken("neither gzip member nor version line")


def _next(w: Window) -> None:
    """Goes to the nearest gzip magic or version line, or to the end."""
    keep = max(len(MAGIC), len(MARK)) - 1
    while w.fill(1):
        found = EITHER.search(w.data, w.here)
        if found or w.ended:
            w.here = found.start() if found else len(w.data)
            return
        w.here = max(w.here, len(w.data) - keep)
        w.fill(keep + 1)


def salvage(stream) -> Iterator[Record | Gap]:
    """Records of an archive in order, and the gaps between them where checks failed.

    After a failed check the nearest gzip magic or version line is tried by the
    reader that it calls for, so packed and plain records may stand in one archive
    and no damage decides how the rest is read. A record that stands whole inside
    a damaged one (an archive within an archive) is recovered too. Nothing is
    raised but what the stream itself raises. Records with headers above
    LONGEST_HEAD or blocks above LONGEST_BLOCK bytes are taken for damage."""
    w = Window(stream)
    gap = None
    while w.fill(1):
        try:
            record, n = _record(w)
        except Broken as e:
            gap = gap or Gap(w.at, w.at, str(e))
            w.here += 1
            _next(w)
            continue
        if gap:
            yield Gap(gap.start, w.at, gap.reason)
            gap = None
        w.here += n
        yield record
    if gap:
        yield Gap(gap.start, w.at, gap.reason)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record_id: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(m[1]) if m else None


def page_record(page_id, url, payload: bytes, digest: str, first) -> bytes:
    """A response, or a revisit of page `first`; either has the HTTP headers of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    headers = {"WARC-Type": "response" if first is None else "revisit", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE, "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response"}
    if first is not None:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(first)}
    return record_bytes(headers, http + (payload if first is None else b""))


def write_warc(pages: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) into archives below folder.

    Gives the manifest: path, n_records and n_bytes of each archive. Only digests
    are shuffled, never payloads, unless the table of repeated payloads is too
    large to broadcast. Files of failed attempts are not in the manifest."""
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n"))
    seen = rows.where(f"n >= {LEAST_SHARED} and page_id is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    repeated = scratch.keep("repeated", seen.where("copies > 1").select("digest", "first", F.col("copies").alias("n")))
    if repeated.count() * 100 <= SMALL_MB << 20:
        rows = rows.drop("n").join(F.broadcast(repeated), "digest", "left")
    else:
        rows = join_labels(rows.drop("n"), repeated, "digest", how="left")
    rows = rows.select("page_id", "url", "html", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("first"))

    def run(batches):
        part, out, n, size, path = TaskContext.get().partitionId(), None, 0, 0, ""
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, n, size = f"{folder}/{part:06d}-{uuid.uuid4().hex[:12]}.warc.gz", 0, 0
                    out = fs.open_output_stream(open_fs(path)[1], compression=None)
                data = member(page_record(page_id, url, (html or "").encode(), digest, first))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    yield _manifest(path, n, size)
        if out is not None:
            out.close()
            yield _manifest(path, n, size)

    return rows.mapInArrow(run, "path string, n_records long, n_bytes long")


def _manifest(path: str, n: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([size], pa.int64())})


SCHEMA = "path string, offset long, gap_end long, gap_reason string, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary"


def read_warc(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives in files (path), a task an archive.

    A gap has gap_end and gap_reason, and its start as offset; a record has the
    rest. payload_digest and payload_bytes of a response are computed from its
    payload, those of a revisit are of the payload it refers to, as its headers
    say. `clean` and `gaps` take the two apart."""
    files = files.select("path")
    files = files.repartition(max(1, files.count()))

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, p = open_fs(path)
                with fs.open_input_stream(p, compression=None) as stream:
                    held, size = [], 0
                    for x in salvage(stream):
                        held.append(_row(path, x, with_payload))
                        size += 200 + len(held[-1][-1] or b"")
                        if size > 4 << 20:
                            yield _rows(held)
                            held, size = [], 0
                    if held:
                        yield _rows(held)

    return files.mapInArrow(run, SCHEMA)


def _row(path: str, x: Record | Gap, with_payload: bool) -> tuple:
    if isinstance(x, Gap):
        return (path, x.start, x.end, x.reason, *[None] * 7)
    h, kind, payload = x.headers, x.headers.get("WARC-Type"), x.payload
    digest, n = hashlib.sha256(payload).hexdigest(), len(payload)
    if kind == "revisit":
        digest, n = h.get("WARC-Payload-Digest", "").removeprefix("sha256:"), x.http_header("Content-Length") or ""
        n = int(n) if n.isdigit() else None
    return path, x.offset, None, None, kind, h.get("WARC-Record-ID"), h.get("WARC-Refers-To"), h.get("WARC-Target-URI"), digest, n, payload if with_payload else None


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names = [f.split() for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], kinds[k]) for i, (_, k) in enumerate(names)], names=[n for n, _ in names])


def clean(read: DataFrame) -> DataFrame:
    return read.where("gap_end is null").drop("gap_end", "gap_reason")


def gaps(read: DataFrame) -> DataFrame:
    """The quarantine log: path, start, end and reason of the bytes passed over."""
    return read.where("gap_end is not null").select("path", F.col("offset").alias("start"), F.col("gap_end").alias("end"), F.col("gap_reason").alias("reason"))


def page_id(column: str) -> F.Column:
    return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def archive(pages: DataFrame) -> DataFrame:
    """Writes pages as archives, reads them back, and gives a row for each record.

    page_id, payload_bytes, payload_digest, record_type and refers_to. Of equal
    payloads of LEAST_SHARED bytes or more the smallest page_id is the response
    (all its rows, if that id is repeated), others revisit it. A null html is an
    empty payload; a null page_id stays null, is always a response and is never
    referred to. An empty table gives no rows; other columns are ignored."""
    scratch = Scratch(pages.sparkSession, "warc")
    files = scratch.keep("manifest", write_warc(pages, scratch.sub("archives"), scratch))
    read = clean(read_warc(files, with_payload=False))
    return read.select(page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id("refers_to").alias("refers_to"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))


OP1_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
q as (select *, min(page_id) over (partition by d) as first from p)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
  case when n >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id > first then first end as refers_to
from q
"""
