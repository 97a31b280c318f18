"""Byte codecs: numbers, escaped strings, bits, and compression by name."""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
import zlib
from collections.abc import Callable

import zstandard

#: The bit pattern of a null number: a NaN that no arithmetic gives.
NULL_FLOAT = 0x7FF0000000000001


def write_varnum(v: int) -> bytes:
    """Seven bits a byte from the low end, shifted up by one; the lowest bit says that more follow."""
    if not 0 <= v < 1 << 32:
        raise ValueError(f"{v} is no unsigned 32-bit number")
    out = bytearray()
    while True:
        v, low = v >> 7, v & 0x7F
        out.append(low << 1 | (v > 0))
        if not v:
            return bytes(out)


def read_varnum(data: bytes, at: int = 0) -> tuple[int | None, int]:
    """(number or None for null, next place); a number written longer than need be is refused."""
    if data[at : at + 2] == b"\x01\x00":
        return None, at + 2
    v, shift, start = 0, 0, at
    while True:
        if at >= len(data):
            raise ValueError("number cut short")
        b = data[at]
        at += 1
        v |= (b >> 1) << shift
        shift += 7
        if not b & 1:
            break
    if b == 0 and at - start > 1:
        raise ValueError("number with needless zeros")
    if v >= 1 << 32:
        raise ValueError("number of more than 32 bits")
    return v, at


def write_maybe_varnum(v: int | None) -> bytes:
    return b"\x01\x00" if v is None else write_varnum(v)


def signed_code(v: int) -> int:
    return 2 * v if v >= 0 else 2 * (1 - v) - 1


def from_signed_code(u: int) -> int:
    return u // 2 if u % 2 == 0 else 1 - (u + 1) // 2


def write_maybe_varfloat(v: float | None) -> bytes:
    """Null in three bytes; whole numbers of 32 bits (not -0.0) as signed numbers; others in two and eight."""
    if v is None:
        return b"\x01\x01\x00"
    if v == v and abs(v) < 1 << 31 and v == int(v) and not (v == 0 and struct.pack("<d", v)[7] & 0x80):
        code = signed_code(int(v))
        if code < 1 << 32:
            return write_varnum(code)
    return b"\x01\x00" + struct.pack("<d", v)


def read_maybe_varfloat(data: bytes, at: int = 0) -> tuple[float | None, int]:
    if data[at : at + 3] == b"\x01\x01\x00":
        return None, at + 3
    if data[at : at + 2] == b"\x01\x00":
        return struct.unpack("<d", data[at + 2 : at + 10])[0], at + 10
    code, at = read_varnum(data, at)
    return float(from_signed_code(code)), at


def bytes_of_float(v: float | None) -> bytes:
    return struct.pack("<Q", NULL_FLOAT) if v is None else struct.pack("<d", v)


def float_of_bytes(b: bytes) -> float | None:
    return None if struct.unpack("<Q", b)[0] == NULL_FLOAT else struct.unpack("<d", b)[0]


def write_varuint(v: int) -> bytes:
    """Seven bits a byte from the low end; the highest bit says that more follow."""
    out = bytearray()
    while v > 0x7F:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def read_varuint(data: bytes, at: int = 0) -> tuple[int, int]:
    v, shift = 0, 0
    while True:
        b = data[at]
        at += 1
        v |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return v, at


class BitWriter:
    """Bits into bytes, the low-order bit of a byte first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def write(self, bits: int, width: int) -> None:
        self.value |= (bits & (1 << width) - 1) << self.n
        self.n += width

    def done(self) -> bytes:
        return self.value.to_bytes(-(-self.n // 8), "little")


class BitReader:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "little"), 8 * len(data)

    def read(self, width: int) -> int:
        if width > self.left:
            raise ValueError("bits cut short")
        out = self.value & (1 << width) - 1
        self.value >>= width
        self.left -= width
        return out


def escape(data: bytes) -> str:
    """WTF-8 to Unicode text: lone surrogates and \\x7F become \\x7F and four hex digits."""
    text = data.decode("utf-8", "surrogatepass")
    return "".join(f"\x7f{ord(c):04X}" if c == "\x7f" or 0xD800 <= ord(c) <= 0xDFFF else c for c in text)


def unescape(text: str) -> bytes:
    parts = text.split("\x7f")
    return parts[0].encode() + b"".join(chr(int(p[:4], 16)).encode("utf-8", "surrogatepass") + p[4:].encode() for p in parts[1:])


def write_strings(strings: list[str]) -> bytes:
    """A count, then NUL-terminated strings in which \\x00 and \\x01 follow a \\x01."""
    body = b"".join(s.encode().replace(b"\x01", b"\x01\x01").replace(b"\x00", b"\x01\x00") + b"\x00" for s in strings)
    return write_varuint(len(strings)) + body


def read_strings(data: bytes, at: int = 0) -> tuple[list[str], int]:
    n, at = read_varuint(data, at)
    out = []
    for _ in range(n):
        own = bytearray()
        while data[at] != 0:
            at += data[at] == 1
            own.append(data[at])
            at += 1
        at += 1
        out.append(own.decode())
    return out, at


def _raw_inflate(b: bytes) -> bytes:
    return zlib.decompress(b, -15)


def _raw_deflate(b: bytes) -> bytes:
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    return z.compress(b) + z.flush()


#: name -> (compress, decompress). Brotli and LZW have no library here and are reported, not replaced.
CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "identity": (lambda b: b, lambda b: b),
    "gzip": (lambda b: gzip.compress(b, mtime=0), gzip.decompress),
    "deflate": (_raw_deflate, _raw_inflate),
    "bz2": (bz2.compress, bz2.decompress),
    "lzma": (lzma.compress, lzma.decompress),
    "zstd": (lambda b: zstandard.ZstdCompressor(level=19).compress(b), lambda b: zstandard.ZstdDecompressor().decompress(b)),
}


def codec(name: str) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    if name not in CODECS:
        raise ValueError(f"codec {name!r} is not available; there are {', '.join(CODECS)}")
    return CODECS[name]


def compress_section(name: str, data: bytes) -> bytes:
    """Method name and NUL, the compressed length, the data."""
    packed = codec(name)[0](data)
    return name.encode() + b"\x00" + write_varuint(len(packed)) + packed


def decompress_section(data: bytes, at: int = 0, longest: int = 32) -> tuple[str, bytes, int]:
    end = data.find(b"\x00", at, at + longest)
    if end < 0:
        raise ValueError("no method name")
    name = data[at:end].decode()
    n, at = read_varuint(data, end + 1)
    if at + n > len(data):
        raise ValueError("section cut short")
    return name, codec(name)[1](data[at : at + n]), at + n
