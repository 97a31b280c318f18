"""Lengths and forms of numbers and strings in the byte formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\x7f"  # begins an escape of four hex digits for what is no Unicode text


def varnum_length(v: Column) -> Column:
    """Bytes of an unsigned number, seven bits a byte; null has the two-byte form."""
    n = F.lit(1)
    for k in (7, 14, 21, 28):
        n = n + (v >= 1 << k).cast("int")
    return F.coalesce(n, F.lit(2))


def signed_code(v: Column) -> Column:
    """The unsigned number that stands for a signed one: 2v, or 2(-v + 1) - 1 for negative v."""
    return F.when(v >= 0, 2 * v).otherwise(2 * (1 - v) - 1)


def signed_varnum_length(v: Column) -> Column:
    return varnum_length(signed_code(v))


def is_negative_zero(v: Column) -> Column:
    return (v == 0) & (F.hex(v.cast("string")) == F.hex(F.lit("-0.0")))


def varfloat_length(v: Column) -> Column:
    """Bytes of a number: 3 if null, as a signed integer where it is one of 32 bits (and not -0.0), else 10."""
    whole = (v == F.floor(v)) & (v >= -(1 << 31)) & (v <= (1 << 31) - 1) & ~is_negative_zero(v)
    return F.when(v.isNull(), 3).when(whole, signed_varnum_length(F.when(whole, v).cast("long"))).otherwise(10)


def varuint_length(v: Column) -> Column:
    """Bytes of an unsigned 32-bit number where the high bit continues; as many as varnum_length has."""
    return varnum_length(v)


def file_form(text: Column) -> Column:
    """A dictionary string's escape: \\x00 and \\x01 are preceded by \\x01."""
    return F.regexp_replace(text, "([\\x00\\x01])", "\x01$1")


def to_unicode_escape(text: Column) -> Column:
    """\\x7F and four hex digits become \\u and the digits."""
    return F.regexp_replace(text, "\x7f([0-9A-Fa-f]{4})", r"\\u$1")


def from_unicode_escape(text: Column) -> Column:
    """\\u and four hex digits become \\x7F and the digits, for surrogates and for \\x7F itself."""
    return F.regexp_replace(text, r"\\u([dD][89a-fA-F][0-9a-fA-F]{2}|007[fF])", "\x7f$1")


def bucket(n: Column, total: Column, buckets: int) -> Column:
    return F.floor(n * (buckets - 1) / total).cast("int")
