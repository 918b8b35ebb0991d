"""Content digests built from Spark's own JSON and SHA-2 functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON object with its keys in order."""
    return F.to_json(F.struct(*(fields[name].alias(name) for name in sorted(fields))))


def text_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def row_text(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def digest_slice(digest: Column, start: int) -> Column:
    """Fifteen hex digits of a digest as an exact number; sums of them ignore row order."""
    return F.conv(digest.substr(start, 15), 16, 10).cast("decimal(20,0)")


def _mark(byte: int) -> Column:
    return F.lit(bytearray([byte]))


def packed(digest: Column) -> Column:
    """A SHA-256 in hexadecimal as its 32 bytes behind a one, any other text as its own behind a zero: what travels
    is half as long, and ``unpacked`` gives every text back."""
    is_digest = digest.rlike(r"\A[0-9a-f]{64}\z")
    return F.when(is_digest, F.concat(_mark(1), F.unhex(digest))).otherwise(F.concat(_mark(0), digest.cast("binary")))


def unpacked(packed_digest: Column) -> Column:
    rest = F.substring(packed_digest, 2, (1 << 31) - 1)
    return F.when(F.substring(packed_digest, 1, 1) == _mark(1), F.lower(F.hex(rest))).otherwise(rest.cast("string"))
