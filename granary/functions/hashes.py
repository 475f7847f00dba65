"""Checksums and hashes of columns and values."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def crc32(column: Column | str) -> Column:
    """CRC-32 (IEEE) of text or bytes."""
    return F.crc32(column)


def crc32_of(data: bytes) -> int:
    return zlib.crc32(data)


def hash64(*columns: Column | str) -> Column:
    """xxHash64 with Spark's seed (42)."""
    return F.xxhash64(*columns)


def hash64_of(data: bytes, seed: int = 0) -> int:
    """xxHash64 of bytes with any seed."""
    import xxhash

    return xxhash.xxh64_intdigest(data, seed)
