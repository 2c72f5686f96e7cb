"""Hashes that other systems can repeat, for choices that must stay the same everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a(text: Column) -> Column:
    """FNV-1a of 32 bits over the UTF-8 bytes, as a bigint."""
    digits = F.hex(F.encode(text, "UTF-8"))
    at = F.when(F.length(digits) > 0, F.sequence(F.lit(1), (F.length(digits) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("bigint")
    return F.aggregate(at, F.lit(2166136261).cast("bigint"), lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the parts' MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
