"""Hash expressions with fixed results on every platform."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_values(text: str) -> str:
    """SQL for the UTF-8 bytes of a text as an array of INT: each byte becomes a Latin-1 character, whose code point it
    is. Empty for an empty text."""
    return f"CASE WHEN octet_length({text}) = 0 THEN CAST(array() AS ARRAY<INT>) ELSE transform(split(decode(encode({text}, 'UTF-8'), 'ISO-8859-1'), ''), c -> ascii(c)) END"


def fnv1a(word: str, buckets: int = 1 << 18) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, modulo buckets; an SQL expression is taken for `word`."""
    return F.expr(f"aggregate({byte_values(word)}, 2166136261L, (h, b) -> ((h ^ b) * 16777619L) & 4294967295L) % {buckets}")


def duck_fnv1a(word: str, buckets: int = 1 << 18) -> str:
    return f"""(list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, strlen({word})),
        lambda i: ('0x' || substr(hex(encode({word})), (2 * i + 1)::BIGINT, 2))::BIGINT)),
        lambda h, b: (xor(h, b) * 16777619) & 4294967295::BIGINT) % {buckets})"""


def md5_28(value: str) -> Column:
    """The first 28 bits (7 hex digits) of the MD5 as LONG: products with 31-bit factors can't overflow."""
    return F.conv(F.substring(F.md5(value), 1, 7), 16, 10).cast("bigint")


def seeded_order(seed: str, *keys: str) -> Column:
    """A stable pseudo-random sort key."""
    return F.md5(F.concat(F.lit(seed + ":"), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)))
