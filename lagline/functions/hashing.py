"""Reproducible pseudo-random numbers that depend on the row key only.

``rand`` and ``sample`` depend on how rows are laid out in partitions, so a
recomputed task can draw other rows. A hash of the key cannot.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 32


def key_hash(key: Column | str, salt: str | int | None = None) -> Column:
    """First 32 bits of md5(salt:key) as a non-negative bigint."""
    text = (F.col(key) if isinstance(key, str) else key).cast("string")
    if salt is not None:
        text = F.concat(F.lit(f"{salt}:"), text)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def key_bucket(key: Column | str, buckets: int, salt: str | int | None = None) -> Column:
    """Hash bucket in ``0 .. buckets - 1``."""
    return key_hash(key, salt) % F.lit(buckets)
