"""Partition-independent pseudo-randomness.

Every random choice is a function of ``md5(seed:key:...)``, so results do not depend
on partitioning, retries or executor loss, and the same number can be computed in
DuckDB: ``('0x' || substr(md5(s), 1, 8))::BIGINT``.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _key(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def hash32(*parts) -> Column:
    """Unsigned 32-bit integer (as BIGINT) from the first 8 hex digits of md5."""
    return F.conv(F.substring(F.md5(_key(*parts)), 1, 8), 16, 10).cast("bigint")


def unit_hash(*parts) -> Column:
    """Uniform double in [0, 1) from ``hash32``."""
    return hash32(*parts) / F.lit(TWO_32)


def chance(p: float, *parts) -> Column:
    """``unit_hash(*parts) < p`` without making the number: the hex digits of md5 are in the order
    of the numbers, and a hash that begins with the bound's digits is not below it."""
    bound = math.ceil(p * TWO_32)
    if not 0 < bound < TWO_32:
        return F.lit(bound > 0)
    return F.md5(_key(*parts)) < F.lit(f"{bound:08x}")


def sort_key(seed, *parts) -> Column:
    """Full md5 hex string: a uniform, total shuffle order (ties broken by the key)."""
    return F.md5(_key(seed, *parts))
