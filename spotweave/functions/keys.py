"""Replayable randomness and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed, purpose: str, *parts) -> Column:
    """md5 of seed|purpose|parts: the order of all sampling, equal on every engine and partitioning."""
    cols = [F.lit(str(seed)), F.lit(purpose), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]]
    return F.md5(F.concat_ws("|", *cols))


def digest_number(seed, purpose: str, *parts) -> Column:
    """The first 32 bits of the digest as a non-negative long."""
    return F.conv(F.substring(digest(seed, purpose, *parts), 1, 8), 16, 10).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def known(c: Column) -> Column:
    """NaN to null."""
    return F.when(~F.isnan(c), c)
