"""Reproducible pseudo-random numbers from keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = float(2**32)


def hash_bucket(key: Column, seed: int | str, salt: str = "") -> Column:
    """Uniform [0, 1) value from md5(seed:salt:key); reproducible in any SQL engine."""
    text = F.concat(F.lit(f"{seed}:{salt}"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(TWO_32)
