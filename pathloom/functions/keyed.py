"""Randomness as keyed hashing: equal on every engine, partitioning and retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 15 hex digits of md5, so a draw is uniform over [0, 2**60).
HASH_DIGITS = 15
HASH_SPACE = float(16 ** HASH_DIGITS)


def key_hash(seed: int | str, *cols: Column | str) -> Column:
    """Uniform BIGINT in [0, 2**60) for (seed, key columns)."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("bigint")


def key_unit(seed: int | str, *cols: Column | str) -> Column:
    """Uniform DOUBLE in [0, 1] for (seed, key columns)."""
    return key_hash(seed, *cols).cast("double") / F.lit(HASH_SPACE)
