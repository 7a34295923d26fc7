"""Keyed order of rows: equal on every engine, partitioning and retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 12  # hexadecimal digits of md5: 48 bits, exact in a double


def unit(seed: str, *cols: str) -> Column:
    """Uniform in [0, 1) for (seed, columns); nulls count as empty."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def unit_sql(seed: str, *cols: str) -> str:
    """The same in DuckDB."""
    text = " || ':' || ".join([f"'{seed}'", *[f"coalesce(cast({c} as varchar), '')" for c in cols]])
    return f"(cast(('0x' || substr(md5({text}), 1, {DIGITS})) as bigint) / {float(16**DIGITS)})"
