"""Violation tables and the assertion that one of them is empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CheckFailed(AssertionError):
    """A table that must be empty held rows."""


def assert_empty(violations: DataFrame, message: str, examples: int = 10) -> None:
    """Raise with a few example rows when ``violations`` is not empty."""
    found = violations.limit(examples).collect()
    if found:
        raise CheckFailed(f"{message}; examples: {[r.asDict() for r in found]}")


def preview(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """First ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)


def require_columns(df: DataFrame, columns: Sequence[str], table: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{table} lacks columns {missing}; it has {df.columns}")
    return df


def require_rows(df: DataFrame, table: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{table} is empty")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
