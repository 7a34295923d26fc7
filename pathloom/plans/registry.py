"""Named queries over the relational tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query; ``sql`` is absent where SQL cannot state the result."""
    def add(run: Run) -> Run:
        if name in CATALOGUE:
            raise ValueError(f"query registered twice: {name}")
        CATALOGUE[name] = Query(run, sql)
        return run

    return add
