"""All registered queries."""

from __future__ import annotations

from . import (  # noqa: F401
    align_queries,
    audit_queries,
    identity_queries,
    io_queries,
    metric_queries,
    path_queries,
    sampling_queries,
    text_queries,
    vector_queries,
)
from .registry import CATALOGUE

FLAGSHIP = "deletions"

__all__ = ["CATALOGUE", "FLAGSHIP"]
