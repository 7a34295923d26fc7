"""Ratios, logistic terms and array arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, 0.0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x).cast("double")))


def softplus(x: Column | str) -> Column:
    """log(1 + exp(x)) without overflow."""
    v = _c(x).cast("double")
    return F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))


def neg_log_sigmoid(x: Column | str) -> Column:
    return softplus(-_c(x))


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str) -> Column:
    """Unit vector; a zero vector stays zero."""
    norm = l2_norm(v)
    return F.transform(_c(v), lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b)), F.lit(0.0))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)
