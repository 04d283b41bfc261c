"""Vectors as arrays: dot product, norm, cosine, mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(_d(v), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def unit(v: Column) -> Column:
    """v divided by its norm plus 1e-9."""
    n = norm(v) + F.lit(1e-9)
    return F.transform(_d(v), lambda x: x / n)


def usable(v: Column) -> Column:
    """False for vectors that are all zero, or hold null, NaN or infinite values."""
    d = _d(v)
    finite = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(d, lambda x: x != 0), F.lit(False))
