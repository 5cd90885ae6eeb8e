"""Column helpers for dense vectors held as arrays.

Everything is computed in DOUBLE. A zero or NULL vector normalises to NULL, so
it drops out of rankings instead of spreading NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays of doubles of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit vector; NULL for a zero vector."""
    norm = l2_norm(v)
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))
