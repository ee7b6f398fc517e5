"""Column expressions on numeric arrays; float elements are widened before any arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """Scaled to length 1; the zero vector stays as it is."""
    return F.transform(v, lambda x: F.when(norm(v) > 0, x.cast("double") / norm(v)).otherwise(F.lit(0.0)))
