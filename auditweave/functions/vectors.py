"""Column expressions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """v by its norm; zero stays zero."""
    n = norm(v)
    return F.transform(v, lambda x: (x / F.when(n == 0, 1.0).otherwise(n)).cast("float"))


def is_zero(v: Column) -> Column:
    return v.isNull() | ~F.exists(v, lambda x: x != 0)
