"""Vector columns as plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays zero."""
    n = F.sqrt(squared_norm(a))
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def standardised(a: Column, mean: Column, sd: Column) -> Column:
    return F.zip_with(F.zip_with(a, mean, lambda x, m: x.cast("double") - m), sd, lambda x, s: x / s)
