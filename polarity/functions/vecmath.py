"""Distances between dense vectors held as arrays (JVM higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def manhattan(a, b) -> Column:
    """Sum of |a_i - b_i|; vectors of unequal length have distance 0 (reference rule)."""
    a, b = _c(a), _c(b)
    d = _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return F.when(F.size(a) == F.size(b), d).otherwise(F.lit(0.0))


def euclidean(a, b) -> Column:
    """sqrt(sum (a_i - b_i)^2); vectors of unequal length have distance 0 (reference rule)."""
    a, b = _c(a), _c(b)
    d = _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double"))
                        * (x.cast("double") - y.cast("double"))))
    return F.when(F.size(a) == F.size(b), F.sqrt(d)).otherwise(F.lit(0.0))


def squared_euclidean(a, b) -> Column:
    """sum (a_i - b_i)^2; vectors of unequal length have distance 0, as for the other distances."""
    a, b = _c(a), _c(b)
    d = _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double"))
                        * (x.cast("double") - y.cast("double"))))
    return F.when(F.size(a) == F.size(b), d).otherwise(F.lit(0.0))
