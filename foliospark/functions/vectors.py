"""Column functions on vectors (arrays of numbers), in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product; null if either is null or the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def normalized(a: Column, eps: float = 0.0) -> Column:
    """The vector divided by its length (by ``eps`` at least); a zero vector stays zero."""
    # The length is bound once, in an array of one, and not taken anew for every number.
    scaled = F.transform(F.array(F.greatest(norm(a), F.lit(eps))), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))
    return F.get(scaled, F.lit(0))


def finite(a: Column) -> Column:
    """Whether all numbers are there and finite."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
