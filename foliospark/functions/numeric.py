"""Column functions on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = 1.7976931348623157e308


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def finite_or(x: Column, nan: float = 0.0, low: float = 0.0) -> Column:
    """NaN and -inf replaced, +inf made the largest double."""
    return F.when(F.isnan(x), F.lit(nan)).when(x == float("-inf"), F.lit(low)).when(x == float("inf"), F.lit(LARGEST)).otherwise(x)


def is_finite(x: Column) -> Column:
    """Whether a number is there, not NaN and not infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def clamp_min(x: Column, least: float) -> Column:
    """x, and ``least`` where x is below it."""
    return F.greatest(x, F.lit(least))


def max_abs(x: Column) -> Column:
    """Aggregate: the largest absolute value, 0 over nothing."""
    return F.coalesce(F.max(F.abs(x)), F.lit(0.0))


def geometric_mean(x: Column) -> Column:
    """Aggregate: the geometric mean of positive numbers."""
    return F.exp(F.avg(F.log(x)))
