"""Dense vectors as arrays of doubles: column expressions without Python in the data path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least log probability of a density, and the least probability that goes into a logarithm.
LOG_FLOOR = -1000.0
P_FLOOR = 5e-43


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """Null where b is zero."""
    return F.zip_with(a, b, lambda x, y: F.when(y != 0, x / y))


def scale(a: Column, k) -> Column:
    return F.transform(a, lambda x: x * k)


def shift(a: Column, k) -> Column:
    return F.transform(a, lambda x: x + k)


def sqrt(a: Column) -> Column:
    return F.transform(a, F.sqrt)


def square(a: Column) -> Column:
    return F.transform(a, lambda x: x * x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(multiply(a, b))


def squared_distance(a: Column, b: Column) -> Column:
    """The square itself; callers take the root."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def product(a: Column) -> Column:
    """Product of the elements: the determinant of a diagonal matrix."""
    return F.aggregate(a, F.lit(1.0), lambda s, x: s * x)


def floor_at(a: Column, least: float) -> Column:
    """Struct of the floored vector and whether any element was below."""
    return F.struct(F.transform(a, lambda x: F.greatest(x, F.lit(least))).alias("vec"), F.exists(a, lambda x: x < least).alias("floored"))


def any_negative(a: Column) -> Column:
    return F.exists(a, lambda x: x < 0)


def one_hot_max(a: Column) -> Column:
    """Zero but at the first largest element, which keeps its value."""
    top = F.array_position(a, F.array_max(a)) - 1
    return F.transform(a, lambda x, i: F.when(i == top, x).otherwise(0.0))


def count_smaller(a: Column, b: Column, counts: Column) -> Column:
    """Adds one to each counter where a is smaller than b."""
    return F.zip_with(counts, F.zip_with(a, b, lambda x, y: F.when(x < y, 1).otherwise(0)), lambda c, s: c + s)


def part(a: Column, start: int, size: int) -> Column:
    """A slice; positions count from 0."""
    return F.slice(a, start + 1, size)


def mahalanobis(x: Column, mean: Column, var: Column) -> Column:
    """Exponent of a diagonal Gaussian: minus half the sum of (x - mean)^2 / var."""
    z = F.zip_with(F.zip_with(x, mean, lambda a, m: (a - m) * (a - m)), var, lambda q, v: q / v)
    return -total(z) / 2


def filled(size: int, value: float) -> Column:
    return F.array_repeat(F.lit(value), size)


def get(a: Column, i: int) -> Column:
    return F.element_at(a, i + 1)


def put(a: Column, i: int, value) -> Column:
    return F.transform(a, lambda x, k: F.when(k == i, value).otherwise(x))


def weighted_streams(streams: list[tuple[Column, float]]) -> Column:
    """One vector of several streams, as a struct with the streams' bounds and weights."""
    return F.concat(*[s for s, _ in streams])


def log_constant(var: Column) -> Column:
    """Minus half the sum of ln(2 pi var)."""
    import math

    return -F.aggregate(var, F.lit(0.0), lambda s, x: s + F.log(x * (2 * math.pi))) / 2


def log_density(x: Column, mean: Column, var: Column) -> Column:
    """Log density of a diagonal Gaussian, at least LOG_FLOOR."""
    return clamp_log(log_constant(var) + mahalanobis(x, mean, var))


def clamp_log(p: Column) -> Column:
    """Not-a-number and everything below the floor become the floor."""
    return F.greatest(F.nanvl(p, F.lit(LOG_FLOOR)), F.lit(LOG_FLOOR))


def safe_log(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(P_FLOOR)))
