"""Vector functions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays as it is. Vector and length are computed once, not for every component."""
    unit = lambda w, n: F.transform(w, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return let(v, lambda w: let(norm(w), lambda n: unit(w, n)))


def cosine(a: Column, b: Column) -> Column:
    """True cosine; 0 for empty, zero or unequally long vectors."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def prefix(v: Column, size: int) -> Column:
    """The first components, brought to unit length."""
    if size <= 0:
        raise ValueError("a prefix has at least one component")
    return normalized(F.slice(v, 1, size))


def coarse_size(full: Column) -> Column:
    return F.when(full >= 1024, 128).when(full >= 384, 64).when(full >= 128, 32).otherwise(full)


def blended(a: Column, b: Column, weight: float) -> Column:
    """(1 - weight) a + weight b, brought to unit length."""
    return normalized(F.zip_with(a, b, lambda x, y: x.cast("double") * (1 - weight) + y.cast("double") * weight))
