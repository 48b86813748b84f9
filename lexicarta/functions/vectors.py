"""Vector expressions over ``array<float>``, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalise(a: Column, least: float = 1e-12) -> Column:
    """Divided by the length, or by ``least`` where that is larger; zero vectors stay zero."""
    length = F.array_repeat(F.greatest(norm(a), F.lit(least)), F.size(a))
    return F.zip_with(a, length, lambda x, n: x.cast("double") / n)
