"""Vector arithmetic on arrays and an embedding for tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), use), 0)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """L2-normalised; null for a zero vector."""
    return let(a, lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n))))


def squared_distance(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def letter_embedding(text: Column) -> Column:
    """Normalised letter counts: a deterministic stand-in for an embedding model."""
    counts = let(F.lower(text), lambda low: F.array(*[
        (F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"]))
    return let(counts, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))))
