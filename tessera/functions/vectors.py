"""Vector arithmetic on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(v: Column, eps: float = 1e-8) -> Column:
    """x / (|x| + eps); the norm is bound once, as an array of one, not found again for each x."""
    return F.element_at(F.transform(F.array(norm(v) + eps), lambda n: F.transform(doubles(v), lambda x: x / n)), 1)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """a.b / (|a||b| + eps)."""
    return dot(a, b) / (norm(a) * norm(b) + eps)


def scaled(v: Column, mean: Column, std: Column) -> Column:
    """(v / 255 - mean) / std."""
    return (v / 255.0 - mean) / std


def to_byte(v: Column) -> Column:
    """Clipped to 0..255 and cut to an integer."""
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0))).cast("int")


def stretched(v: Column, low: Column, high: Column) -> Column:
    """(v - low) / (high - low + 1e-6), clipped to 0..1."""
    return F.least(F.greatest((v - low) / (high - low + 1e-6), F.lit(0.0)), F.lit(1.0))
