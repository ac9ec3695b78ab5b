"""Arithmetic on array<double> columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def rounded(x: Column, places: int) -> Column:
    """x rounded, half away from zero; what is below zero and comes to nought is -0.0, which Spark's own round makes 0.0."""
    return F.signum(x) * F.round(F.abs(x), places)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of different or no length, of length zero, or with values that are not finite."""
    value = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    fine = (F.size(a) == F.size(b)) & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(fine, value)
