"""Arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def euclidean(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance of two arrays of the same length."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def share(part: Column | str, rest: Column | str) -> Column:
    """``part / (part + rest)``; 0/0 is missing rather than an error."""
    a = F.col(part) if isinstance(part, str) else part
    b = F.col(rest) if isinstance(rest, str) else rest
    return F.try_divide(a, a + b)


def finite(vector: Column | str) -> Column:
    """Whether a vector is there, and all its components are there and finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
