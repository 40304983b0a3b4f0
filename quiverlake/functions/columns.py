"""Vector arithmetic as Catalyst expressions over array columns, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def normalized(v: Column, n: Column) -> Column:
    return F.transform(v, lambda x: x / n)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def product(matrix: Sequence[Sequence[float]], v: Column) -> Column:
    """A literal matrix times a vector column."""
    rows = F.from_json(F.lit(str([list(map(float, r)) for r in matrix])), "array<array<double>>")  # constant-folded
    return F.transform(rows, lambda r: dot(r, v))


def cell_of(x: Column, inner: Sequence[float]) -> Column:
    """Number of inner boundaries at or below x."""
    bounds = F.array(*[F.lit(float(b)) for b in inner])
    return F.size(F.filter(bounds, lambda b: x >= b))


def exact_metric(metric: str, a: Column, b: Column) -> Column:
    if metric == "dot":
        return dot(a, b)
    if metric == "cosine":
        return dot(a, b) / (norm(a) * norm(b))
    return squared_distance(a, b)
