"""Bin and class numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def equal_bin(x: Column, low: Column, high: Column, n: int | Column) -> Column:
    """0-based equal-width bin; left-closed, the last bin also holds its upper edge. No spread gives 0."""
    n = F.lit(n) if isinstance(n, int) else n
    pos = F.floor((x - low) / (high - low) * n.cast("double"))
    return F.when(high == low, F.lit(0)).otherwise(F.least(pos, n.cast("bigint") - 1)).cast("bigint")


def sturges(n: Column) -> Column:
    """Bin count for ``n`` values: ceil(log2(n)) + 1."""
    return (F.ceil(F.log2(n.cast("double"))) + 1).cast("bigint")


def bisect_left(edges: Column, x: Column) -> Column:
    """Number of sorted ``edges`` below ``x``."""
    return F.size(F.filter(edges, lambda e: e < x))


def bisect_right(edges: Column, x: Column) -> Column:
    """Number of sorted ``edges`` not above ``x``."""
    return F.size(F.filter(edges, lambda e: e <= x))


def threshold_class(x: Column, edges: list[float]) -> Column:
    """Class 0..len(edges): edges belong to the class above them."""
    return bisect_right(F.array(*[F.lit(float(e)) for e in edges]), x)


def quantize_class(x: Column, low: Column, high: Column, n: int) -> Column:
    """Equal-width class 0..n-1, clamped at both ends."""
    pos = F.floor((x - low) / (high - low) * F.lit(float(n)))
    return F.greatest(F.least(pos, F.lit(n - 1)), F.lit(0)).cast("int")
