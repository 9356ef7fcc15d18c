"""Maps and arrays in columns: entries, keys, values, merges, zips and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_of(df: DataFrame, by: list[str], key: str, value: Column, name: str = "map") -> DataFrame:
    """One map per group from its distinct keys, each with an aggregate ``value``; entries are in key order.

    Values are summed up before anything is collected, so a map is as large as its distinct keys. Null keys are
    left out, as a map has none.
    """
    flat = df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(value.alias("_v"))
    return flat.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), "_v")))).alias(name))


def entries(c: Column | str) -> Column:
    """Array of (key, value) in key order."""
    return F.array_sort(F.map_entries(_c(c)))


def keys(c: Column | str) -> Column:
    return F.transform(entries(c), lambda e: e["key"])


def values(c: Column | str) -> Column:
    """Values in the order of their keys."""
    return F.transform(entries(c), lambda e: e["value"])


def has(c: Column | str, key: str) -> Column:
    return F.map_contains_key(_c(c), F.lit(key))


def overlaid(first: Column | str, second: Column | str) -> Column:
    """Entries of both maps; where both have a key the second one's value stands."""
    a, b = _c(first), _c(second)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def without(c: Column | str, *gone: str) -> Column:
    return F.map_filter(_c(c), lambda k, _: ~k.isin(list(gone)))


def merged(arrays: Column | str) -> Column:
    """The arrays of an array, one after another."""
    return F.flatten(_c(arrays))


def picked(array: Column | str, places: Column | str) -> Column:
    """The items of an array at the given places (from 0), in that order; null beyond its ends."""
    a = _c(array)
    return F.transform(_c(places), lambda i: F.get(a, i))


def zipped(*arrays: Column | str) -> Column:
    """Array of structs of the items at equal places (fields 0, 1, ..), as long as the shortest array."""
    cols = [_c(a) for a in arrays]
    n = F.least(*[F.size(c) for c in cols]) if len(cols) > 1 else F.size(cols[0])
    return F.arrays_zip(*[F.slice(c, F.lit(1), n).alias(f"f{i}") for i, c in enumerate(cols)])


def span(start: Column | float, stop: Column | float, step: Column | float = 1.0) -> Column:
    """Numbers from ``start`` up (or down) to but without ``stop``. Each is computed from its place, so nothing adds up."""
    a, z, s = [c if isinstance(c, Column) else F.lit(float(c)) for c in (start, stop, step)]
    n = F.greatest(F.ceil((z - a) / s), F.lit(0)).cast("bigint")
    places = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(places, lambda i: a + i * s)
