"""Time Column expressions: units, floors, gap-free spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALENDAR_UNITS = {"year": 12, "quarter": 3, "month": 1}
DAY_UNITS = {"week": 7, "day": 1}
CLOCK_UNITS = {"hour": 3600.0, "minute": 60.0, "second": 1.0}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def date_add(ts: Column | str, unit: str, n: float) -> Column:
    """Move a timestamp by ``n`` units. Fractions are allowed for hour and finer units only.

    Calendar units overflow like a date setter: one month after January 31 is March 2 or 3.
    """
    ts, unit = _c(ts), unit.lower()
    if unit in CLOCK_UNITS:
        return ts + F.make_dt_interval(secs=F.lit(n * CLOCK_UNITS[unit]).cast("decimal(18,6)"))
    if unit not in CALENDAR_UNITS and unit not in DAY_UNITS:
        raise ValueError(f"unknown time unit {unit!r}")
    if n != int(n):
        raise ValueError(f"a fraction of a {unit} has no fixed length")
    if unit in DAY_UNITS:
        return ts + F.make_dt_interval(days=F.lit(int(n) * DAY_UNITS[unit]))
    first = F.date_trunc("month", ts).cast("timestamp_ntz")
    moved = first + F.make_ym_interval(months=F.lit(int(n) * CALENDAR_UNITS[unit]))
    return ntz(moved) + (ts - first)


def floor_time(ts: Column | str, unit: str, week_start: int = 0) -> Column:
    """Start of the unit holding ``ts``; weeks start on Sunday (0) unless another day is named."""
    ts = _c(ts)
    if unit == "week":
        # Built-in weeks start on Monday, so the clock is moved by the days between the two starts.
        ahead = F.make_dt_interval(days=F.lit((1 - week_start) % 7))
        return ntz(F.date_trunc("week", ts + ahead)) - ahead
    return ntz(F.date_trunc(unit, ts))


def ceil_time(ts: Column | str, unit: str) -> Column:
    ts = _c(ts)
    low = floor_time(ts, unit)
    return F.when(low == ts, ts).otherwise(date_add(low, unit, 1))


def round_time(ts: Column | str, unit: str) -> Column:
    """The nearer of floor and ceiling; the middle goes up."""
    ts = _c(ts)
    low = floor_time(ts, unit)
    high = date_add(low, unit, 1)
    return F.when(ts - low < high - ts, low).otherwise(high)


def full_unit(ts: Column | str, unit: str) -> Column:
    return floor_time(ts, unit) == _c(ts)


def unit_just_ended(ts: Column | str, unit: str) -> Column:
    """Start of the unit that is running, or that ends exactly now."""
    return floor_time(_c(ts) - F.make_dt_interval(secs=F.lit(0.000001).cast("decimal(18,6)")), unit)


def day_of_year(ts: Column | str) -> Column:
    """Day of the year, counted from 0."""
    return F.dayofyear(_c(ts)) - 1


def week_of_year(ts: Column | str, week_start: int = 0) -> Column:
    """Week number counted from 0; a new week begins on each ``week_start`` day (Sunday = 0)."""
    ts = _c(ts)
    lead = F.pmod(F.dayofweek(F.trunc(ts, "year")) - 1 - F.lit(week_start), F.lit(7))
    return F.floor((day_of_year(ts) + lead) / 7).cast("int")


def seconds(ts: Column | str) -> Column:
    """Seconds since the epoch as a double, for zone-free timestamps as well."""
    return F.unix_micros(_c(ts).cast("timestamp")) / F.lit(1e6)


def days(ts: Column | str) -> Column:
    """Days since the epoch as a double."""
    return F.unix_micros(_c(ts).cast("timestamp")) / F.lit(86400e6)


def from_epoch(sec: Column | str) -> Column:
    """Epoch seconds, as number or text, to a zone-free timestamp; unreadable text gives null."""
    return ntz(F.timestamp_seconds(_c(sec).try_cast("double")))


def spine(df: DataFrame, ts: str, unit: str) -> DataFrame:
    """All unit starts between the first and last value of ``ts`` (one row per unit)."""
    ends = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    step = F.expr(f"interval 1 {unit}")
    return ends.select(
        F.explode(F.sequence(floor_time("a", unit), floor_time("b", unit), step)).alias("bucket")
    )


def fill_gaps(series: DataFrame, ts: str, unit: str, count: str = "count") -> DataFrame:
    """A ``(bucket, count)`` series with zero rows for empty buckets."""
    return (
        spine(series, ts, unit)
        .withColumnRenamed("bucket", ts)
        .join(series, ts, "left")
        .withColumn(count, F.coalesce(F.col(count), F.lit(0).cast("bigint")))
    )
