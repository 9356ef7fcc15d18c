"""Time function queries over events and orders."""

from functools import reduce

from pyspark.sql import functions as F

from tidegrid.functions import timeops
from tidegrid.plans.registry import query
from tidegrid.sources.tables import table

STEPS = [("year", 1), ("quarter", -1), ("month", 1), ("week", 2), ("day", -3), ("hour", 0.5), ("minute", 1.5), ("second", -0.25)]


def sql_step(unit, n):
    months = {"year": 12, "quarter": 3, "month": 1}
    if unit in months:
        k = n * months[unit]
        return f"date_trunc('month', ts) + interval ({k}) month + (ts - date_trunc('month', ts))"
    micros = {"week": 604800e6, "day": 86400e6, "hour": 3600e6, "minute": 60e6, "second": 1e6}[unit] * n
    return f"ts + to_microseconds({int(micros)})"


@query("date_add_units", " union all ".join(
    f"select event_id, '{u}' as unit, {sql_step(u, n)} as moved from events" for u, n in STEPS))
def date_add_units(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    parts = [e.select("event_id", F.lit(u).alias("unit"), timeops.date_add("ts", u, n).alias("moved")) for u, n in STEPS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("full_unit_flag", """
    select o_orderkey, date_trunc('month', o_orderdate) as month, date_trunc('month', o_orderdate) = o_orderdate as full_month,
           date_trunc('hour', o_orderdate) = o_orderdate as full_hour,
           date_trunc('month', o_orderdate - interval 1 microsecond) as just_ended from orders""")
def full_unit_flag(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey", timeops.floor_time("o_orderdate", "month").alias("month"),
        timeops.full_unit("o_orderdate", "month").alias("full_month"), timeops.full_unit("o_orderdate", "hour").alias("full_hour"),
        timeops.unit_just_ended("o_orderdate", "month").alias("just_ended"))


@query("epoch_days", """
    select event_id, round(date_diff('microsecond', timestamp '1970-01-01', ts) / 86400e6, 6) as ntime,
           cast(floor(date_diff('microsecond', timestamp '1970-01-01', ts) / 86400e6) as bigint) as day_number,
           cast(ts as date) as day, date_trunc('second', ts) as whole from events""")
def epoch_days(spark, d):
    days = timeops.days("ts")
    sec = F.floor(timeops.seconds("ts")).cast("string")
    return table(spark, d, "events").select(
        "event_id", F.round(days, 6).alias("ntime"), F.floor(days).cast("bigint").alias("day_number"),
        F.to_date("ts").alias("day"), timeops.from_epoch(sec).alias("whole"))


@query("date_formats", """
    select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as iso, strftime(ts, '%Y%m%d%H%M%S') as compact,
           date_trunc('millisecond', ts) as parsed from events""")
def date_formats(spark, d):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    e = table(spark, d, "events").select("event_id", iso.alias("iso"))
    return e.select(
        "event_id", "iso", F.regexp_replace(F.substring("iso", 1, 19), "[^0-9]", "").alias("compact"),
        F.to_timestamp_ntz(F.col("iso"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("parsed"))


UNITS = ["second", "minute", "hour", "day", "month", "year"]
SUNDAY = "date_trunc('week', ts + interval 1 day) - interval 1 day"


@query("time_floor", " union all ".join([
    f"""select event_id, '{u}' as unit, f as low, case when f = ts then ts else f + interval 1 {u} end as high,
        case when ts - f < (f + interval 1 {u}) - ts then f else f + interval 1 {u} end as nearest
        from (select event_id, ts, date_trunc('{u}', ts) as f from events)""" for u in UNITS] + [
    f"""select event_id, 'week', f, case when f = ts then ts else f + interval 7 day end,
        case when ts - f < (f + interval 7 day) - ts then f else f + interval 7 day end
        from (select event_id, ts, {SUNDAY} as f from events)""",
    """select event_id, 'wednesday', f, f + interval 7 day, null::timestamp
       from (select event_id, date_trunc('week', ts - interval 2 day) + interval 2 day as f from events)"""]))
def time_floor(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    parts = [
        e.select("event_id", F.lit(u).alias("unit"), timeops.floor_time("ts", u).alias("low"),
                 timeops.ceil_time("ts", u).alias("high"), timeops.round_time("ts", u).alias("nearest"))
        for u in [*UNITS, "week"]
    ]
    low = timeops.floor_time("ts", "week", 3)
    parts.append(e.select("event_id", F.lit("wednesday").alias("unit"), low.alias("low"),
                          timeops.date_add(low, "week", 1).alias("high"), F.lit(None).cast("timestamp_ntz").alias("nearest")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("week_of_year", """
    select o_orderkey, cast(dayofyear(o_orderdate) - 1 as integer) as day,
           cast((dayofyear(o_orderdate) - 1 + dayofweek(date_trunc('year', o_orderdate))) // 7 as integer) as sunday_week,
           cast((dayofyear(o_orderdate) - 1 + (dayofweek(date_trunc('year', o_orderdate)) + 6) % 7) // 7 as integer) as monday_week
    from orders""")
def week_of_year(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", timeops.day_of_year("o_orderdate").alias("day"), timeops.week_of_year("o_orderdate").alias("sunday_week"),
        timeops.week_of_year("o_orderdate", 1).alias("monday_week"))
