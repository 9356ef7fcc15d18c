"""Time range, box and grid queries over posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import geo, timeops
from tidegrid.schema import GRID_LIMIT, GRID_PRECISION, IMAGE_LIMIT, TRENDING_LIMIT, Box
from tidegrid.session import cut


def stamp(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def in_range(df: DataFrame, start: str, end: str, ts: str = "created_time") -> DataFrame:
    """Posts of a closed time range. The bounds are constants, so the filter reaches the scan."""
    return df.where(F.col(ts).between(stamp(start), stamp(end)))


def up_to(df: DataFrame, now: str, ts: str = "created_time") -> DataFrame:
    return df.where(F.col(ts) <= stamp(now))


def in_area(df: DataFrame, box: Box) -> DataFrame:
    return df.where(geo.in_box("lat", "lon", box))


def extent(df: DataFrame) -> DataFrame:
    """Spatial and temporal extent of each named set of posts."""
    return df.groupBy("scrape").agg(
        F.min("lat").alias("south"),
        F.min("lon").alias("west"),
        F.max("lat").alias("north"),
        F.max("lon").alias("east"),
        F.min("created_time").alias("start"),
        F.max("created_time").alias("end"),
        F.count("*").alias("posts"),
    )


def count_in_range(df: DataFrame, start: str, end: str, unit: str = "hour") -> DataFrame:
    """Count of the running unit at time ``end``: date, count, and whether the unit is complete.

    The running unit is the one that ends at ``end`` when ``end`` lies on a unit edge.
    """
    low = timeops.unit_just_ended(stamp(end), unit)
    low = F.greatest(low, stamp(start))
    return (
        df.where(F.col("created_time").between(low, stamp(end)))
        .agg(F.count("*").alias("count"))
        .select(low.alias("date"), "count", timeops.full_unit(stamp(end), unit).alias("full_unit"))
    )


def series(df: DataFrame, unit: str = "day", fill_gaps: bool = False) -> DataFrame:
    """Counts per time unit."""
    out = df.groupBy(timeops.floor_time("created_time", unit).alias("bucket")).agg(F.count("*").alias("count"))
    return timeops.fill_gaps(out, "bucket", unit) if fill_gaps else out


def cells(df: DataFrame, precision: int = GRID_PRECISION, *keys: Column) -> DataFrame:
    """Counts per geohash cell and further keys, grouped on a number; cell names are made last."""
    names = [f"k{i}" for i in range(len(keys))]
    grouped = df.groupBy(
        geo.geohash_key("lat", "lon", precision).alias("_cell"), *[k.alias(n) for k, n in zip(keys, names)]
    ).agg(F.count("*").alias("count"))
    return grouped.select(geo.geohash_text("_cell", precision).alias("cell"), *names, "count")


def busiest_cells(df: DataFrame, precision: int = GRID_PRECISION, limit: int = GRID_LIMIT) -> DataFrame:
    """Geohash counts, most frequent first; ties by cell name."""
    return cells(df, precision).orderBy(F.desc("count"), "cell").limit(limit)


def cells_by_day(df: DataFrame, precision: int) -> DataFrame:
    return cells(df, precision, timeops.floor_time("created_time", "day")).withColumnRenamed("k0", "day")


def nest_days(by_day: DataFrame) -> DataFrame:
    """Flat cell/day counts to one row per cell with its time-ordered series."""
    return by_day.groupBy("cell").agg(
        F.array_sort(F.collect_list(F.struct("day", "count"))).alias("series"), F.sum("count").alias("count")
    )


def cell_features(counts: DataFrame, precision: int) -> DataFrame:
    """One GeoJSON feature text per cell."""
    return counts.select(
        "cell", "count", F.to_json(geo.cell_feature("cell", precision, count=F.col("count"))).alias("feature")
    )


def feature_collection(counts: DataFrame, precision: int, limit: int = GRID_LIMIT) -> DataFrame:
    """A single FeatureCollection text of the ``limit`` busiest cells (the limit bounds its size)."""
    top = counts.orderBy(F.desc("count"), "cell").limit(limit)
    feature = geo.cell_feature("cell", precision, count=F.col("count"))
    return top.agg(F.collect_list(feature).alias("features")).select(
        F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("geojson")
    )


def trending(
    df: DataFrame, term: str, unit: str = "hour", limit: int = TRENDING_LIMIT, one_pass: bool = False
) -> DataFrame:
    """The ``limit`` most frequent terms, each with its series.

    Counts come first; only the survivors (``limit`` rows, so safe to broadcast) get a series. That reads
    the posts twice but shuffles little. ``one_pass`` counts (term, time) once and is better where the
    terms are costly to make, such as tags cut out of long texts.
    """
    bucket = timeops.floor_time("created_time", unit).alias("bucket")
    if one_pass:
        fine = cut(df.groupBy(term, bucket).agg(F.count("*").alias("count")))
        totals = fine.groupBy(term).agg(F.sum("count").alias("total"))
    else:
        totals = df.groupBy(term).agg(F.count("*").alias("total"))
    top = F.broadcast(totals.orderBy(F.desc("total"), term).limit(limit))
    if one_pass:
        return fine.join(top, term).select(term, "total", "bucket", "count")
    return df.join(top, term).groupBy(term, "total", bucket).agg(F.count("*").alias("count"))


def recent(df: DataFrame, limit: int = IMAGE_LIMIT) -> DataFrame:
    return (
        df.orderBy(F.desc("created_time"), "id")
        .limit(limit)
        .select("id", "created_time", "user_id", "lat", "lon", "link", "img_url")
    )


def analyze_area(df: DataFrame, box: Box, unit: str = "day", precision: int = GRID_PRECISION) -> dict[str, DataFrame]:
    """Series and grid of one area. Callers that run both may cache the shared filtered frame."""
    area = in_area(df, box)
    return {"series": series(area, unit), "grid": busiest_cells(area, precision)}


def area_report(df: DataFrame, box: Box, unit: str = "day", precision: int = GRID_PRECISION) -> DataFrame:
    """Series and grid of one area in a single pass: each post counts under a day key and a cell key."""
    area = in_area(df, box)
    both = area.select(
        F.explode(
            F.array(
                F.struct(F.lit("series").alias("part"), F.date_format(timeops.floor_time("created_time", unit), "yyyy-MM-dd").alias("key")),
                F.struct(F.lit("grid").alias("part"), geo.geohash("lat", "lon", precision).alias("key")),
            )
        ).alias("e")
    )
    return both.groupBy("e.part", "e.key").agg(F.count("*").alias("count"))


def tick_bundle(df: DataFrame, now: str, trailing_hours: float, step_hours: float, box: Box) -> dict[str, DataFrame]:
    """What one playback tick shows: running count, trailing grid, newest images, and the clock."""
    def back(h: float) -> Column:
        return timeops.date_add(stamp(now), "hour", -h)

    ts = F.col("created_time")
    seen = up_to(df, now)
    return {
        "series": seen.where(ts >= timeops.unit_just_ended(stamp(now), "hour")).agg(F.count("*").alias("count")),
        "grid": busiest_cells(in_area(seen.where(ts >= back(trailing_hours)), box)),
        "images": recent(seen.where(ts >= back(step_hours))),
        "clock": df.sparkSession.range(1).select(stamp(now).alias("now")),
    }


def _since(ts: Column, start: str) -> Column:
    return F.unix_micros(ts.cast("timestamp")) - F.unix_micros(stamp(start).cast("timestamp"))


def ticks_since(ts: Column, start: str, step_hours: float) -> Column:
    """How many ticks of a clock that starts at ``start`` lie at or before a time."""
    return F.floor(_since(ts, start) / F.lit(int(step_hours * 3600e6)))


def tick_number(spark: SparkSession, start: str, end: str, step_hours: float) -> int:
    return spark.range(1).select(ticks_since(stamp(end), start, step_hours)).first()[0]


def tick_hits(df: DataFrame, start: str, last: int | Column | None, trailing_hours: float, step_hours: float) -> DataFrame:
    """Posts per tick, for ticks with posts: (tick, count).

    A post belongs to the few ticks whose closed trailing range holds it. Their numbers follow from its
    time, so posts are exploded to ticks by arithmetic and no range join is needed.
    """
    step, trail = int(step_hours * 3600e6), int(trailing_hours * 3600e6)
    off = _since(F.col("created_time"), start)
    first_tick = F.greatest(F.lit(1), F.ceil(off / F.lit(step)))
    last_tick = F.floor((off + trail) / F.lit(step))
    if last is not None:
        last_tick = F.least(last if isinstance(last, Column) else F.lit(last), last_tick)
    return (
        df.select(first_tick.alias("a"), last_tick.alias("b"))
        .where("a <= b")
        .select(F.explode(F.sequence("a", "b")).alias("tick"))
        .groupBy("tick")
        .agg(F.count("*").alias("count"))
    )


def tick_rows(hits: DataFrame, start: str, step_hours: float) -> DataFrame:
    """Ticks with their time and count (0 where it is null)."""
    t0, step = F.unix_micros(stamp(start).cast("timestamp")), int(step_hours * 3600e6)
    return hits.select(
        "tick", timeops.ntz(F.timestamp_micros(t0 + F.col("tick") * step)).alias("now"), F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))


def ticks(df: DataFrame, start: str, end: str, trailing_hours: float, step_hours: float) -> DataFrame:
    """Counts of every playback tick between two times, in one pass."""
    last = ticks_since(stamp(end), start, step_hours)
    hits = tick_hits(df, start, last, trailing_hours, step_hours)
    clock = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(1).cast("bigint"), last)).alias("tick"))
    return tick_rows(clock.join(hits, "tick", "left"), start, step_hours)


def square_grid(df: DataFrame, box: Box, side_miles: float = 1.0) -> DataFrame:
    """Counts on a square grid laid over an extent from its south-west corner, with cell corners.

    A mile is a fixed share of a degree of latitude; longitude uses the latitude of the south edge.
    """
    lat_step = side_miles / 69.0
    lon_step = F.lit(lat_step) / F.cos(F.radians(F.lit(box.south)))
    row = F.floor((F.col("lat") - F.lit(box.south)) / F.lit(lat_step)).cast("bigint")
    col = F.floor((F.col("lon") - F.lit(box.west)) / lon_step).cast("bigint")
    counts = in_area(df, box).groupBy(row.alias("row"), col.alias("col")).agg(F.count("*").alias("count"))
    return counts.select(
        "row",
        "col",
        "count",
        (F.lit(box.south) + F.col("row") * lat_step).alias("south"),
        (F.lit(box.west) + F.col("col") * lon_step).alias("west"),
        (F.lit(box.south) + (F.col("row") + 1) * lat_step).alias("north"),
        (F.lit(box.west) + (F.col("col") + 1) * lon_step).alias("east"),
    )


def cell_at_time(counts: DataFrame, spots: DataFrame, full_count: int = 20) -> DataFrame:
    """Count of each wanted (cell, bucket), 0 where nothing was seen, with its drawing opacity."""
    n = F.coalesce("count", F.lit(0).cast("bigint"))
    return spots.join(counts, ["cell", "bucket"], "left").select(
        "cell", "bucket", n.alias("count"), (n / F.lit(float(full_count))).alias("opacity")
    )
