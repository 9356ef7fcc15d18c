"""Grid server queries: scans, boxes, extents, series, cells, trending terms, ticks."""

from pyspark.sql import functions as F

from tidegrid.functions import geo, timeops
from tidegrid.functions.text import hashtags
from tidegrid.operators import grid, stats
from tidegrid.plans.registry import query
from tidegrid.schema import CITY_BOX, DAY_GRID_PRECISION, GRID_PRECISION, REPLAY_SPEED, Box
from tidegrid.session import work_dir
from tidegrid.sources import files, streams
from tidegrid.sources.tables import over_points, over_posts, points, posts, table

START, END = "2024-01-05 00:00:00", "2024-01-20 12:00:00"
DATA_START, DATA_END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
AREA = Box(south=39.25, west=-76.70, north=39.35, east=-76.61)
PACIFIC = Box(south=39.30, west=-76.65, north=39.35, east=-76.69)  # west > east: wraps around

IN_TIME = f"created_time between timestamp '{START}' and timestamp '{END}'"
IN_AREA = "lat >= 39.25e0 and lat <= 39.35e0 and lon >= -76.70e0 and lon <= -76.61e0"


def in_box_sql(b: Box) -> str:
    return f"lat >= {b.south}e0 and lat <= {b.north}e0 and lon >= {b.west}e0 and lon <= {b.east}e0"


def sql_geohash(precision: int, lat: str = "lat", lon: str = "lon") -> str:
    """Geohash in SQL: the interleaved bits of both coordinates, five at a time."""
    n_lon, n_lat = (5 * precision + 1) // 2, (5 * precision) // 2
    x = f"least(greatest(cast(floor(({lon} + 180e0) / 360e0 * {1 << n_lon}) as bigint), 0), {(1 << n_lon) - 1})"
    y = f"least(greatest(cast(floor(({lat} + 90e0) / 180e0 * {1 << n_lat}) as bigint), 0), {(1 << n_lat) - 1})"
    parts = []
    for i in range(precision):
        bits = []
        for j in range(5):
            t = 5 * i + j
            src, n = (x, n_lon) if t % 2 == 0 else (y, n_lat)
            bits.append(f"(({src} >> {n - 1 - t // 2}) & 1) * {16 >> j}")
        parts.append(f"substr('{geo.GEOHASH_ALPHABET}', cast(1 + {' + '.join(bits)} as integer), 1)")
    return "(" + " || ".join(parts) + ")"


@query("time_range_scan", over_points(f"select id, created_time, user_id, lat, lon from points where {IN_TIME}"))
def time_range_scan(spark, d):
    df = points(spark, d).select("id", "created_time", "user_id", "lat", "lon")
    return files.time_range_scan(df, START, END, "created_time", "id")


@query("bbox_filter", over_points(f"""
    select id, lat, lon, 'plain' as box from points where {IN_AREA}
    union all
    select id, lat, lon, 'wrapped' from points
    where lat >= 39.30e0 and lat <= 39.35e0 and (lon >= -76.65e0 or lon <= -76.69e0)"""))
def bbox_filter(spark, d):
    df = points(spark, d).select("id", "lat", "lon")
    plain = grid.in_area(df, AREA).withColumn("box", F.lit("plain"))
    return plain.unionByName(grid.in_area(df, PACIFIC).withColumn("box", F.lit("wrapped")))


@query("bounds_convert", over_points("""
    select scrape, round(max(lat), 6) as top, round(min(lon), 6) as "left", round(min(lat), 6) as bottom,
           round(max(lon), 6) as "right", round(min(lat), 6) as sw_lat, round(max(lon), 6) as ne_lon
    from points group by scrape"""))
def bounds_convert(spark, d):
    ext = grid.extent(points(spark, d))
    c = ext.select("scrape", geo.corners_from_sw_ne("south", "west", "north", "east").alias("b"))
    back = c.withColumn("s", geo.sw_ne_from_corners("b"))
    r = lambda c: F.round(F.col(c), 6)
    return back.select(
        "scrape", r("b.top_left.lat").alias("top"), r("b.top_left.lon").alias("left"),
        r("b.bottom_right.lat").alias("bottom"), r("b.bottom_right.lon").alias("right"),
        r("s.south_west.lat").alias("sw_lat"), r("s.north_east.lon").alias("ne_lon"),
    )


@query("scrape_extent", over_points("""
    select scrape, min(lat) as south, min(lon) as west, max(lat) as north, max(lon) as east,
           min(created_time) as "start", max(created_time) as "end", count(*) as posts
    from points group by scrape"""))
def scrape_extent(spark, d):
    return grid.extent(points(spark, d))


@query("list_scrapes", over_points("select distinct scrape from points where scrape in ('s0', 's2', 'absent')"))
def list_scrapes(spark, d):
    return files.list_scrapes(points(spark, d), ["s0", "s2", "absent"])


@query("count_in_range", over_points(f"""
    select timestamp '2024-01-20 11:00:00' as date, count(*) as count, true as full_unit
    from points where created_time between timestamp '2024-01-20 11:00:00' and timestamp '{END}'"""))
def count_in_range(spark, d):
    return grid.count_in_range(points(spark, d), DATA_START, END, "hour")


@query("area_day_series", over_points(f"""
    select b.bucket, coalesce(c.n, 0) as count
    from (select unnest(generate_series(min(date_trunc('day', created_time)), max(date_trunc('day', created_time)),
                                        interval 1 day)) as bucket from points where {IN_AREA}) b
    left join (select date_trunc('day', created_time) as bucket, count(*) as n from points where {IN_AREA}
               group by 1) c on b.bucket = c.bucket"""))
def area_day_series(spark, d):
    return grid.series(grid.in_area(points(spark, d), AREA), "day", fill_gaps=True)


@query("geohash_grid", over_points(f"""
    select {sql_geohash(6)} as cell, count(*) as count from points
    where {IN_TIME} and {IN_AREA} group by 1 order by count desc, cell limit 10000"""))
def geohash_grid(spark, d):
    return grid.busiest_cells(grid.in_area(grid.in_range(points(spark, d), START, END), AREA))


@query("grid_by_day", over_points(f"""
    select {sql_geohash(7)} as cell, date_trunc('day', created_time) as day, count(*) as count
    from points where {IN_AREA} group by 1, 2"""))
def grid_by_day(spark, d):
    return grid.cells_by_day(grid.in_area(points(spark, d), AREA), DAY_GRID_PRECISION)


@query("distinct_buckets", over_points(f"""
    select distinct date_trunc('day', created_time) as day from points where {IN_AREA}"""))
def distinct_buckets(spark, d):
    area = grid.in_area(points(spark, d), AREA)
    return area.select(timeops.floor_time("created_time", "day").alias("day")).distinct().orderBy("day")


TREND = """
    select t.term as {term}, t.total, date_trunc('hour', p.created_time) as bucket, count(*) as count
    from (select {term} as term, count(*) as total from {src} group by 1 order by total desc, term limit 5) t
    join {src} p on p.{term} = t.term group by 1, 2, 3"""


@query("trending_users", over_points(TREND.format(term="user_id", src="points")))
def trending_users(spark, d):
    return grid.trending(points(spark, d), "user_id")


@query("trending_tags", over_posts(
    TREND.format(term="tag", src="tagged"),
    "tagged as (select created_time, unnest(list_distinct(tags)) as tag from posts)"))
def trending_tags(spark, d):
    p = posts(spark, d).select("created_time", F.explode(F.array_distinct(hashtags("text"))).alias("tag"))
    return grid.trending(p, "tag", one_pass=True)


@query("analyze_area", over_points(f"""
    select 'series' as part, strftime(created_time, '%Y-%m-%d') as key, count(*) as count from points
    where {IN_AREA} group by 2
    union all
    select 'grid', {sql_geohash(6)}, count(*) from points where {IN_AREA} group by 2"""))
def analyze_area(spark, d):
    return grid.area_report(points(spark, d), AREA)


@query("recent_images", over_points(f"""
    select id, created_time, user_id, lat, lon, 'https://posts.example/p/' || id as link,
           'https://posts.example/img/' || id || '.jpg' as img_url
    from points where {IN_TIME} order by created_time desc, id limit 10"""))
def recent_images(spark, d):
    p = points(spark, d).select(
        "*", F.concat(F.lit("https://posts.example/p/"), "id").alias("link"),
        F.concat(F.lit("https://posts.example/img/"), "id", F.lit(".jpg")).alias("img_url"))
    return grid.recent(grid.in_range(p, START, END))


@query("tick_table", over_points("""
    select k as tick, timestamp '2024-01-01' + to_minutes(30 * k) as now, count(p.id) as count
    from (select unnest(generate_series(1, 1440)) as k) t
    left join points p on p.created_time between timestamp '2024-01-01' + to_minutes(30 * k) - interval 1 hour
                                             and timestamp '2024-01-01' + to_minutes(30 * k)
    group by k"""))
def tick_table(spark, d):
    return grid.ticks(points(spark, d), DATA_START, DATA_END, 1.0, 0.5)


@query("tick_bundle", over_points(f"""
    select 'series' as part, 'now' as key, count(*) as count from points
    where created_time between timestamp '2024-01-15 12:00:00' and timestamp '2024-01-15 12:30:00'
    union all
    select * from (select 'grid', {sql_geohash(6)} as cell, count(*) as n from points
      where created_time between timestamp '2024-01-14 12:30:00' and timestamp '2024-01-15 12:30:00' and {in_box_sql(CITY_BOX)}
      group by 2 order by n desc, cell limit 10000)
    union all
    select * from (select 'images', id, 1 from points
      where created_time between timestamp '2024-01-15 06:30:00' and timestamp '2024-01-15 12:30:00' order by created_time desc, id limit 10)"""))
def tick_bundle(spark, d):
    """What one tick shows, as one table."""
    p = points(spark, d).withColumns({"link": F.lit(""), "img_url": F.lit("")})
    b = grid.tick_bundle(p, "2024-01-15 12:30:00", 24.0, 6.0, CITY_BOX)
    one = F.lit(1).cast("bigint")
    return (
        b["series"].select(F.lit("series").alias("part"), F.lit("now").alias("key"), "count")
        .unionByName(b["grid"].select(F.lit("grid").alias("part"), F.col("cell").alias("key"), "count"))
        .unionByName(b["images"].select(F.lit("images").alias("part"), F.col("id").alias("key"), one.alias("count"))))


@query("head_messages", over_points("select id, lat, lon from points order by created_time, id limit 1000"))
def head_messages(spark, d):
    """The earliest posts as messages of a topic, written to a folder and read back."""
    head = files.head_by_time(points(spark, d), 1000).select("id", "lat", "lon")
    path = work_dir(spark, "messages")
    streams.write_messages(streams.to_messages(head, "posts"), path)
    rows = spark.read.text(f"{path}/topic=posts").select(F.from_json("value", "id string, lat double, lon double").alias("m"))
    return rows.select("m.*")


@query("square_grid", over_points("""
    select row, col, count(*) as count, round(39.236e0 + row * s.la, 6) as south, round(-76.72e0 + col * s.lo, 6) as west
    from (select cast(floor((lat - 39.236e0) / la) as bigint) as row, cast(floor((lon + 76.72e0) / lo) as bigint) as col
          from points, (select 0.2e0 / 69e0 as la, 0.2e0 / 69e0 / cos(radians(39.236e0)) as lo)
          where lat >= 39.236e0 and lat <= 39.373e0 and lon >= -76.72e0 and lon <= -76.6e0),
         (select 0.2e0 / 69e0 as la, 0.2e0 / 69e0 / cos(radians(39.236e0)) as lo) s
    group by row, col, s.la, s.lo"""))
def square_grid(spark, d):
    g = grid.square_grid(points(spark, d), CITY_BOX, 0.2)
    return g.select("row", "col", "count", F.round("south", 6).alias("south"), F.round("west", 6).alias("west"))


@query("cell_at_time", over_points(
    "select s.cell, s.bucket, coalesce(c.n, 0) as count, coalesce(c.n, 0) / 20e0 as opacity from spots s "
    "left join counts c on c.cell = s.cell and c.bucket = s.bucket",
    f"counts as (select {sql_geohash(6)} as cell, date_trunc('day', created_time) as bucket, count(*) as n from points group by 1, 2)",
    "spots as (select c.cell, d.bucket from (select distinct cell from counts) c, "
    "(select unnest(generate_series(a, b, interval 1 day)) as bucket from (select min(bucket) as a, max(bucket) as b from counts)) d)"))
def cell_at_time(spark, d):
    counts = grid.cells_by_day(points(spark, d), GRID_PRECISION).withColumnRenamed("day", "bucket")
    span = counts.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))  # one row: every day of the data
    days = F.sequence("a", "b", F.expr("interval 1 day"))
    spots = counts.select("cell").distinct().join(F.broadcast(span)).select("cell", F.explode(days).alias("bucket"))
    return grid.cell_at_time(counts, spots)


@query("geohash_decode", over_points(
    "select cell, n as count, round(-90 + y * 180e0 / 32768, 6) as south, round(-180 + x * 360e0 / 32768, 6) as west, "
    "round(-90 + (y + 1) * 180e0 / 32768, 6) as north, round(-180 + (x + 1) * 360e0 / 32768, 6) as east from c",
    f"""c as (select {sql_geohash(6)} as cell, count(*) as n,
         any_value(cast(floor((lon + 180e0) / 360e0 * 32768) as bigint)) as x,
         any_value(cast(floor((lat + 90e0) / 180e0 * 32768) as bigint)) as y from points group by 1)"""))
def geohash_decode(spark, d):
    c = grid.cells(points(spark, d), GRID_PRECISION).withColumn("b", geo.geohash_box("cell", GRID_PRECISION))
    return c.select("cell", "count", *[F.round(f"b.{k}", 6).alias(k) for k in ("south", "west", "north", "east")])


@query("grid_geojson", over_points(
    """select cell, n as count, 'Polygon' as kind, cast(unnest([0, 1, 2, 3, 4]) as integer) as corner,
       unnest([w, w, e, e, w]) as lon, unnest([s, n_, n_, s, s]) as lat from b""",
    f"""c as (select {sql_geohash(6)} as cell, count(*) as n,
         any_value(cast(floor((lon + 180e0) / 360e0 * 32768) as bigint)) as x,
         any_value(cast(floor((lat + 90e0) / 180e0 * 32768) as bigint)) as y from points group by 1)""",
    """b as (select cell, n, round(-180 + x * 360e0 / 32768, 6) as w, round(-180 + (x + 1) * 360e0 / 32768, 6) as e,
         round(-90 + y * 180e0 / 32768, 6) as s, round(-90 + (y + 1) * 180e0 / 32768, 6) as n_ from c)"""))
def grid_geojson(spark, d):
    feats = grid.cell_features(grid.cells(points(spark, d), GRID_PRECISION), GRID_PRECISION)
    shape = "struct<geometry:struct<type:string,coordinates:array<array<array<double>>>>>"
    read = feats.withColumn("f", F.from_json("feature", shape))
    return read.select(
        "cell", "count", F.col("f.geometry.type").alias("kind"),
        F.posexplode(F.col("f.geometry.coordinates")[0]).alias("corner", "p"),
    ).select("cell", "count", "kind", "corner", F.round(F.col("p")[0], 6).alias("lon"), F.round(F.col("p")[1], 6).alias("lat"))


@query("replay_schedule", over_points(f"""
    select id, round(date_diff('microsecond', timestamp '{DATA_START}', created_time) / {REPLAY_SPEED * 1e6}, 6) as release_sec,
           cast(floor(date_diff('microsecond', timestamp '{DATA_START}', created_time) / {REPLAY_SPEED * 1e6} / 10) as bigint) as slice
    from points"""))
def replay_schedule(spark, d):
    timed = files.release_times(points(spark, d), DATA_START, REPLAY_SPEED)
    return timed.select("id", F.round("release_sec", 6).alias("release_sec"),
                        F.floor(F.col("release_sec") / 10.0).cast("bigint").alias("slice"))


@query("json_roundtrip", over_posts("""
    select id, date_trunc('second', created_time) as created_time, lat, lon, text from posts"""))
def json_roundtrip(spark, d):
    out = work_dir(spark, "export")
    p = posts(spark, d)
    files.export_json(p.select(files.post_to_json(p).alias("p")).select("p.*"), out)
    return files.read_posts(spark, out)


@query("csv_roundtrip", over_points("select id, scrape, created_time, user_id, lat, lon from points"))
def csv_roundtrip(spark, d):
    out = work_dir(spark, "dsv")
    df = points(spark, d)
    files.write_dsv(df, out, "\t")
    return files.read_dsv(spark, out, df.schema, "\t")


@query("union_fill", over_points("""
    select id, lat, lon, null::bigint as user_id, 'a' as part from points
    union all
    select id, null, null, user_id, 'b' from points"""))
def union_fill(spark, d):
    p = points(spark, d)
    return files.union_fill(p.select("id", "lat", "lon", F.lit("a").alias("part")),
                            p.select("id", "user_id", F.lit("b").alias("part")))


@query("distinct_users", "select distinct user_id from events")
def distinct_users(spark, d):
    return table(spark, d, "events").select("user_id").distinct()


@query("sample_hash", over_points("select id, created_time from points where substr(md5(id), 1, 8) < '66666666'"))
def sample_hash(spark, d):
    """A repeatable 40 % sample."""
    return stats.hash_sample(points(spark, d), "id", 0.4).select("id", "created_time")


@query("days_except_first", over_points("""
    select distinct cast(created_time as date) as day from points
    except select min(cast(created_time as date)) from points"""))
def days_except_first(spark, d):
    days = points(spark, d).select(F.to_date("created_time").alias("day")).distinct()
    first = days.agg(F.min("day").alias("first"))
    return days.join(F.broadcast(first), F.col("day") > F.col("first")).select("day")
