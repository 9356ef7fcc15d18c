"""Statistics queries over lineitem, orders, events and posts."""

import datetime as dt

from pyspark.sql import functions as F

from tidegrid.functions import binning, containers, timeops
from tidegrid.operators import grid, stats
from tidegrid.plans.grid import sql_geohash
from tidegrid.plans.registry import query
from tidegrid.sources.tables import over_points, points, table

TYPES = ["click", "error", "purchase", "signup", "view"]
PRICE_EDGES = [1000.0, 5000.0, 20000.0, 50000.0, 90000.0]
EDGE_SQL = "[1000e0, 5000e0, 20000e0, 50000e0, 90000e0]"


def li(spark, d):
    return table(spark, d, "lineitem")


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


@query("extent", """select l_returnflag, min(l_extendedprice) as min, max(l_extendedprice) as max
    from lineitem group by l_returnflag""")
def extent(spark, d):
    return stats.extent(li(spark, d), "l_extendedprice", ["l_returnflag"])


@query("sum_mean", """
    select event_type, cast(sum(k) as double) as sum, round(avg(k), 6) as mean, count(k) as n
    from (select event_type, try_cast(json_extract_string(props, '$.k') as double) as k from events) group by 1""")
def sum_mean(spark, d):
    e = table(spark, d, "events")
    out = stats.sum_mean(e, F.get_json_object("props", "$.k"), ["event_type"])
    return out.withColumn("mean", F.round("mean", 6))


@query("quantiles", """
    select l_returnflag, count(*) as n, round(quantile_cont(l_extendedprice, 0.1), 6) as p10,
           round(quantile_cont(l_extendedprice, 0.5), 6) as median, round(quantile_cont(l_extendedprice, 0.99), 6) as p99
    from lineitem group by 1""")
def quantiles(spark, d):
    q = stats.quantiles(li(spark, d), "l_extendedprice", [0.1, 0.5, 0.99], ["l_returnflag"])
    return q.select("l_returnflag", "n", F.round("q0", 6).alias("p10"), F.round("q1", 6).alias("median"),
                    F.round("q2", 6).alias("p99"))


@query("bisect", f"""
    select b_left as "left", b_right as "right", count(*) as n from (
      select cast(len(list_filter([1, 5, 10, 25, 50], lambda e: e < l_quantity)) as integer) as b_left,
             cast(len(list_filter([1, 5, 10, 25, 50], lambda e: e <= l_quantity)) as integer) as b_right from lineitem)
    group by 1, 2""")
def bisect(spark, d):
    edges = F.array(*[F.lit(float(e)) for e in (1, 5, 10, 25, 50)])
    q = F.col("l_quantity")
    return li(spark, d).groupBy(binning.bisect_left(edges, q).alias("left"), binning.bisect_right(edges, q).alias("right")).agg(
        F.count("*").alias("n"))


@query("threshold_class", f"""
    select cast(len(list_filter({EDGE_SQL}, lambda e: e <= l_extendedprice)) as integer) as class, count(*) as n
    from lineitem group by 1""")
def threshold_class(spark, d):
    return li(spark, d).groupBy(binning.threshold_class(F.col("l_extendedprice"), PRICE_EDGES).alias("class")).agg(
        F.count("*").alias("n"))


@query("quantize_class", """
    select cast(greatest(least(floor(l_extendedprice / 100000e0 * 7e0), 6), 0) as integer) as class, count(*) as n
    from lineitem group by 1""")
def quantize_class(spark, d):
    c = binning.quantize_class(F.col("l_extendedprice"), F.lit(0.0), F.lit(100000.0), 7)
    return li(spark, d).groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query("quantile_class", """
    select cast(len(list_filter(q, lambda e: e <= o_totalprice)) as integer) as class, count(*) as n
    from orders, (select quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) as q from orders) group by 1""")
def quantile_class(spark, d):
    o = table(spark, d, "orders")
    q = stats.quantiles(o, "o_totalprice", [0.2, 0.4, 0.6, 0.8])
    edges = q.select(F.array("q0", "q1", "q2", "q3").alias("edges"))
    return o.join(F.broadcast(edges)).groupBy(binning.bisect_right(F.col("edges"), F.col("o_totalprice")).alias("class")).agg(
        F.count("*").alias("n"))


@query("nest_rollup", """
    select o_orderpriority, o_orderstatus, count(*) as orders, round(sum(o_totalprice), 2) as total
    from orders group by 1, 2""")
def nest_rollup(spark, d):
    o = table(spark, d, "orders")
    nested = stats.nest(o, "o_orderpriority", "o_orderstatus", orders=F.count("*"), total=F.sum("o_totalprice"))
    flat = nested.select("o_orderpriority", F.explode("values").alias("v")).select("o_orderpriority", "v.*")
    return flat.withColumn("total", F.round("total", 2))


HIST = """
    select b.bin, round(lo + (hi - lo) / k * b.bin, 6) as x, round((hi - lo) / k, 6) as dx,
           coalesce(c.n, 0) as frequency, round(coalesce(c.n, 0) / l.n, 6) as probability
    from l, (select unnest(generate_series(0, (select k - 1 from l))) as bin) b
    left join (select least(cast(floor((l_extendedprice - lo) / (hi - lo) * k) as bigint), k - 1) as bin, count(*) as n
               from lineitem, l group by 1) c on c.bin = b.bin"""


@query("histogram_sturges", """
    with l as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi, count(*) as n,
                      cast(ceil(log2(count(*))) + 1 as bigint) as k from lineitem)""" + HIST)
def histogram_sturges(spark, d):
    return stats.histogram(li(spark, d), "l_extendedprice").select("bin", "frequency", *r6("x", "dx", "probability"))


@query("time_histogram", over_points(
    """select b.bin, coalesce(c.n, 0) as count from (select unnest(generate_series(0, 999)) as bin) b left join
       (select least(cast(floor((s - lo) / (hi - lo) * 1000) as bigint), 999) as bin, count(*) as n from t, l group by 1) c
       on c.bin = b.bin""",
    "t as (select date_diff('microsecond', timestamp '1970-01-01', created_time) / 1e6 as s from points)",
    "l as (select min(s) as lo, max(s) as hi from t)"))
def time_histogram(spark, d):
    p = points(spark, d).select(timeops.seconds("created_time").alias("s"))
    return stats.histogram(p, "s", 1000).select("bin", F.col("frequency").alias("count"))


@query("cumulative_bins", over_points(
    """select id, least(cast(floor((lat - lo) / (hi - lo) * 1000) as bigint), 999) as bin, c.total
       from points, l join c on c.bin = least(cast(floor((lat - lo) / (hi - lo) * 1000) as bigint), 999)""",
    "l as (select min(lat) as lo, max(lat) as hi from points)",
    """c as (select bin, cast(sum(count(*)) over (order by bin) as bigint) as total from
         (select least(cast(floor((lat - lo) / (hi - lo) * 1000) as bigint), 999) as bin from points, l) group by bin)"""))
def cumulative_bins(spark, d):
    return stats.cumulative_bins(points(spark, d).select("id", "lat"), "lat", 1000, "total").select("id", "bin", "total")


@query("nested_bins_by_day", over_points(
    """select k.*, d.day, coalesce(c.n, 0) as count from (select distinct lat_bin, lon_bin, lat_sub, lon_sub from c) k,
       (select unnest(generate_series(min(day), max(day), interval 1 day))::date as day from c) d
       left join c on c.day = d.day and c.lat_bin = k.lat_bin and c.lon_bin = k.lon_bin and c.lat_sub = k.lat_sub and c.lon_sub = k.lon_sub""",
    "l as (select min(lat) as a, max(lat) as b, min(lon) as c, max(lon) as d from points)",
    """o as (select lat, lon, created_time, least(cast(floor((lat - a) / (b - a) * 10) as bigint), 9) as lat_bin,
         least(cast(floor((lon - c) / (d - c) * 10) as bigint), 9) as lon_bin from points, l)""",
    """m as (select lat_bin, lon_bin, min(lat) as a, max(lat) as b, min(lon) as c, max(lon) as d from o group by 1, 2)""",
    """c as (select o.lat_bin, o.lon_bin,
         case when b = a then 0 else least(cast(floor((lat - a) / (b - a) * 3) as bigint), 2) end as lat_sub,
         case when d = c then 0 else least(cast(floor((lon - c) / (d - c) * 3) as bigint), 2) end as lon_sub,
         cast(created_time as date) as day, count(*) as n
         from o join m on m.lat_bin = o.lat_bin and m.lon_bin = o.lon_bin group by 1, 2, 3, 4, 5)"""))
def nested_bins_by_day(spark, d):
    counts = stats.nested_bins(points(spark, d).select("lat", "lon", "created_time"))
    return stats.zero_filled_days(counts, ["lat_bin", "lon_bin", "lat_sub", "lon_sub"])


@query("day_distance", over_points(
    """select a.day as day_a, b.day as day_b, round(sqrt(sum(pow(coalesce(x.n, 0) - coalesce(y.n, 0), 2))), 6) as distance
       from (select distinct day from c) a join (select distinct day from c) b on a.day < b.day
       cross join (select distinct cell from c) k
       left join c x on x.cell = k.cell and x.day = a.day left join c y on y.cell = k.cell and y.day = b.day
       group by 1, 2""",
    f"c as (select {sql_geohash(6)} as cell, strftime(created_time, '%Y-%m-%d') as day, count(*) as n from points group by 1, 2)"))
def day_distance(spark, d):
    by_day = grid.cells_by_day(points(spark, d), 6).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    ends = points(spark, d).agg(F.min("created_time").alias("a"), F.max("created_time").alias("b")).first()
    first = ends["a"].date()
    days = [str(first + dt.timedelta(days=i)) for i in range((ends["b"].date() - first).days + 1)]
    return stats.day_distances(by_day, "cell", "day", days).withColumn("distance", F.round("distance", 6))


@query("pivot_transpose", "select user_id, " + ", ".join(
    f"count(*) filter (where event_type = '{t}') as {t}" for t in TYPES) + " from events group by 1")
def pivot_transpose(spark, d):
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return stats.transpose(counts, "user_id", "event_type", "n")


@query("consecutive_pairs", """
    select user_id, event_id, prev_event_id, round(date_diff('microsecond', prev_ts, ts) / 1e6, 6) as gap_sec from (
      select user_id, event_id, ts, lag(event_id) over w as prev_event_id, lag(ts) over w as prev_ts from events
      window w as (partition by user_id order by ts, event_id)) where prev_event_id is not null""")
def consecutive_pairs(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    p = stats.pairs(e, ["ts", "event_id"], ["event_id", "ts"], ["user_id"])
    gap = F.round(timeops.seconds("ts") - timeops.seconds("prev_ts"), 6)
    return p.select("user_id", "event_id", "prev_event_id", gap.alias("gap_sec"))


@query("hash_shuffle", """
    select event_id, event_type, row_number() over (order by md5(concat(event_id, ':7')), event_id) as place from events""")
def hash_shuffle(spark, d):
    return stats.shuffled(table(spark, d, "events").select("event_id", "event_type"), "event_id", 7)


TYPE_COUNTS = "c as (select user_id, event_type, count(*) as n from events group by 1, 2)"


@query("map_entries", f"""
    with {TYPE_COUNTS}
    select user_id, string_agg(event_type, ',' order by event_type) as keys, string_agg(n, ',' order by event_type) as counts,
           cast(count(*) as integer) as size, bool_or(event_type = 'purchase') as bought from c group by 1""")
def map_entries(spark, d):
    """Each user's map of event types to counts, taken apart again."""
    m = containers.map_of(table(spark, d, "events"), ["user_id"], "event_type", F.count("*"))
    return m.select(
        "user_id", F.array_join(containers.keys("map"), ",").alias("keys"),
        F.array_join(F.transform(containers.values("map"), lambda v: v.cast("string")), ",").alias("counts"),
        F.size("map").alias("size"), containers.has("map", "purchase").alias("bought"))


@query("map_overlay", f"""
    with {TYPE_COUNTS}, t as (select unnest(['click', 'error', 'never', 'view']) as event_type, -1 as n),
    u as (select distinct user_id from c),
    b as (select user_id, event_type, coalesce(c.n, x.least) as n
          from (select user_id, event_type, t.n as least from u, t) x left join c using (user_id, event_type)
          union select * from c)
    select user_id, event_type as key, n as value from b where event_type <> 'error'""")
def map_overlay(spark, d):
    """Counts laid over a map of fallbacks, without one key."""
    m = containers.map_of(table(spark, d, "events"), ["user_id"], "event_type", F.count("*"))
    fallback = F.create_map(*[x for t in ("click", "error", "never", "view") for x in (F.lit(t), F.lit(-1).cast("bigint"))])
    both = containers.without(containers.overlaid(fallback, "map"), "error")
    return m.select("user_id", F.explode(containers.entries(both)).alias("e")).select("user_id", "e.key", "e.value")


@query("array_zip", """
    with l as (select l_orderkey, l_linenumber, l_quantity, row_number() over (partition by l_orderkey order by l_linenumber) as i,
                      row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber desc) as j,
                      count(*) over (partition by l_orderkey) as n from lineitem)
    select a.l_orderkey as order_key, cast(a.i - 1 as integer) as place, a.l_linenumber as line, b.l_quantity as quantity
    from l a join l b on a.l_orderkey = b.l_orderkey and a.i = b.j where a.i <= greatest(1, a.n - 1)""")
def array_zip(spark, d):
    """The lines of each order beside its largest quantities; the second list is one shorter (of a single line it is not)."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(  # an order has at most seven lines
        F.array_sort(F.collect_list("l_linenumber")).alias("lines"),
        F.sort_array(F.collect_list(F.struct("l_quantity", "l_linenumber")), asc=False).alias("large"))
    top = F.transform(F.slice("large", F.lit(1), F.greatest(F.size("large") - 1, F.lit(1))), lambda q: q["l_quantity"])
    z = lines.select(F.col("l_orderkey").alias("order_key"), F.posexplode(containers.zipped("lines", top)).alias("place", "z"))
    return z.select("order_key", "place", F.col("z.f0").alias("line"), F.col("z.f1").alias("quantity"))


@query("array_merge_range", """
    select p_partkey as part, value from (
      select p_partkey, unnest(list_transform(range(0, cast(ceil((p_size - 0.5e0) / 2.5e0) as bigint)), lambda i: 0.5e0 + i * 2.5e0)) as value from part
      union all
      select p_partkey, unnest(list_transform(range(0, cast(ceil(p_size / 10e0) as bigint)), lambda i: p_size - i * 10e0)) as value from part)""")
def array_merge_range(spark, d):
    """An upward and a downward range per part, merged into one list."""
    up = containers.span(0.5, F.col("p_size").cast("double"), 2.5)
    down = containers.span(F.col("p_size").cast("double"), 0.0, -10.0)
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("part"), containers.merged(F.array(up, down)).alias("all"))
    return rows.select("part", F.explode("all").alias("value"))


STACK = """
    n as (select date_trunc('day', ts) as day, event_type, count(*)::double as y from events group by 1, 2),
    f as (select d.day, t.event_type, coalesce(n.y, 0) as y from (select distinct day from n) d
          cross join (select distinct event_type from n) t left join n on n.day = d.day and n.event_type = t.event_type),
    g as (select *, sum(y) over (partition by day) as total,
                 coalesce(sum(y) over (partition by day order by event_type rows between unbounded preceding and 1 preceding), 0) as below,
                 lag(y) over (partition by event_type order by day) as py, lag(day) over (partition by event_type order by day) as pd from f),
    s as (select *, (y - py) / (epoch(day) - epoch(pd)) as slope from g),
    w as (select day, any_value(total) as total, sum((coalesce(ps, 0) + slope / 2) * y) as moment, any_value(epoch(day) - epoch(pd)) as dx
          from (select *, sum(slope) over (partition by day order by event_type rows between unbounded preceding and 1 preceding) as ps from s) group by day),
    o as (select day, sum(coalesce(-moment / total * dx, 0)) over (order by day) as o from w),
    b as (select day, o - least(0, (select min(o) from o)) as base from o)"""


@query("stack_offsets", f"""with {STACK}
    select 'zero' as kind, day, event_type, y, round(below, 6) as y0 from g
    union all select 'expand', day, event_type, round(y / total, 6), round(below / total, 6) from g
    union all select 'silhouette', day, event_type, y, round((select max(total) from g) / 2 - total / 2 + below, 6) from g
    union all select 'wiggle', g.day, event_type, y, round(base + below, 6) from g join b on b.day = g.day""")
def stack_offsets(spark, d):
    day = timeops.floor_time("ts", "day")
    n = table(spark, d, "events").groupBy(day.alias("day"), "event_type").agg(F.count("*").alias("y"))
    parts = [
        stats.stacked(n, "day", "event_type", "y", None, kind).withColumn("kind", F.lit(kind))
        for kind in ("zero", "expand", "silhouette", "wiggle")
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("kind", "day", "event_type", *r6("y", "y0"))


@query("box_stats", """
    select o_orderpriority, count(*) as n, round(q[1], 6) as q1, round(q[2], 6) as q2, round(q[3], 6) as q3,
           min(o_totalprice) filter (where inside) as low, max(o_totalprice) filter (where inside) as high,
           count(*) filter (where not inside) as outliers
    from (select *, o_totalprice between q[1] - 0.8 * (q[3] - q[1]) and q[3] + 0.8 * (q[3] - q[1]) as inside
          from orders join (select o_orderpriority, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) as q from orders group by 1)
          using (o_orderpriority)) group by o_orderpriority, q""")
def box_stats(spark, d):
    b = stats.box_stats(table(spark, d, "orders").select("o_orderpriority", "o_totalprice"), "o_totalprice", ["o_orderpriority"], 0.8)
    return b.select("o_orderpriority", "n", F.round("q0", 6).alias("q1"), F.round("q1", 6).alias("q2"),
                    F.round("q2", 6).alias("q3"), "low", "high", "outliers")


@query("qq_pairs", """
    with r as (select l_returnflag as g, l_extendedprice as v, row_number() over (partition by l_returnflag order by l_extendedprice) as rn,
                      count(*) over (partition by l_returnflag) as m from lineitem where l_returnflag in ('A', 'R')),
         i as (select cast(unnest(generate_series(0, 199)) as integer) as i)
    select i.i, max(case when g = 'A' then v end) as x, max(case when g = 'R' then v end) as y
    from i join r on r.rn = cast(floor(i.i * (m - 1) / 200) as bigint) + 1 group by 1""")
def qq_pairs(spark, d):
    return stats.qq_pairs(li(spark, d), "l_extendedprice", "l_returnflag", "A", "R", 200)


@query("horizon_bands", """
    with s as (select c_custkey, c_acctbal, abs(c_acctbal) / (select max(abs(c_acctbal)) from customer) * 4 as s from customer)
    select c_custkey, c_acctbal, band, c_acctbal < 0 as negative, round(least(greatest(s - band, 0), 1), 6) as part,
           round(case when c_acctbal < 0 then 1 - least(greatest(s - band, 0), 1) else 0 end, 6) as base
    from s, (select cast(unnest(generate_series(0, 3)) as integer) as band) where s - band > 0""")
def horizon_bands(spark, d):
    h = stats.horizon_bands(table(spark, d, "customer"), "c_custkey", "c_acctbal", 4)
    return h.select("c_custkey", "c_acctbal", "band", "negative", *r6("part", "base"))


@query("set_union", "select c_nationkey as k from customer union select s_nationkey from supplier")
def set_union(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return a.union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("set_intersect", "select c_nationkey as k from customer intersect select s_nationkey from supplier")
def set_intersect(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return a.intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("set_except", """
    select o_custkey as k from orders where not exists (
      select 1 from customer where c_custkey = o_custkey and c_mktsegment = 'BUILDING')""")
def set_except(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    return stats.difference(a, b, ["k"])


@query("count_by", "select event_type, count(*) as count from events group by 1")
def count_by(spark, d):
    return stats.count_by(table(spark, d, "events"), "event_type")


@query("index_by", """
    select user_id, event_id, event_type, ts from (
      select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1""")
def index_by(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return stats.index_by(e, "user_id", ["ts", "event_id"])


@query("partition_split", """
    select case when value > 50 then 'hit' else 'rest' end as side, event_type, count(*) as n from events group by 1, 2""")
def partition_split(spark, d):
    hit, rest = stats.split_by(table(spark, d, "events"), F.col("value") > 50)
    both = hit.withColumn("side", F.lit("hit")).unionByName(rest.withColumn("side", F.lit("rest")))
    return both.groupBy("side", "event_type").agg(F.count("*").alias("n"))


@query("defaults_fill", """
    select d.doc_id, coalesce(l.quality, -1) as quality, coalesce(l.toxic, -1) as toxic
    from documents d left join labels l on l.doc_id = d.doc_id""")
def defaults_fill(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return stats.with_defaults(docs.join(table(spark, d, "labels"), "doc_id", "left"), quality=-1, toxic=-1)


@query("last_n_points", """
    select event_type, bucket, count from (
      select *, row_number() over (partition by event_type order by bucket desc) as rn from (
        select event_type, date_trunc('hour', ts) as bucket, count(*) as count from events group by 1, 2)) where rn <= 50""")
def last_n_points(spark, d):
    from tidegrid.operators.rank import last_n

    e = table(spark, d, "events").groupBy("event_type", timeops.floor_time("ts", "hour").alias("bucket")).agg(F.count("*").alias("count"))
    return last_n(e, ["event_type"], [F.desc("bucket")], 50)
