"""Count window and event detection queries."""

from pyspark.sql import functions as F

from tidegrid.functions import timeops
from tidegrid.operators import detect, online
from tidegrid.operators.rank import count_windows
from tidegrid.plans.registry import query
from tidegrid.schema import ONLINE_MEMORY, ONLINE_VOTE
from tidegrid.sources.tables import caption, over_points, over_posts, place, points, table

WINDOWS_CTE = (
    "s as (select id, created_time, lat, lon, row_number() over (order by created_time, id) as seq, count(*) over () as n from points)",
    """w as materialized (select s.*, g.win, seq - (win * 1000 - 4000) as pos from s
         join (select cast(unnest(generate_series(4, (select max(n) // 1000 from s))) as bigint) as win) g
         on seq > win * 1000 - 4000 and seq <= win * 1000)""",
)
DETECT_CTE = (
    *WINDOWS_CTE,
    """r as materialized (select * from (select *, win * 4000 + pos as pid, epoch_us(created_time) / 1e6 as time,
         sum(case when pos <= 3000 then 1 else 0 end) over (partition by win order by lat) as filat,
         sum(case when pos <= 3000 then 1 else 0 end) over (partition by win order by lon) as filon from w) where pos > 3000)""",
    """z as materialized (select *, (filat - avg(filat) over v) / stddev_samp(filat) over v as x,
         (filon - avg(filon) over v) / stddev_samp(filon) over v as y, (time - avg(time) over v) / stddev_samp(time) over v as t
         from r window v as (partition by win))""",
    """k as materialized (select a.pid, count(*) - 1 as n_close from z a join z b on a.win = b.win
         where (exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) + exp(-pow(a.t - b.t, 2))) / 2 > 0.85e0 group by 1)""",
    """c as materialized (select r.pid, r.win, (lat - avg(lat) over v) / stddev_samp(lat) over v as x,
         (lon - avg(lon) over v) / stddev_samp(lon) over v as y from r join k using (pid) where n_close > 25 window v as (partition by win))""",
    """e as materialized (select win, a.pid as u, b.pid as v from c a join c b using (win)
         where pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.1e0 * 0.1e0)""",
    "core as materialized (select u from e group by u having count(*) >= 10)",
    "ce as materialized (select u, v from e where u in (select u from core) and v in (select u from core))",
    "reach as (select u, v from ce union select r.u, ce.v from reach r join ce on ce.u = r.v)",
    "comp as (select u as pid, min(v) as c from reach group by u)",
    "named as (select pid, dense_rank() over (partition by win order by c) as cl from comp join r using (pid))",
    "det as materialized (select r.*, coalesce(n_close, 0) as n_close, coalesce(cl, 0) as cl from r left join k using (pid) left join named using (pid))",
)


@query("count_window_blocks", over_points("select win, pos, seq, id from w", *WINDOWS_CTE))
def count_window_blocks(spark, d):
    w = count_windows(points(spark, d).select("id", "created_time"), ["created_time", "id"], 4000, 1000)
    return w.select("win", "pos", "seq", "id")


@query("detect_events", over_points("select win, id, n_close, cl from det", *DETECT_CTE).replace("with ", "with recursive ", 1))
def detect_events(spark, d):
    return detect.detect_events(points(spark, d)).select("win", "id", "n_close", "cl")


@query("event_summary", over_posts(
    """select win, cl, posts, round(south, 6) as lat_min, round(north, 6) as lat_max, round(west, 6) as lon_min, round(east, 6) as lon_max, tags
       from (select win, cl, count(*) as posts, min(lat) as south, max(lat) as north, min(lon) as west, max(lon) as east from det where cl > 0 group by 1, 2)
       join (select win, cl, string_agg(tag || ':' || n, ' ' order by rk) as tags from (
               select win, cl, tag, count(*) as n, row_number() over (partition by win, cl order by count(*) desc, tag) as rk
               from (select win, cl, unnest(tags) as tag from det join posts using (id) where cl > 0) group by 1, 2, 3) where rk <= 10 group by 1, 2)
       using (win, cl)""", *DETECT_CTE).replace("with ", "with recursive ", 1))
def event_summary(spark, d):
    found = detect.detect_events(points(spark, d))
    members = found.where("cl <> 0").select("id").distinct()
    p = place(table(spark, d, "events"))
    return flat_events(detect.event_summary(found, caption(p.join(members, "id", "left_semi"), table(spark, d, "documents")), ["win"]))


def flat_events(ev):
    """Events with rounded ranges and their tags as one text, as the oracle gives them."""
    tags = F.array_join(F.transform("hashtags", lambda t: F.concat(t["tag"], F.lit(":"), t["n"].cast("string"))), " ")
    r = lambda c: F.round(c, 6)
    return ev.select("win", "cl", "posts", r("lat.min").alias("lat_min"), r("lat.max").alias("lat_max"),
                     r("lon.min").alias("lon_min"), r("lon.max").alias("lon_max"), tags.alias("tags"))


@query("online_vote", over_points(
    "select id, seq, n_close, coalesce(cl, 0) as cl from n left join lab using (seq)",
    """s as materialized (select id, lat, lon, ntime, seq, stddev_samp(lat) over w as sx, stddev_samp(lon) over w as sy, stddev_samp(ntime) over w as st
         from (select id, lat, lon, epoch_us(created_time) / 86400e6 as ntime, row_number() over (order by created_time, id) as seq from points)
         window w as (order by seq rows between 2000 preceding and current row))""",
    """c as materialized (select a.seq as p, b.seq as q from s a join s b on b.seq < a.seq and b.seq >= a.seq - 2000 where a.seq > 2000
         and (exp(-(pow((a.lat - b.lat) / a.sx, 2) + pow((a.lon - b.lon) / a.sy, 2))) + exp(-pow((a.ntime - b.ntime) / a.st, 2))) / 2 > 0.95e0)""",
    "n as materialized (select s.id, s.seq, coalesce(k.n, 0) as n_close from s left join (select p, count(*) as n from c group by 1) k on k.p = s.seq)",
    "e as materialized (select p, q from c where p in (select seq from n where n_close > 30) and q in (select seq from n where n_close > 30))",
    """op as materialized (select seq, cast(row_number() over (order by seq) as varchar) as cl from n
         where n_close > 30 and seq not in (select p from e))""",
    "reach as (select seq, cl from op union select e.p, r.cl from reach r join e on e.q = r.seq)",
    "lab as (select seq, cast(max(cl) as bigint) as cl from reach group by seq)").replace("with ", "with recursive ", 1))
def online_vote(spark, d):
    """Every post votes against the 2000 posts before it."""
    p = points(spark, d).select("id", "created_time", "lat", "lon", timeops.days("created_time").alias("ntime"))
    v = ONLINE_VOTE
    return online.online_votes(p, ["created_time", "id"], ["lat", "lon", "ntime"], ONLINE_MEMORY, v.sigma, v.close, v.dense)
