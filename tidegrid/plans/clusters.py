"""Density grid, k-means, decayed grid, micro-cluster, purity and colour queries."""

from pyspark.sql import functions as F

from tidegrid.functions import timeops
from tidegrid.operators import clusters, images
from tidegrid.operators.rank import rank_scaled, scaled_min_max, standardised
from tidegrid.plans.registry import query
from tidegrid.sources.tables import over_points, points, table


@query("grid_kde", over_points(
    "select g0, g1, g2, round(v, 6) as density from f where v > (select quantile_cont(v, 0.99) from f)",
    """u as (select (row_number() over (order by lon, id) - 1) / (count(*) over () - 1) as a,
         (epoch_us(created_time) - min(epoch_us(created_time)) over ()) / (max(epoch_us(created_time)) over () - min(epoch_us(created_time)) over ()) as b,
         (row_number() over (order by lat, id) - 1) / (count(*) over () - 1) as c, count(*) over () as total from points)""",
    """n as materialized (select least(cast(floor(a * 20) as bigint), 19) as b0, least(cast(floor(b * 20) as bigint), 19) as b1,
         least(cast(floor(c * 20) as bigint), 19) as b2, count(*) as n, any_value(total) as total from u group by 1, 2, 3)""",
    "g as (select unnest(generate_series(0, 19)) as g)",
    """f as materialized (select x.g as g0, y.g as g1, z.g as g2,
         coalesce(sum(n / total * exp(-(pow(x.g - b0, 2) + pow(y.g - b1, 2) + pow(z.g - b2, 2)) / 2)), 0) as v
         from g x cross join g y cross join g z left join n on true group by 1, 2, 3)"""))
def grid_kde(spark, d):
    p = points(spark, d).select("id", "lat", "lon", timeops.seconds("created_time").alias("time"))
    p = scaled_min_max(rank_scaled(p, ["lat", "lon"], "id"), ["time"])
    f = clusters.grid_density(p, ["r_lon", "s_time", "r_lat"], 20, 1.0)
    top = clusters.densest_cells(f, 3, 20, 0.01)
    return top.withColumn("density", F.round("density", 6))


def scaled(spark, d):
    p = points(spark, d).select("id", "created_time", "lat", "lon", timeops.days("created_time").alias("ntime"))
    return standardised(p, ["lat", "lon"])


SCALED = """z as materialized (select id, epoch_us(created_time) / 86400e6 as ntime, (lat - avg(lat) over ()) / stddev_samp(lat) over () as x,
    (lon - avg(lon) over ()) / stddev_samp(lon) over () as y from points)"""


@query("sample_kmeans")
def sample_kmeans(spark, d):
    return clusters.sample_kmeans(scaled(spark, d), ["z_lat", "z_lon"], "id").select("id", "cl")


@query("window_kmeans")
def window_kmeans(spark, d):
    return clusters.recent_kmeans(scaled(spark, d), ["z_lat", "z_lon"], ["created_time", "id"]).select("id", "cl")


CELLS = """cells as materialized (select cast(floor(x / {side}) as bigint) as c0, cast(floor(y / {side}) as bigint) as c1, count(*) as n,
    sum(pow(0.9e0, now - ntime)) as weight, sum(pow(0.9e0, now - ntime) * x) as s0, sum(pow(0.9e0, now - ntime) * y) as s1,
    sum(pow(0.9e0, now - ntime) * x * x) as ss0, sum(pow(0.9e0, now - ntime) * y * y) as ss1
    from z, (select max(ntime) as now from z) group by 1, 2)"""


@query("decayed_grid_density", over_points(
    "select c.c0, c.c1, n, round(weight, 6) as weight, coalesce(cl, 0) as cl from cells c left join named using (c0, c1)",
    SCALED, CELLS.format(side="0.7e0"),
    # Dense means above the mean cell weight.
    "solid as materialized (select c0, c1, row_number() over (order by c0, c1) as i from cells where weight >= 0.0005e0 * (select count(*) from z))",
    """e as materialized (select a.i as u, b.i as v from solid a join solid b on abs(a.c0 - b.c0) + abs(a.c1 - b.c1) = 1)""",
    "reach as (select i as u, i as v from solid union select r.u, e.v from reach r join e on e.u = r.v)",
    "named as (select c0, c1, dense_rank() over (order by c) as cl from solid join (select u, min(v) as c from reach group by 1) on u = i)")
    .replace("with ", "with recursive ", 1))
def decayed_grid_density(spark, d):
    z = scaled(spark, d)
    dense = 0.0005 * z.count()
    g = clusters.decayed_grid(z, ["z_lat", "z_lon"], 0.7, "ntime", 0.9, dense)
    return g.select("c0", "c1", "n", F.round("weight", 6).alias("weight"), "cl")


@query("micro_clusters", over_points(
    """select m.c0, m.c1, n, round(weight, 6) as weight, round(m0, 6) as m0, round(m1, 6) as m1, round(spread, 5) as spread,
       coalesce(cl, 0) as cl from m left join named using (i)""",
    SCALED, CELLS.format(side="0.2e0"),
    """m as materialized (select *, row_number() over (order by c0, c1) as i, s0 / weight as m0, s1 / weight as m1,
         sqrt(greatest(ss0 / weight - pow(s0 / weight, 2) + ss1 / weight - pow(s1 / weight, 2), 0)) as spread from cells)""",
    "e as materialized (select a.i as u, b.i as v, b.weight as w from m a join m b on pow(a.m0 - b.m0, 2) + pow(a.m1 - b.m1, 2) <= 0.25e0 * 0.25e0)",
    "core as materialized (select u from e group by u having sum(w) >= 0.001e0 * (select count(*) from z))",
    "ce as materialized (select u, v from e where u in (select u from core) and v in (select u from core))",
    "reach as (select u, v from ce union select r.u, ce.v from reach r join ce on ce.u = r.v)",
    "named as (select u as i, dense_rank() over (order by c) as cl from (select u, min(v) as c from reach group by 1))")
    .replace("with ", "with recursive ", 1))
def micro_clusters(spark, d):
    z = scaled(spark, d)
    m = clusters.micro_clusters(z, ["z_lat", "z_lon"], 0.2, "ntime", 0.9, 0.25, 0.001 * z.count())
    return m.select("c0", "c1", "n", F.round("weight", 6).alias("weight"), F.round("m0", 6).alias("m0"), F.round("m1", 6).alias("m1"),
                    F.round("spread", 5).alias("spread"), "cl")


@query("cluster_purity", """
    with x as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
    c as (select label as cl, i, avg(x) as m from x group by 1, 2),
    dd as (select vec_id, any_value(label) as label, cl, sum(pow(x - m, 2)) as d2 from x join c using (i) group by vec_id, cl),
    a as (select vec_id, any_value(label) as label, arg_min(cl, {d: d2, c: cl}) as cl from dd group by vec_id),
    n as (select cl, label, count(*) as n from a group by 1, 2)
    select cl, cast(sum(n) as bigint) as size, arg_max(label, {n: n, l: -label}) as main, round(max(n) / sum(n), 6) as purity from n group by 1""")
def cluster_purity(spark, d):
    e = table(spark, d, "embeddings")
    assigned = clusters.nearest_centre(e, "embedding", clusters.mean_vectors(e, "embedding", "label").withColumnRenamed("label", "k"), "k")
    return clusters.purity(assigned, "label").withColumn("purity", F.round("purity", 6))


@query("color_histogram", """
    with b as (select doc_id, hex(encode(text)) as h from documents),
    v as (select doc_id, i, ('0x' || substr(h, cast(2 * i + 1 as bigint), 2))::integer as v
          from (select doc_id, h, unnest(range(0, length(h) // 2)) as i from b)),
    c as (select doc_id, 5 * (2 - i % 3) + v * 5 // 256 as f, count(*) as n from v group by 1, 2)
    select d.doc_id, cast(g.f as integer) as feature, coalesce(c.n, 0) / octet_length(encode(d.text)) as value
    from documents d cross join (select unnest(range(0, 15)) as f) g left join c on c.doc_id = d.doc_id and c.f = g.f""")
def color_histogram(spark, d):
    """Document bytes read as three-channel pixels, stored blue first."""
    pixels = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    h = images.color_histogram(pixels, "doc_id")
    return h.select("doc_id", F.posexplode("features").alias("feature", "value"))
