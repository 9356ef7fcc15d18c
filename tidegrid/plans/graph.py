"""Graph and hierarchy queries: trade flows from orders, session chains from events, the region tree."""

from pyspark.sql import functions as F

from tidegrid.functions import timeops
from tidegrid.operators import graph
from tidegrid.operators.rank import previous
from tidegrid.plans.registry import query
from tidegrid.session import stage
from tidegrid.sources.tables import table

FLOWS = """flows as (select c_nationkey as src, s_nationkey as dst, l_quantity as value, o_orderdate, l_orderkey, l_linenumber, l_suppkey
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey)"""


def trades(spark, d):
    """Customer to supplier edges with quantities, one per order line."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def nation_flows(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    return trades(spark, d).join(c, "o_custkey").join(s, "l_suppkey").select(
        "src", "dst", F.col("l_quantity").alias("value"), "o_orderdate", "l_orderkey", "l_linenumber", "l_suppkey")


@query("pivot_graph", """
    select c_nationkey || '|' || c_mktsegment as source, s_nationkey || '|SUPPLIER' as target, sum(l_quantity) as value, count(*) as links
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
    group by 1, 2""")
def pivot_graph(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("kind"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.lit("SUPPLIER").alias("kind"))
    e = trades(spark, d).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.col("l_quantity").alias("value"))
    return graph.pivot_graph(c.unionByName(s), e, ["nation", "kind"])


@query("adjacency", f"""with {FLOWS},
    last as (select src, dst, arg_max(value, {{d: o_orderdate, k: l_orderkey, n: l_linenumber, s: l_suppkey, v: value}}) as value from flows group by 1, 2)
    select a.n_nationkey as src, b.n_nationkey as dst, coalesce(value, 0) as value
    from nation a cross join nation b left join last on last.src = a.n_nationkey and last.dst = b.n_nationkey""")
def adjacency(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    return graph.adjacency_cells(nations, nation_flows(spark, d), ["o_orderdate", "l_orderkey", "l_linenumber", "l_suppkey", "value"])


@query("edge_lists", f"""with {FLOWS}, e as (select src, dst, sum(value) as value from flows group by 1, 2)
    select src as node, 'out' as direction, dst as other, value from e union all select dst, 'in', src, value from e""")
def edge_lists(spark, d):
    e = nation_flows(spark, d).groupBy("src", "dst").agg(F.sum("value").alias("value"))
    return graph.edge_lists(e)


@query("node_flow", f"""with {FLOWS}
    select node, sum(o) as "out", sum(i) as "in", greatest(sum(o), sum(i)) as value from (
      select src as node, value as o, 0e0 as i from flows union all select dst, 0e0, value from flows) group by 1""")
def node_flow(spark, d):
    return graph.node_flow(nation_flows(spark, d))


LEVEL_EDGES = """
    edges as (
      select 'R' || n_regionkey as src, 'N' || n_nationkey as dst from nation
      union select 'N' || c_nationkey, 'C' || c_custkey from customer
      union select 'N' || s_nationkey, 'S' || s_suppkey from supplier
      union select 'C' || o_custkey, 'S' || l_suppkey from lineitem join orders on l_orderkey = o_orderkey
      union select 'S' || l_suppkey, 'P' || l_partkey from lineitem)"""


def level_edges(spark, d):
    """Distinct edges; numbers are told apart before they become text."""
    def edges(df, a, src, b, dst):
        found = stage(df.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct(), "edges")
        return found.select(F.concat(F.lit(a), F.col("s").cast("string")).alias("src"), F.concat(F.lit(b), F.col("d").cast("string")).alias("dst"))

    n = edges(table(spark, d, "nation"), "R", "n_regionkey", "N", "n_nationkey")
    c = edges(table(spark, d, "customer"), "N", "c_nationkey", "C", "c_custkey")
    s = edges(table(spark, d, "supplier"), "N", "s_nationkey", "S", "s_suppkey")
    t = edges(trades(spark, d), "C", "o_custkey", "S", "l_suppkey")
    p = edges(table(spark, d, "lineitem"), "S", "l_suppkey", "P", "l_partkey")
    return n.union(c).union(s).union(t).union(p)


@query("node_levels", f"""with recursive {LEVEL_EDGES},
    r as (select node, 0::bigint as level from (select src as node from edges union select dst from edges)
          union select dst, level + 1 from r join edges on src = node)
    select node, max(level) as level from r group by 1""")
def node_levels(spark, d):
    e = level_edges(spark, d)
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return graph.node_levels(nodes, e)


TREE = """tree as (
    select 'W' as id, null::varchar as parent, 0e0 as value
    union all select 'R' || r_regionkey, 'W', 0e0 from region
    union all select 'N' || n_nationkey, 'R' || n_regionkey, 0e0 from nation
    union all select 'C' || c_custkey, 'N' || c_nationkey, round(abs(c_acctbal)) from customer),
  up as (select id as anc, id, value from tree union all select t.parent, up.id, up.value from up join tree t on t.id = up.anc where t.parent is not null),
  depth as (select id, 0::bigint as depth from tree where parent is null union all select t.id, depth + 1 from tree t join depth d on t.parent = d.id),
  totals as (select t.id, t.parent, d.depth, t.value, s.total from tree t join depth d using (id) join (select anc as id, sum(value) as total from up group by 1) s using (id))"""


def tree(spark, d):
    r = table(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.lit("W").alias("parent"), F.lit(0.0).alias("value"))
    n = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey"), F.lit(0.0))
    c = table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey"), F.concat(F.lit("N"), "c_nationkey"), F.round(F.abs("c_acctbal")))
    root = spark.range(1).select(F.lit("W"), F.lit(None).cast("string"), F.lit(0.0))
    return r.union(n).union(c).union(root)


@query("tree_totals", f"with recursive {TREE} select id, parent, depth, value, total from totals")
def tree_totals(spark, d):
    return graph.tree_totals(tree(spark, d))


@query("tree_shares", f"""with recursive {TREE}
    select id, parent, depth, total, round(total / sum(total) over (partition by parent), 6) as share,
           round(coalesce(sum(total) over (partition by parent order by total desc, id rows between unbounded preceding and 1 preceding), 0)
                 / sum(total) over (partition by parent), 6) as "start" from totals""")
def tree_shares(spark, d):
    s = graph.tree_shares(graph.tree_totals(tree(spark, d)))
    return s.select("id", "parent", "depth", "total", F.round("share", 6).alias("share"), F.round("start", 6).alias("start"))


@query("chord_flows", f"""with {FLOWS}, m as (select src, dst, sum(value) as v from flows group by 1, 2),
    p as (select coalesce(x.src, y.dst) as a, coalesce(x.dst, y.src) as b, coalesce(x.v, 0) as ab, coalesce(y.v, 0) as ba
          from (select * from m where src <= dst) x full join (select * from m where src >= dst) y on x.src = y.dst and x.dst = y.src)
    select case when ab < ba then b else a end as source, case when ab < ba then a else b end as target,
           greatest(ab, ba) as source_value, least(ab, ba) as target_value from p""")
def chord_flows(spark, d):
    return graph.chord_flows(nation_flows(spark, d))


@query("connected_components", """
    with s as (select event_id, user_id, ts,
                 case when date_diff('microsecond', lag(ts) over w, ts) <= 3600000000 then 0 else 1 end as fresh from events
               window w as (partition by user_id order by ts, event_id)),
         g as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as part from s)
    select event_id as id, min(event_id) over (partition by user_id, part) as component from g""")
def connected_components(spark, d):
    """Chains of a user's events that are at most an hour apart."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    p = previous(e, ["ts", "event_id"], ["event_id", "ts"], ["user_id"])
    near = (timeops.seconds("ts") - timeops.seconds("prev_ts")) <= 3600.0
    links = p.where(near).select(F.col("event_id").alias("src"), F.col("prev_event_id").alias("dst"))
    return graph.connected_components(e.select(F.col("event_id").alias("id")), links)
