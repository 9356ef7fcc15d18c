"""Graph and hierarchy operators over node and edge tables (edges: src, dst, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.rank import running_sum
from tidegrid.session import cut, release, stage


def pivot_graph(nodes: DataFrame, edges: DataFrame, keys: list[str], directed: bool = True) -> DataFrame:
    """Collapse a graph to groups of nodes with equal ``keys``; link values between groups are summed."""
    group = F.concat_ws("|", *keys)
    s = nodes.select(F.col("id").alias("src"), group.alias("source"))
    t = nodes.select(F.col("id").alias("dst"), group.alias("target"))
    # Parallel edges are merged first, so the two joins move one row per node pair.
    merged = edges.groupBy("src", "dst").agg(F.sum("value").alias("value"), F.count("*").alias("links"))
    linked = merged.join(s, "src").join(t, "dst")
    if not directed:
        linked = linked.withColumn("_a", F.least("source", "target")).withColumn("_b", F.greatest("source", "target")).drop(
            "source", "target").withColumnsRenamed({"_a": "source", "_b": "target"})
    return linked.groupBy("source", "target").agg(F.sum("value").alias("value"), F.sum("links").alias("links"))


def group_sizes(nodes: DataFrame, keys: list[str]) -> DataFrame:
    return nodes.groupBy(*keys).agg(F.count("*").alias("nodes"))


def adjacency_cells(nodes: DataFrame, edges: DataFrame, order: list[str]) -> DataFrame:
    """Square matrix as a tall table (src, dst, value): every pair of nodes, 0 without an edge.

    Where an edge is listed more than once, the last one in ``order`` counts. Ends of edges that the node
    table lacks are nodes too. All pairs are the result that is asked for here.
    """
    last = edges.groupBy("src", "dst").agg(F.max_by("value", F.struct(*order)).alias("value"))
    ids = nodes.select(F.col("id").alias("src")).union(edges.select("src")).union(edges.select("dst")).distinct()
    full = ids.crossJoin(ids.select(F.col("src").alias("dst")))
    return full.join(last, ["src", "dst"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast(dict(last.dtypes)["value"])))


def adjacency(edges: DataFrame, order: list[str], ids: list) -> DataFrame:
    """The matrix of some named nodes as a table: one row per source, one column per target, 0 without an edge.

    Where an edge is listed more than once, the last one in ``order`` counts. Edges of other nodes are no
    part of it; :func:`adjacency_cells` has them all.
    """
    last = edges.groupBy("src", "dst").agg(F.max_by("value", F.struct(*order)).alias("value"))
    wide = last.groupBy("src").pivot("dst", ids).agg(F.sum("value"))
    spine = edges.sparkSession.createDataFrame([(i,) for i in ids], ["src"]).select(
        F.col("src").cast(dict(edges.dtypes)["src"]).alias("src"))
    return spine.join(wide, "src", "left").na.fill(0)


def matrix_to_edges(matrix: DataFrame, ids: list) -> DataFrame:
    """A square matrix table back to a full edge list, zeros kept."""
    cells = F.array(*[F.struct(F.lit(i).alias("dst"), F.col(f"`{i}`").alias("value")) for i in ids])
    return matrix.select("src", F.explode(cells).alias("e")).select("src", "e.dst", "e.value")


def has_edge(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    return pairs.join(edges, ["src", "dst"], "left_semi")


def edge_lists(edges: DataFrame) -> DataFrame:
    """Outgoing and incoming edges of every node as a tall table (node, direction, other, value)."""
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.lit("out").alias("direction"), F.col("dst").alias("other")),
        F.struct(F.col("dst").alias("node"), F.lit("in").alias("direction"), F.col("src").alias("other")),
    )
    return edges.select(F.explode(ends).alias("e"), "value").select("e.*", "value")


def node_flow(edges: DataFrame) -> DataFrame:
    """Node value: the larger of its outgoing and incoming sums."""
    sums = edge_lists(edges).groupBy("node").agg(
        F.coalesce(F.sum(F.when(F.col("direction") == "out", F.col("value"))), F.lit(0)).alias("out"),
        F.coalesce(F.sum(F.when(F.col("direction") == "in", F.col("value"))), F.lit(0)).alias("in"),
    )
    return sums.select("node", "out", "in", F.greatest("out", "in").alias("value"))


def node_levels(nodes: DataFrame, edges: DataFrame, max_levels: int | None = None, sinks_right: bool = False) -> DataFrame:
    """Level of each node: length of the longest path that ends in it. A cycle is an error.

    Each round moves the set of nodes that some path of the current length reaches. Without a cycle no path
    has as many steps as there are nodes. Where all edges start at nodes of the table, the sets only shrink, and edges
    that start outside are left out of the rounds to come. Parallel edges do no harm, but are carried along.
    """
    nodes = stage(nodes.select("id"), "nodes")
    most = max_levels or nodes.count()
    arcs = stage(edges.select("src", "dst").where("src is not null"), "arcs")
    senders = stage(arcs.select(F.col("src").alias("node"), F.lit(True).alias("_sends")).distinct(), "senders") if sinks_right else None
    closed = arcs.join(nodes, F.col("src") == F.col("id"), "left_anti").isEmpty()
    levels = nodes.select(F.col("id").alias("node"), F.lit(0).cast("bigint").alias("level"))
    front = nodes.select(F.col("id").alias("node"))
    found = [levels]
    for k in range(1, most + 1):
        moved = arcs
        if k > 1 or not closed:
            moved = arcs.join(front, F.col("node") == F.col("src"), "left_semi")
        if k > 1 and closed:
            moved = stage(moved, "arcs")
            release(arcs)
            arcs = moved
        front = stage(moved.select(F.col("dst").alias("node")).distinct(), "front")
        if front.isEmpty():
            break
        found.append(front.select("node", F.lit(k).cast("bigint").alias("level")))
    else:
        raise ValueError("the graph has a cycle")
    release(arcs)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = out.groupBy("node").agg(F.max("level").alias("level"))
    if sinks_right:
        last = out.agg(F.max("level").alias("_last"))
        out = out.join(senders, "node", "left").join(F.broadcast(last)).select(
            "node", F.when(F.col("_sends"), F.col("level")).otherwise(F.col("_last")).alias("level"))
    return out


def tree_totals(tree: DataFrame) -> DataFrame:
    """Depth and subtree total of every node of a forest (id, parent, value); roots have a null parent.

    Nodes below a parent that the table lacks are kept, with a null depth. A cycle is an error.

    Totals move one level up per round and are summed per parent before they move again. Depths move down.
    """
    tree = cut(tree.select("id", "parent", "value"))
    link = tree.where("parent is not null").select("id", "parent")
    total = tree.select("id", F.col("value").alias("v"))
    part, depth = total, tree.where("parent is null").select("id", F.lit(0).cast("bigint").alias("depth"))
    layer = depth
    for _ in range(tree.count() + 1):  # no path of a forest is longer
        part = cut(part.join(link, "id").groupBy(F.col("parent").alias("id")).agg(F.sum("v").alias("v")))
        layer = cut(link.join(layer.withColumnRenamed("id", "parent"), "parent").select("id", (F.col("depth") + 1).alias("depth")))
        if part.isEmpty() and layer.isEmpty():
            break
        total = total.unionByName(part)
        depth = depth.unionByName(layer)
    else:
        raise ValueError("the tree has a cycle")
    total = total.groupBy("id").agg(F.sum("v").alias("total"))
    return tree.join(depth, "id", "left").join(total, "id").select("id", "parent", "depth", "value", "total")


def tree_shares(totals: DataFrame) -> DataFrame:
    """Share of each node in the summed totals of its siblings, and where its slice starts (largest first)."""
    keyed = totals.withColumn("_p", F.coalesce("parent", F.lit(""))).withColumn("_neg", -F.col("total"))
    sib = keyed.groupBy("_p").agg(F.sum("total").alias("_all"))
    placed = running_sum(keyed, ["_neg", "id"], "total", "_upto", ["_p"]).join(sib, "_p")
    return placed.select(
        "id", "parent", "depth", "total", (F.col("total") / F.col("_all")).alias("share"),
        ((F.col("_upto") - F.col("total")) / F.col("_all")).alias("start"),
    )


def chord_flows(edges: DataFrame) -> DataFrame:
    """Pair links of a flow matrix: the larger direction is the source side."""
    m = edges.groupBy("src", "dst").agg(F.sum("value").alias("value"))
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    both = m.groupBy(a.alias("a"), b.alias("b")).agg(
        F.coalesce(F.sum(F.when(F.col("src") == a, F.col("value"))), F.lit(0)).alias("ab"),
        F.coalesce(F.sum(F.when((F.col("src") == b) & (a != b), F.col("value"))), F.lit(0)).alias("ba"),
    )
    both = both.withColumn("ba", F.when(F.col("a") == F.col("b"), F.col("ab")).otherwise(F.col("ba")))
    swap = F.col("ab") < F.col("ba")
    return both.where("ab <> 0 or ba <> 0").select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("source"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("target"),
        F.greatest("ab", "ba").alias("source_value"), F.least("ab", "ba").alias("target_value"),
    )


def chord_groups(edges: DataFrame) -> DataFrame:
    """Row totals of a flow matrix with their share of the whole."""
    rows = edges.groupBy(F.col("src").alias("node")).agg(F.sum("value").alias("value"))
    whole = rows.agg(F.sum("value").alias("_all"))
    return rows.join(F.broadcast(whole)).select("node", "value", (F.col("value") / F.col("_all")).alias("share"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node of each node's component, by alternating star contraction.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest node it
    knows. Rows are edges only, minima are summed up map-side, and a node with very many edges is a
    skewed join that adaptive execution splits. Stops when a round changes nothing.
    """
    def hook(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(low, "u")

    e = cut(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = hook(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.where("u <> v").distinct()
        tied = hook(large)
        small = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(tied.select("u", F.col("m").alias("v"))).distinct())
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    root = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(root, nodes["id"] == root["u"], "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )
