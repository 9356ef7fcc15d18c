"""Rows of a null group keep their group; streams read whole tables; replays and trees lose nothing."""

import math

from pyspark.sql import functions as F

from tidegrid.operators import clusters, geo, graph, rank, stats
from tidegrid.plans import all_queries
from tidegrid.streaming import live
from tidegrid.plans.streams import event_stream

ROWS = [("a", 1, 1.0), ("a", 2, 3.0), (None, 1, 5.0), (None, 2, 9.0), (None, 3, 9.0)]


def frame(spark):
    return spark.createDataFrame(ROWS, "g string, i int, v double")


def test_window_operators_keep_null_groups(spark):
    df = frame(spark)
    assert sorted(r["rn"] for r in rank.numbered(df, ["i"], ["g"]).collect() if r["g"] is None) == [1, 2, 3]
    assert sorted(r["s"] for r in rank.running_sum(df, ["i"], "v", "s", ["g"]).collect() if r["g"] is None) == [5.0, 14.0, 23.0]
    assert sorted(r["seq"] for r in rank.previous(df, ["i"], ["v"], ["g"]).collect() if r["g"] is None and r["prev_v"]) == [2, 3]
    assert sum(r["g"] is None for r in rank.standardised(df, ["v"], ["g"]).collect()) == 3
    assert {r["g"]: r["q0"] for r in stats.quantiles(df, "v", [0.5], ["g"]).collect()} == {"a": 2.0, None: 9.0}
    assert {r["g"]: r["n"] for r in stats.box_stats(df, "v", ["g"]).collect()} == {"a": 2, None: 3}


def test_shapes_keep_null_groups(spark):
    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)]
    rows = [(k, i, y, x) for k in ("a", None) for i, (y, x) in enumerate(ring)] + [(None, 9, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, i int, lat double, lon double")
    corners = geo.hull(df, "k").groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in corners} == {"a": 4, None: 4}
    area = geo.polygon_measures(df.where("i < 9"), "k", ["i"], "lon", "lat").collect()
    assert {r["k"]: abs(r["area"]) for r in area} == {"a": 4.0, None: 4.0}
    assert geo.path_length(df, ["k"], ["i"]).count() == 2 and geo.wrapped_bounds(df, ["k"]).count() == 2


def test_streams_read_tables_of_many_files_in_any_order(spark, sf_dir, tmp_path):
    for t in ("events", "documents"):
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        df.orderBy(F.xxhash64(df.columns[0])).repartition(4).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("hourly_update", "sliding_grid", "stream_word_count"):
        one, many = (sorted(map(str, all_queries.QUERIES[name](spark, d).collect())) for d in (sf_dir, str(tmp_path)))
        assert one == many
    one_file_each = event_stream(spark, str(tmp_path))
    assert live.hourly_update(one_file_each).agg(F.sum("count")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_unlisted_nodes_orphans_and_deep_trees(spark):
    nodes = spark.createDataFrame([(0,), (1,)], "id int")
    edges = spark.createDataFrame([(0, 9, 5, 1), (9, 1, 2, 2)], "src int, dst int, value int, k int")
    cells = {(r["src"], r["dst"]): r["value"] for r in graph.adjacency_cells(nodes, edges, ["k"]).collect()}
    assert len(cells) == 9 and cells[0, 9] == 5 and cells[9, 1] == 2 and cells[0, 1] == 0
    tree = spark.createDataFrame([("r", None, 1.0), ("a", "r", 2.0), ("o", "gone", 4.0), ("p", "o", 1.0)], "id string, parent string, value double")
    got = {r["id"]: (r["depth"], r["total"]) for r in graph.tree_totals(tree).collect()}
    assert got == {"r": (0, 3.0), "a": (1, 2.0), "o": (None, 5.0), "p": (None, 1.0)}


def test_kernel_mass_is_not_cut_off(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.99, 0.5)], "x double, y double")
    got = {(r["g0"], r["g1"]): r["density"] for r in clusters.grid_density(df, ["x", "y"], 10, 2.0).collect()}
    assert len(got) == 100
    for (i, j), v in got.items():
        want = sum(math.exp(-((i - a) ** 2 + (j - b) ** 2) / 8) / 2 for a, b in ((0, 0), (9, 5)))
        assert abs(v - want) < 1e-12


def test_qq_pairs_with_one_common_value(spark):
    rows = [("a", 5.0)] * 90 + [("a", 7.0)] * 10 + [("b", float(i)) for i in range(100)]
    got = {r["i"]: (r["x"], r["y"]) for r in stats.qq_pairs(spark.createDataFrame(rows, "s string, v double"), "v", "s", "a", "b", 10).collect()}
    a, b = sorted(v for s, v in rows if s == "a"), sorted(v for s, v in rows if s == "b")
    assert got == {i: (a[int(i * 99 / 10)], b[int(i * 99 / 10)]) for i in range(10)}
