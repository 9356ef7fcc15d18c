"""Points in many polygons against the one-ring expression, map and array functions against Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import containers as co
from tidegrid.operators import geo, polygons, stats

RINGS = {
    "square": [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)],
    "notch": [(1.0, 1.0), (1.0, 9.0), (9.0, 9.0), (9.0, 1.0), (5.0, 5.0)],
    "thin": [(0.0, 0.0), (10.0, 10.0), (10.0, 10.001)],
    "tiny": [(2.0, 2.0), (2.0, 2.0001), (2.0001, 2.0001), (2.0001, 2.0)],
    "flat": [(3.0, 0.0), (3.0, 5.0)],
    "point": [(1.0, 1.0)],
    "far": [(-1e6, -1e6), (-1e6, 1e6), (1e6, 1e6), (1e6, -1e6)],
    "star": [(5 + (4 if i % 2 else 1.5) * math.sin(i * math.pi / 20), 5 + (4 if i % 2 else 1.5) * math.cos(i * math.pi / 20)) for i in range(40)],
}


def inside(ring, y, x):
    n = 0
    for (y1, x1), (y2, x2) in zip([ring[-1], *ring[:-1]], ring):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1)):
            n += 1
    return n % 2 == 1


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(k, i, y, x) for k, ring in RINGS.items() for i, (y, x) in enumerate(ring)]
    return polygons.ring_edges(spark.createDataFrame(rows, "poly string, i int, lat double, lon double"), "poly", ["i"])


def test_points_in_polygons_match_ray_casting(spark, edges):
    rnd = random.Random(3)
    spots = [(rnd.uniform(-1, 11), rnd.uniform(-1, 11)) for _ in range(1500)] + [(float(y), float(x)) for y in range(11) for x in range(11)]
    spots += [(2.00005, 2.00005), (1e5, -1e5), (2e6, 0.0)] + [(5.0, 5.5)] * 20
    rows = [(i, y, x) for i, (y, x) in enumerate(spots)] + [(-1, None, 1.0), (-2, float("nan"), 1.0)]
    got = polygons.points_in_polygons(spark.createDataFrame(rows, "id int, lat double, lon double"), edges, "poly")
    want = {(i, k) for i, (y, x) in enumerate(spots) for k, ring in RINGS.items() if inside(ring, y, x)}
    assert {(r["id"], r["poly"]) for r in got.select("id", "poly").collect()} == want
    assert got.count() == len(want)


def test_many_edges_and_holes(spark):
    n = 10_000
    outer = [("ring", 0, i, 5 * math.sin(2 * math.pi * i / n), 5 * math.cos(2 * math.pi * i / n)) for i in range(n)]
    hole = [("ring", 1, i, 2 * math.sin(2 * math.pi * i / 50), 2 * math.cos(2 * math.pi * i / 50)) for i in range(50)]
    v = spark.createDataFrame(outer + hole, "poly string, part int, i int, lat double, lon double").withColumn("one", F.concat_ws(":", "poly", "part"))
    e = polygons.ring_edges(v, "one", ["i"]).withColumn("poly", F.split("one", ":")[0]).drop("one")
    pts = spark.createDataFrame([(i, i * 0.25, 0.1) for i in range(-24, 25)], "id int, lat double, lon double")
    got = {r["id"] for r in polygons.points_in_polygons(pts, e, "poly").collect()}
    assert got == {i for i in range(-24, 25) if 2 < math.hypot(i * 0.25, 0.1) < 5}


def test_no_polygons(spark, edges):
    pts = spark.createDataFrame([(1, 1.0, 1.0)], "id int, lat double, lon double")
    assert polygons.points_in_polygons(pts, edges.where("false"), "poly").count() == 0


def test_one_ring_agrees_with_the_expression(spark, edges):
    pts = spark.range(400).select("id", (F.col("id") % 20 * 0.5 + 0.01).alias("lat"), (F.floor(F.col("id") / 20) * 0.5 + 0.02).alias("lon"))
    want = {r["id"] for r in pts.where(geo.in_polygon("lat", "lon", RINGS["star"])).collect()}
    assert {r["id"] for r in polygons.points_in_polygons(pts, edges.where("poly = 'star'"), "poly").collect()} == want


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_maps(spark):
    m, n = F.expr("map('b', 2, 'a', 1)"), F.expr("map('a', 9, 'c', 3)")
    r = one(spark, co.keys(m), co.values(m), co.entries(m), co.overlaid(m, n), co.without(m, "a", "x"), co.has(m, "b"), co.has(m, "z"))
    assert r["c0"] == ["a", "b"] and r["c1"] == [1, 2] and [tuple(e) for e in r["c2"]] == [("a", 1), ("b", 2)]
    assert r["c3"] == {"a": 9, "b": 2, "c": 3} and r["c4"] == {"b": 2} and r["c5"] and not r["c6"]
    empty = one(spark, co.keys(F.expr("cast(map() as map<string,int>)")))
    assert empty["c0"] == []


def test_map_of_groups(spark):
    rows = [("x", "k", 1), ("x", "k", 2), ("x", None, 5), ("x", "j", None), ("y", None, 1)]
    got = co.map_of(spark.createDataFrame(rows, "g string, k string, v int"), ["g"], "k", F.sum("v"))
    assert {r["g"]: r["map"] for r in got.collect()} == {"x": {"k": 3, "j": None}}


def test_arrays(spark):
    a, b = F.expr("array(1, 2, 3)"), F.expr("array('x', 'y')")
    r = one(spark, co.zipped(a, b), co.zipped(a), co.merged(F.array(a, a)), co.picked(b, F.expr("array(1, 0, 5)")), co.zipped(a, F.expr("cast(array() as array<int>)")))
    assert [tuple(x) for x in r["c0"]] == [(1, "x"), (2, "y")] and len(r["c1"]) == 3
    assert r["c2"] == [1, 2, 3, 1, 2, 3] and r["c3"] == ["y", "x", None] and r["c4"] == []


@pytest.mark.parametrize(("start", "stop", "step", "want"), [
    (0, 5, 1, [0, 1, 2, 3, 4]), (0, 1, 0.2, [0, 0.2, 0.4, 0.6000000000000001, 0.8]), (5, 0, -2, [5, 3, 1]), (0, 0, 1, []), (3, 1, 1, []), (1, 4, 1.5, [1, 2.5]),
])
def test_span(spark, start, stop, step, want):
    assert one(spark, co.span(start, stop, step))["c0"] == want


def test_shuffled_is_a_permutation_that_repeats(spark):
    df = spark.range(200).repartition(7).withColumnRenamed("id", "k")
    first, again = (stats.shuffled(d, "k", 3).collect() for d in (df, df.coalesce(1)))
    assert [r["k"] for r in first] == [r["k"] for r in again] and sorted(r["k"] for r in first) == list(range(200))
    assert [r["place"] for r in first] == list(range(1, 201)) and [r["k"] for r in first] != list(range(200))
    assert [r["k"] for r in stats.shuffled(df, "k", 4).collect()] != [r["k"] for r in first]


def test_exploded_corners_and_cells_do_not_go_to_the_driver(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "few"))
    corners = spark.read.parquet(str(tmp_path / "few")).select(F.col("id").alias("poly"), F.explode(F.sequence(F.lit(0), F.lit(999))).alias("i")).select(
        "poly", "i", (F.col("poly") + F.sin(F.col("i") * 0.0062)).alias("lat"), F.cos(F.col("i") * 0.0062).alias("lon"))
    few = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(few)
    spark.conf.set(few, "100k")
    try:
        ring = polygons.ring_edges(corners, "poly", ["i"])
        got = polygons.points_in_polygons(spark.createDataFrame([(1, 3.2, 0.1)], "id int, lat double, lon double"), ring, "poly")
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().sparkPlan().toString()
        assert sorted(r["poly"] for r in got.collect()) == [3, 4]
    finally:
        spark.conf.set(few, before)
