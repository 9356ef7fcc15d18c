"""Column functions and small operators with results worked out by hand."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import binning, geo, timeops
from tidegrid.functions.text import has_caption, hashtags
from tidegrid.operators import geo as geo_ops
from tidegrid.operators import graph, grid, stats, words
from tidegrid.schema import Box
from tidegrid.sources import files


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def test_geohash_known_names_and_clamps(spark):
    r = one(
        spark, geo.geohash(F.lit(42.6), F.lit(-5.6), 5).alias("a"), geo.geohash(F.lit(57.64911), F.lit(10.40744), 11).alias("b"),
        geo.geohash(F.lit(90.0), F.lit(180.0), 6).alias("c"), geo.geohash(F.lit(-90.0), F.lit(-180.0), 4).alias("d"),
    )
    assert (r["a"], r["b"], r["c"], r["d"]) == ("ezs42", "u4pruydqqvj", "zzzzzz", "0000")


def test_geohash_box_and_ring(spark):
    r = one(spark, geo.geohash_box(F.lit("ezs42"), 5).alias("b"), geo.box_ring(geo.geohash_box(F.lit("ezs42"), 5)).alias("r"))
    b = r["b"]
    assert b["south"] <= 42.6 <= b["north"] and b["west"] <= -5.6 <= b["east"]
    s, w, n, e = b["south"], b["west"], b["north"], b["east"]
    assert [tuple(p) for p in r["r"]] == [(w, s), (w, n), (e, n), (e, s), (w, s)]


def test_box_edges_and_antimeridian(spark):
    rows = spark.createDataFrame([(0.0, 179.0), (0.0, -179.0), (0.0, 0.0), (5.0, 170.0)], "lat double, lon double")
    assert grid.in_area(rows, Box(-5, 170, 5, -170)).count() == 3
    assert grid.in_area(rows, Box(0, 0, 5, 170)).count() == 2


def test_hex_cell_halves_round_up(spark):
    r = one(spark, geo.hex_cell(F.lit(-math.sqrt(3) / 2), F.lit(0.0), 1.0).alias("h"), geo.hex_cell(F.lit(0.0), F.lit(-1.5), 1.0).alias("g"))
    assert (r["h"]["i"], r["h"]["j"]) == (0, 0)
    assert r["g"]["j"] == -1


def test_great_circle_quarter(spark):
    assert one(spark, geo.great_circle(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("d"))["d"] == pytest.approx(math.pi / 2)


def test_date_add_month_end_overflows_and_fractions(spark):
    r = one(
        spark, timeops.date_add(ts("2024-01-31 10:00:00"), "month", 1).alias("m"), timeops.date_add(ts("2024-02-29"), "year", 1).alias("y"),
        timeops.date_add(ts("2024-01-01"), "hour", -0.5).alias("h"),
    )
    assert r["m"] == dt.datetime(2024, 3, 2, 10) and r["y"] == dt.datetime(2025, 3, 1) and r["h"] == dt.datetime(2023, 12, 31, 23, 30)
    with pytest.raises(ValueError):
        timeops.date_add("x", "month", 0.5)
    with pytest.raises(ValueError):
        timeops.date_add("x", "fortnight", 1)


def test_full_unit_and_running_unit_on_an_edge(spark):
    r = one(
        spark, timeops.full_unit(ts("2024-01-05 12:00:00"), "hour").alias("f"), timeops.unit_just_ended(ts("2024-01-05 12:00:00"), "hour").alias("e"),
        timeops.unit_just_ended(ts("2024-01-05 12:00:01"), "hour").alias("n"), timeops.week_of_year(ts("2023-01-01")).alias("w0"),
        timeops.week_of_year(ts("2024-01-07")).alias("w1"),
    )
    assert r["f"] and r["e"].hour == 11 and r["n"].hour == 12 and (r["w0"], r["w1"]) == (0, 1)


def test_bin_edges(spark):
    b = lambda x: binning.equal_bin(F.lit(x), F.lit(0.0), F.lit(10.0), 5)
    r = one(spark, b(0.0).alias("a"), b(10.0).alias("z"), b(2.0).alias("m"), binning.equal_bin(F.lit(1.0), F.lit(1.0), F.lit(1.0), 5).alias("flat"))
    assert (r["a"], r["z"], r["m"], r["flat"]) == (0, 4, 1, 0)


def test_captions_and_tags(spark):
    rows = [(None,), ("   ",), ("#",), ("#A  b #a\n#c",), ("x",)]
    df = spark.createDataFrame(rows, "text string")
    assert [r[0] for r in df.select(has_caption("text")).collect()] == [False, False, True, True, True]
    assert df.select(hashtags("text").alias("t")).collect()[3]["t"] == ["#a", "#a\n#c"]


def test_word_count_keeps_repeated_words_only(spark):
    df = spark.createDataFrame([("The #Bay the bay",), ("bay  once",), (None,), ("once\ntwice",)], "text string")
    assert {(r["word"], r["count"]) for r in words.word_count(df).collect()} == {("bay", 3)}


def test_tag_similarity_matches_brute_force(spark):
    texts = ["#a #b", "#a #b", "#a", "#c #c #a", "plain", "#b #c", "#a #d #e"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    vec = {}
    for t in texts:
        tags = [w for w in t.split() if w.startswith("#")]
        if tags:
            key = " ".join(f"{g}:{tags.count(g)}" for g in sorted(set(tags)))
            norm = math.sqrt(sum(tags.count(g) ** 2 for g in set(tags)))
            vec[key] = {g: tags.count(g) / (1 + norm) for g in set(tags)}
    for limit in (0.01, 0.17, 0.3):
        want = {
            (a, b) for a in vec for b in vec
            if a <= b and sum(w * vec[b].get(g, 0) for g, w in vec[a].items()) >= limit
        }
        got = {(r["vec_a"], r["vec_b"]) for r in words.tag_similarity(df, limit).collect()}
        assert got == want


def test_url_encoding_examples(spark):
    def enc(*pairs):
        items = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).cast("string").alias("value")) for k, v in pairs])
        return one(spark, words.url_encode_pairs(items).alias("q"))["q"]

    assert enc(("f o", "b r")) == "f+o=b+r"
    assert enc(("foo", None)) == "foo"
    assert enc(("foo", "")) == "foo="
    assert enc(("foo", "bär")) == "foo=b%C3%A4r"
    assert enc(("foo", "0"), ("bar", "false")) == "foo=0&bar=false"


def test_bad_and_empty_messages(spark):
    from tidegrid.sources.streams import parse_posts

    good = '[{"id":"1","created_time":"1704067200","location":{"latitude":1.5,"longitude":2.5},"caption":{"text":"hi"}}]'
    df = spark.createDataFrame([(good,), ("[]",), ("{broken",), (None,)], "value string")
    rows = parse_posts(df).collect()
    assert [(r["id"], r["created_time"], r["lat"], r["text"]) for r in rows] == [("1", dt.datetime(2024, 1, 1), 1.5, "hi")]


def test_matrix_round_trip(spark):
    m = [[0, 1, 0], [1, 0, 0], [1, 1, 1]]
    links = [(i, j, m[i][j], k) for k, (i, j) in enumerate((i, j) for i in range(3) for j in range(3))]
    links.append((2, 2, 1, 99))
    e = spark.createDataFrame(links, "src int, dst int, value int, k int")
    wide = graph.adjacency(e, ["k"], [0, 1, 2])
    assert sorted(tuple(r) for r in wide.collect()) == [(0, 0, 1, 0), (1, 1, 0, 0), (2, 1, 1, 1)]
    assert sorted(tuple(r) for r in graph.matrix_to_edges(wide, [0, 1, 2]).collect()) == [(i, j, m[i][j]) for i in range(3) for j in range(3)]


def test_components_chain_loop_and_single_nodes(spark):
    n = 60
    nodes = spark.range(n).select("id")
    edges = [(i, i + 1) for i in range(0, 29)] + [(40, 41), (41, 42), (42, 40), (50, 50)]
    got = {r["id"]: r["component"] for r in graph.connected_components(nodes, spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert all(got[i] == 0 for i in range(30))
    assert all(got[i] == i for i in range(30, 40)) and got[42] == 40 and got[50] == 50


def test_levels_and_cycles(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("a", "d")], "src string, dst string")
    lv = {r["node"]: r["level"] for r in graph.node_levels(nodes, e).collect()}
    assert lv == {"a": 0, "b": 1, "c": 2, "d": 1}
    right = {r["node"]: r["level"] for r in graph.node_levels(nodes, e, sinks_right=True).collect()}
    assert right["d"] == 2
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    with pytest.raises(ValueError):
        graph.node_levels(nodes, loop, max_levels=5)


def test_node_levels_keep_only_what_the_next_round_reads(spark, monkeypatch):
    n = 12
    nodes = spark.range(n).selectExpr("concat('n', id) as id")
    e = nodes.sparkSession.range(n - 1).selectExpr("concat('n', id) as src", "concat('n', id + 1) as dst")
    e = e.unionByName(e)  # parallel edges
    kept, whole = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, name: kept.append((name, out := whole(df, name))) or out)
    lv = graph.node_levels(nodes, e)
    assert {r["node"]: r["level"] for r in lv.collect()} == {f"n{i}": i for i in range(n)}
    left = [f for name, f in kept if name == "arcs"]
    assert len(left) == n and not any(os.path.exists(f.staged_at) for f in left)


def test_node_levels_with_edges_from_elsewhere(spark):
    nodes = spark.createDataFrame([("a",), ("d",)], "id string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "a"), (None, "d")], "src string, dst string")
    assert {r["node"]: r["level"] for r in graph.node_levels(nodes, e, max_levels=9).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_hull_corners(spark):
    pts = [("g", float(x), float(y)) for x in range(5) for y in range(4)] + [("h", 1.0, 1.0), ("h", 1.0, 1.0)]
    got = geo_ops.hull(spark.createDataFrame(pts, "k string, lon double, lat double"), "k").orderBy("k", "corner").collect()
    assert [(r["lon"], r["lat"]) for r in got if r["k"] == "g"] == [(0, 0), (4, 0), (4, 3), (0, 3)]
    assert [(r["lon"], r["lat"]) for r in got if r["k"] == "h"] == [(1, 1)]


def test_spherical_area_of_an_octant(spark):
    v = spark.createDataFrame([("o", 0, 0.0, 0.0), ("o", 1, 0.0, 90.0), ("o", 2, 90.0, 90.0)], "p string, i int, lat double, lon double")
    assert geo_ops.spherical_ring_area(v, "p", ["i"]).first()["area"] == pytest.approx(math.pi / 2, abs=1e-6)


def test_exact_quantiles_of_groups(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", 7.0)] * 3, "k string, v double")
    got = {r["k"]: (r["n"], r["q0"], r["q1"]) for r in stats.quantiles(df, "v", [0.5, 1.0], ["k"]).collect()}
    assert got == {"a": (4, 2.5, 4.0), "b": (3, 7.0, 7.0)}


def test_empty_bins_and_partition(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (10.0,)], "v double")
    assert [r["frequency"] for r in stats.histogram(df, "v", 4).orderBy("bin").collect()] == [2, 0, 0, 1]
    hit, rest = stats.split_by(spark.createDataFrame([(1,), (5,), (None,)], "v int"), F.col("v") > 2)
    assert hit.count() == 1 and rest.count() == 2


def test_json_export_and_snapshot(spark, tmp_path):
    rows = [("1", dt.datetime(2024, 1, 1, 0, 0, 5), 7, 1.0, 2.0, "a\n#b", ["#b"], "l")]
    df = spark.createDataFrame(rows, "id string, created_time timestamp_ntz, user_id bigint, lat double, lon double, text string, tags array<string>, link string")
    files.export_json(df.select(files.post_to_json(df).alias("p")).select("p.*"), str(tmp_path / "j"))
    back = files.read_posts(spark, str(tmp_path / "j")).first()
    assert {p.name.rsplit(".", 1)[1] for p in (tmp_path / "j").glob("part-*")} == {"gz"}
    assert (back["id"], back["created_time"], back["text"]) == ("1", dt.datetime(2024, 1, 1, 0, 0, 5), "a\n#b")
    files.save_snapshot(df, str(tmp_path / "s"))
    assert files.load_snapshot(spark, str(tmp_path / "s")).count() == 1
