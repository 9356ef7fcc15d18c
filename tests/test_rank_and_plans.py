"""Distributed ranks against plain models, online votes, and the shape of physical plans."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegrid.operators import grid, images, online, rank
from tidegrid.schema import CITY_BOX
from tidegrid.sources import files
from tidegrid.sources.tables import points, table

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 6)), min_size=1, max_size=60))
def test_numbered_equals_sorted_position(spark, rows):
    data = [(i, g, v) for i, (g, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id int, g int, v int")
    whole = {r["id"]: r["rn"] for r in rank.numbered(df, ["v", "id"]).collect()}
    for i, r in enumerate(sorted(data, key=lambda r: (r[2], r[0])), 1):
        assert whole[r[0]] == i
    part = {r["id"]: r["rn"] for r in rank.numbered(df, ["v", "id"], ["g"]).collect()}
    for g in {r[1] for r in data}:
        for i, r in enumerate(sorted((r for r in data if r[1] == g), key=lambda r: (r[2], r[0])), 1):
            assert part[r[0]] == i


@FEW
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), min_size=1, max_size=60))
def test_out_of_sample_rank_counts_earlier_days(spark, rows):
    df = spark.createDataFrame([(i, d, float(v)) for i, (d, v) in enumerate(rows)], "id int, day int, v double")
    got = {r["id"]: r["k"] for r in rank.out_of_sample_rank(df, "v", "day", "k").collect()}
    for i, (d, v) in enumerate(rows):
        assert got[i] == sum(1 for e, w in rows if e < d and w <= v)


def test_history_rank(spark):
    h = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (9.0,)], "v double")
    t = spark.createDataFrame([(0, 0.5), (1, 2.0), (2, 10.0)], "id int, v double")
    assert {r["id"]: r["k"] for r in rank.history_rank(h, t, "v", "k").collect()} == {0: 0, 1: 3, 2: 4}


def test_running_sum_per_group(spark):
    df = spark.createDataFrame([(i % 2, i, 1) for i in range(50)], "g int, i int, v int")
    for r in rank.running_sum(df, ["i"], "v", "s", ["g"]).collect():
        assert r["s"] == r["i"] // 2 + 1


def test_no_spread_gives_zero(spark):
    df = spark.createDataFrame([(1.0,)] * 3, "v double")
    assert [r["z_v"] for r in rank.standardised(df, ["v"]).collect()] == [0.0] * 3
    assert [r["s_v"] for r in rank.scaled_min_max(df, ["v"]).collect()] == [0.0] * 3


def test_count_windows_fire_only_when_full(spark):
    df = spark.range(25).select(F.col("id").alias("i"))
    w = rank.count_windows(df, ["i"], 8, 4)
    got = {r["win"]: sorted(x["i"] for x in w.where(F.col("win") == r["win"]).collect()) for r in w.select("win").distinct().collect()}
    assert got == {k: list(range(4 * k - 8, 4 * k)) for k in range(2, 7)}


def test_online_votes_match_the_sequential_rule(spark):
    r = random.Random(4)
    memory, dense, n = 40, 5, 420
    rows = []
    for i in range(n):
        hot = r.random() < 0.5
        rows.append((i, 0.3 + r.random() * 0.01 if hot else r.random(), 0.4 + r.random() * 0.01 if hot else r.random(), i + r.random()))
    got = online.online_votes(
        spark.createDataFrame([(str(i), i, a, b, t) for i, a, b, t in rows], "id string, i bigint, lat double, lon double, t double"),
        ["i"], ["lat", "lon", "t"], memory, 1.0, 0.8, dense,
    )
    got = {int(x["id"]): (x["n_close"], x["cl"]) for x in got.collect()}
    z = np.array([x[1:] for x in rows])
    label = [0] * n
    for i in range(n):
        near = []
        if i >= memory:
            sd = z[i - memory : i + 1].std(axis=0, ddof=1)
            for j in range(i - memory, i):
                d = (z[i] - z[j]) / sd
                if (math.exp(-(d[0] ** 2 + d[1] ** 2)) + math.exp(-d[2] ** 2)) / 2 > 0.8:
                    near.append(j)
        if len(near) > dense:
            names = {str(label[j]) for j in near if label[j]}
            label[i] = int(max(names)) if names else max(label) + 1
        assert got[i] == (len(near), label[i])
    assert max(label) >= 1


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(grid.series(grid.in_range(points(spark, sf_dir), "2024-01-05", "2024-01-06"), "hour"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text
    assert "ReadSchema: struct<ts:timestamp_ntz>" in text


@pytest.mark.parametrize("build", [
    lambda p: grid.busiest_cells(grid.in_area(p, CITY_BOX)),
    lambda p: grid.trending(p, "user_id"),
    lambda p: rank.rank_scaled(p.select("id", "lat"), ["lat"], "id"),
    lambda p: rank.previous(p.select("id", "user_id", "created_time"), ["created_time", "id"], ["id"], ["user_id"]),
])
def test_no_cartesian_product_and_no_whole_table_in_one_task(spark, sf_dir, build):
    text = plan(build(points(spark, sf_dir)))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    if "Window" in text:  # a window without keys may only see one row per partition
        assert "Window [row_number()" not in text


def png(width, height, rgb):
    raw = b"".join(b"\x00" + bytes(rgb) * width for _ in range(height))

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_colour_features_of_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(4, 2, (255, 0, 130)))
    (tmp_path / "bad.png").write_bytes(b"no image")
    rows = images.image_rows(files.read_images(spark, str(tmp_path)))
    feats = images.color_histogram(rows)
    out = {r["name"]: r["features"] for r in feats.collect()}
    third = 1 / 3
    want = [0, 0, 0, 0, third, third, 0, 0, 0, 0, 0, 0, third, 0, 0]
    assert list(out) == ["a.png"] and out["a.png"] == pytest.approx(want)
    files.write_features(feats, str(tmp_path / "csv"))
    line = spark.read.text(str(tmp_path / "csv")).first()[0]
    assert line.startswith("a.png,") and len(line.split(",")) == 16


def test_lineitem_reads_only_needed_columns(spark, sf_dir):
    from tidegrid.operators import stats

    text = plan(stats.extent(table(spark, sf_dir, "lineitem"), "l_tax", ["l_returnflag"]))
    assert "ReadSchema: struct<l_tax:double,l_returnflag:string>" in text
