"""Playback ticks, live box filter, printed batches, samples and permutations."""

import datetime as dt

from pyspark.sql import functions as F

from tidegrid.operators import grid, stats
from tidegrid.plans.streams import event_stream
from tidegrid.schema import CITY_BOX
from tidegrid.sources.streams import console_sink
from tidegrid.sources.tables import posts
from tidegrid.streaming.upsert import batch_writer, run_batches


def test_tick_bundle_shows_what_its_clock_allows(spark, sf_dir):
    p = posts(spark, sf_dir).cache()
    now = dt.datetime(2024, 1, 10, 12, 30)
    got = grid.tick_bundle(p, "2024-01-10 12:30:00", 24, 48, CITY_BOX)
    rows = p.collect()
    seen = [r for r in rows if r.created_time <= now]
    assert got["clock"].first()["now"] == now
    cells = got["grid"].collect()
    inside = [r for r in seen if r.created_time >= now - dt.timedelta(hours=24)
              and CITY_BOX.south <= r.lat <= CITY_BOX.north and CITY_BOX.west <= r.lon <= CITY_BOX.east]
    assert sum(c["count"] for c in cells) == len(inside)
    images = [r["id"] for r in got["images"].collect()]
    want = sorted((r for r in seen if r.created_time >= now - dt.timedelta(hours=48)), key=lambda r: (-r.created_time.timestamp(), r.id))
    assert images == [r.id for r in want[:10]]


def test_live_box_filter_and_printed_batches(spark, sf_dir, tmp_path):
    stream = grid.in_area(event_stream(spark, sf_dir), CITY_BOX)
    run_batches(stream, "box", batch_writer(f"{tmp_path}/out"))
    table = grid.in_area(event_stream(spark, sf_dir), CITY_BOX)
    assert table.isStreaming
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() > 0
    assert got.where((F.col("lat") < CITY_BOX.south) | (F.col("lat") > CITY_BOX.north)).count() == 0
    q = console_sink(table.select("id"), 2)
    q.processAllAvailable()
    q.stop()
    assert q.exception() is None


def test_hash_sample_takes_any_key(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k")).union(spark.range(1).select(F.lit(None).cast("string")))
    a, b = (sorted(str(r.k) for r in stats.hash_sample(x, "k", 0.4).collect()) for x in (df, df.repartition(7)))
    assert a == b and 0.35 < len(a) / 5001 < 0.45
    assert stats.hash_sample(df, "k", 1.0).count() == 5001
    assert set(a) <= {str(r.k) for r in stats.hash_sample(df, "k", 0.6).collect()}


def test_permute_takes_rows_in_the_named_order(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "place int, v string")
    order = spark.createDataFrame([(0, 2), (1, 0), (2, 1), (3, 2)], "to int, place int")
    assert [r.v for r in stats.permute(df, order).orderBy("to").collect()] == ["c", "a", "b", "c"]
