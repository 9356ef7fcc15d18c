"""Streams must end with the results of the same batch query; late and repeated rows are covered."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import detect
from tidegrid.schema import Detector
from tidegrid.sources import files, streams
from tidegrid.sources.tables import posts
from tidegrid.streaming import live
from tidegrid.streaming.detector import WindowDetector

COLS = "id string, created_time timestamp_ntz, lat double, lon double, text string"


def in_slices(df, path, n):
    """Write rows in time order as n single files, oldest first."""
    rows = df.orderBy("created_time", "id").collect()
    spark = df.sparkSession
    size = -(-len(rows) // n)
    for i in range(n):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1)
        part.write.mode("append").parquet(path)
        time.sleep(0.05)
    return streams.file_stream(spark, path, df.schema)


@pytest.fixture(scope="module")
def base(spark, sf_dir):
    df = posts(spark, sf_dir).select("id", "created_time", "lat", "lon", F.substring("text", 1, 60).alias("text"))
    return spark.createDataFrame(df.collect(), COLS)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_sliding_grid_over_batches_equals_one_batch(base, tmp_path):
    got = live.sliding_grid(in_slices(base, str(tmp_path / "a"), 4), delay="2 days")
    w = F.window(F.col("created_time").cast("timestamp"), "1 hour", "30 minutes")
    from tidegrid.functions import geo

    want = base.groupBy(w["start"].cast("timestamp_ntz"), w["end"].cast("timestamp_ntz"), geo.geohash("lat", "lon", 6)).count()
    assert as_set(got.select("start", "end", "cell", "count")) == as_set(want)


def test_hourly_update_keeps_the_last_value_per_hour(base, tmp_path):
    got = live.hourly_update(in_slices(base, str(tmp_path / "h"), 3), delay="1 day")
    want = base.groupBy(F.date_trunc("hour", "created_time").cast("timestamp_ntz")).count()
    assert as_set(got.select("bucket", "count")) == as_set(want)
    assert got.where("not full_unit").count() == 1


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    def row(i, h):
        return (str(i), t0 + dt.timedelta(hours=h), 1.0, 1.0, "x")

    path = str(tmp_path / "late")
    for rows in ([row(1, 0), row(2, 10)], [row(3, 11)], [row(4, 0), row(5, 11)], [row(5, 11)]):
        spark.createDataFrame(rows, COLS).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    got = live.hourly_update(streams.file_stream(spark, path, COLS), delay="1 hour")
    counts = {r["bucket"].hour: r["count"] for r in got.collect()}
    assert counts == {0: 1, 10: 1, 11: 3}  # the late row 4 is dropped, the repeated row 5 counts twice


def test_word_counts_are_per_batch(spark, tmp_path):
    path = str(tmp_path / "w")
    for texts in (["tide tide"], ["tide", "tide tide"], ["once"]):
        rows = [(str(i), dt.datetime(2024, 1, 1), 1.0, 1.0, t) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, COLS).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    got = live.batch_word_counts(streams.file_stream(spark, path, COLS))
    assert sorted((r["batch"], r["word"], r["count"]) for r in got.collect()) == [(0, "tide", 2), (1, "tide", 3)]
    assert live.running_word_counts(got).first()["count"] == 5


def test_step_images_takes_the_newest(base):
    got = live.step_images(base, "1 day", 3)
    assert got.groupBy("start").count().agg(F.max("count")).first()[0] == 3


P = Detector(sigma=1.0, close=0.85, dense=3, eps=0.3, min_points=4)


def test_stream_detector_equals_batch(spark, base, tmp_path):
    stream = in_slices(base, str(tmp_path / "d"), 3)
    found = WindowDetector(spark, 400, 100, P).run(stream)
    batch = detect.event_summary(detect.detect_events(base, 400, 100, P), base, ["win"])
    cols = ["win", "cl", "posts", "lat", "lon", "hashtags"]
    key = lambda r: (r["win"], r["cl"])
    assert sorted(found.select(*cols).collect(), key=key) == sorted(batch.select(*cols).collect(), key=key)
    assert batch.count() > 0


def test_stream_detector_asks_for_the_texts_of_clusters_only(spark, base, tmp_path):
    asked = []

    def captions(rows):
        asked.append(rows.count())
        return rows.join(texts, "no").select("id", "text")

    numbered = base.withColumn("no", F.xxhash64("id"))
    texts = numbered.select("no", "text")
    d = WindowDetector(spark, 400, 100, P, columns="no bigint", captions=captions)
    found = d.run(in_slices(numbered.drop("text"), str(tmp_path / "d"), 2))
    batch = detect.event_summary(detect.detect_events(base, 400, 100, P), base, ["win"])
    cols = ["win", "cl", "posts", "lat", "lon", "hashtags"]
    key = lambda r: (r["win"], r["cl"])
    assert sorted(found.select(*cols).collect(), key=key) == sorted(batch.select(*cols).collect(), key=key)
    members = detect.detect_events(base, 400, 100, P).where("cl <> 0").select("id").distinct().count()
    assert 0 < max(asked) <= members < base.count()


def test_repeated_batch_leaves_the_log_unchanged(spark, base):
    d = WindowDetector(spark, 400, 100, P)
    first, second = base.where("cast(id as int) < 500"), base.where("cast(id as int) >= 500")
    d.process(first, 0)
    d.process(second, 1)
    before = spark.read.parquet(d.out).count()
    d.process(second, 1)
    log = spark.read.parquet(f"{d.log}/batch=*/rows=*")
    assert log.agg(F.max("seq")).first()[0] == base.count() and log.count() == log.select("seq").distinct().count()
    assert spark.read.parquet(d.out).count() == before


def test_replay_slices_come_back_in_order(spark, base, tmp_path):
    out = str(tmp_path / "replay")
    files.write_replay(base, out, "2024-01-01", 86400.0, 10.0)
    back = spark.read.parquet(out)
    assert back.count() == base.count()
    assert back.agg(F.max(F.abs(F.floor(F.col("release_sec") / 10) - F.col("slice")))).first()[0] == 0


def test_topics_are_forwarded_without_broken_messages(spark, tmp_path):
    rows = [("raw", '{"a":1}'), ("raw", "{oops"), ("proc", '{"b":2}'), ("other", "{}")]
    spark.createDataFrame(rows, "topic string, value string").coalesce(1).write.parquet(str(tmp_path / "m"))
    m = streams.file_stream(spark, str(tmp_path / "m"), "topic string, value string")
    for q in streams.forward(m, ["raw", "proc"], str(tmp_path / "out")):
        q.awaitTermination()
    assert [r[0] for r in spark.read.text(str(tmp_path / "out" / "raw")).collect()] == ['{"a":1}']
    assert [r[0] for r in spark.read.text(str(tmp_path / "out" / "proc")).collect()] == ['{"b":2}']


def test_messages_round_trip(spark, base):
    m = streams.to_messages(base.select("id", "lat"), "events")
    r = m.first()
    assert r["topic"] == "events" and set(eval(r["value"])) == {"id", "lat"}
    assert os.path.basename(streams.work_dir(spark, "x")).startswith("x-")
