"""State between batches: repeats, restarts, bounded logs, and results that do not depend on the batches."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegrid.functions import timeops
from tidegrid.operators import grid, online
from tidegrid.schema import Detector
from tidegrid.session import work_dir
from tidegrid.sources import streams
from tidegrid.sources.tables import points
from tidegrid.streaming import live, state
from tidegrid.streaming.detector import WindowDetector
from tidegrid.streaming.upsert import start_batches
from tidegrid.streaming.votes import OnlineVotes

ORDER = ["created_time", "id"]
T0 = dt.datetime(2024, 1, 1)
RULE = (1.0, 0.85, 4)  # sigma, close, dense
DIMS = ["lat", "lon", "ntime"]


@pytest.fixture(scope="module")
def base(spark, sf_dir):
    p = points(spark, sf_dir).select("id", "created_time", "lat", "lon", timeops.days("created_time").alias("ntime"))
    return spark.createDataFrame(p.orderBy(*ORDER).collect(), p.schema)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def slices(df, n):
    """The rows in arrival order, cut into n batches."""
    rows, size = df.orderBy(*ORDER).collect(), -(-df.count() // n)
    return [df.sparkSession.createDataFrame(rows[i * size: (i + 1) * size], df.schema) for i in range(n)]


# Tables between batches


def test_a_repeated_batch_finds_the_state_before_it(spark):
    c = state.Carried(spark, work_dir(spark, "c"), "x bigint")
    assert c.before(0).count() == 0
    for b in range(4):
        c.write(spark.range(c.before(b).count() + 1).withColumnRenamed("id", "x"), b)
    c.write(spark.range(c.before(3).count() + 1).withColumnRenamed("id", "x"), 3)
    assert c.read().count() == 4
    assert len(state.matching(spark, f"{c.path}/v=*")) == 2


def totals(spark, merge=None):
    return state.Merged(
        spark, work_dir(spark, "m"), "day string, k bigint, n bigint", F.col("day"), merge or state.added(["day", "k"], n=F.sum))


def part(spark, *rows):
    return spark.createDataFrame(rows, "day string, k bigint, n bigint")


def test_sums_are_added_once_even_if_a_batch_is_repeated(spark):
    t = totals(spark)
    t.merge(part(spark, ("a", 1, 1), ("b", 1, 5), (None, 1, 2)), 0)
    t.merge(part(spark, ("a", 1, 2), ("a", 2, 7)), 1)
    t.merge(part(spark, ("a", 1, 2), ("a", 2, 7)), 1)
    assert as_set(t.read()) == {("a", 1, 3), ("a", 2, 7), ("b", 1, 5), (None, 1, 2)}
    t.merge(part(spark), 2)
    assert t.read().count() == 4


def test_new_rows_take_the_place_of_old_ones(spark):
    t = totals(spark, state.replaced(["day", "k"]))
    t.merge(part(spark, ("a", 1, 1), ("a", 2, 1)), 0)
    t.merge(part(spark, ("a", 1, 9)), 1)
    assert as_set(t.read()) == {("a", 1, 9), ("a", 2, 1)}


def test_a_batch_reads_as_many_files_after_fifty_batches(spark):
    t, read = totals(spark), []
    for b in range(50):
        t.merge(part(spark, (f"d{b // 10}", b % 3, 1)).coalesce(1), b)
        read.append(t.files_read)
    assert max(read) <= 2
    assert t.read().agg(F.sum("n")).first()[0] == 50
    assert len(state.matching(spark, f"{t.path}/v=*/part=*")) <= 5 * 2


# Running counts


def test_running_series_resumes_and_counts_late_posts(spark, base, tmp_path):
    first, second, third = slices(base, 3)
    path, root = str(tmp_path / "in"), str(tmp_path / "run")
    first.coalesce(1).write.parquet(path)
    live.hourly_update(streams.file_stream(spark, path, base.schema), root=root)
    third.coalesce(1).write.mode("append").parquet(path)
    live.hourly_update(streams.file_stream(spark, path, base.schema), root=root)
    second.coalesce(1).write.mode("append").parquet(path)  # late
    got = live.hourly_update(streams.file_stream(spark, path, base.schema), root=root)
    want = base.groupBy(F.date_trunc("hour", "created_time").cast("timestamp_ntz")).count()
    assert as_set(got.select("bucket", "count")) == as_set(want)
    assert got.where("not full_unit").count() == 1


# Votes


@pytest.fixture(scope="module")
def voted(base):
    return as_set(online.online_votes(base, ORDER, DIMS, 200, *RULE).select("id", "seq", "n_close", "cl"))


@pytest.mark.parametrize("n", [1, 7])
def test_votes_do_not_depend_on_the_batches(spark, base, voted, n):
    votes = OnlineVotes(spark, ORDER, DIMS, 200, *RULE)
    for b, df in enumerate(slices(base, n)):
        votes.process(df, b)
    out = state.read_batches(spark, votes.out, "id string, seq bigint, n_close bigint, cl bigint")
    assert as_set(out) == voted
    assert len({r[3] for r in voted}) > 3
    assert votes.last.read().count() == 200


def test_votes_resume_after_a_restart_and_a_repeated_batch(spark, base, voted, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "run")
    first, second = slices(base, 2)
    first.coalesce(1).write.parquet(path)
    OnlineVotes(spark, ORDER, DIMS, 200, *RULE, root=root).run(streams.file_stream(spark, path, base.schema))
    second.coalesce(1).write.mode("append").parquet(path)
    votes = OnlineVotes(spark, ORDER, DIMS, 200, *RULE, root=root)
    got = votes.run(streams.file_stream(spark, path, base.schema))
    assert as_set(got) == voted
    votes.process(second, 1)
    assert as_set(state.read_batches(spark, votes.out, "id string, seq bigint, n_close bigint, cl bigint")) == voted


# Count windows


P = Detector(sigma=1.0, close=0.85, dense=3, eps=0.3, min_points=4)


def test_the_log_of_arrivals_stays_bounded_and_survives_a_restart(spark, base):
    df, root = base.withColumn("text", F.lit("#tide")), work_dir(spark, "detector")
    rows = []
    for b, s in enumerate(slices(df, 7)):
        WindowDetector(spark, 400, 100, P, root).process(s, b)  # a new object each time: all state is in the folder
        rows.append(spark.read.parquet(f"{root}/arrivals/batch=*/rows=*").count())
    assert max(rows) <= 400 + 2 * 100 and rows[-1] < 600 < df.count()
    whole = WindowDetector(spark, 400, 100, P)
    whole.process(df, 0)
    schema = "win bigint, cl bigint, posts bigint"
    want = as_set(state.read_batches(spark, whole.out, schema))
    assert as_set(state.read_batches(spark, f"{root}/events", schema)) == want and want


# Steps


def test_step_windows_are_given_once_and_late_posts_are_left_out(spark):
    def rows(*minutes):
        return spark.createDataFrame([(f"p{m}-{i}", T0 + dt.timedelta(minutes=m), f"l{m}") for i, m in enumerate(minutes)], "id string, created_time timestamp_ntz, link string")

    feed = live.StepImages(spark, limit=2, delay="30 minutes")
    feed.process(rows(1, 2, 3, 31), 0)
    assert feed.closed().count() == 0
    feed.process(rows(4, 95), 1)  # p4 still counts; the first two windows close after this
    assert {r["id"] for r in feed.closed().collect()} == {"p4-0", "p3-2", "p31-3"}
    feed.process(rows(5, 40, 70, 200), 2)  # 5 and 40 lie in windows that were given out
    feed.process(rows(5, 40, 70, 200), 2)
    got = {(r["id"], r["rank"]) for r in feed.closed().collect()}
    assert got == {("p4-0", 1), ("p3-2", 2), ("p31-3", 1), ("p70-2", 1), ("p95-1", 1)}
    assert {r["id"] for r in feed.open.read().collect()} == {"p200-3"}


def test_step_images_of_a_stream_equal_the_batch_form(spark, base):
    feed = live.StepImages(spark, "lat double", "1 day", 3)
    got = feed.run(streams.replay_stream(base.select("id", "created_time", "lat"), ORDER, 5))
    assert as_set(got.select("id", "start", "rank")) == as_set(live.step_images(base, "1 day", 3).select("id", "start", "rank"))


# Ticks


@pytest.mark.parametrize("files", [1, 6])
def test_ticks_of_a_stream_equal_the_tick_table(spark, base, files):
    bounds = ("2024-01-01", "2024-01-20")
    got = live.Ticker(spark, *bounds, 2.0, 6.0).run(streams.replay_stream(base, ORDER, files))
    assert as_set(got) == as_set(grid.ticks(base, *bounds, 2.0, 6.0))


def test_a_live_clock_follows_the_posts(spark):
    def at(*hours):
        return spark.createDataFrame([(str(h), T0 + dt.timedelta(hours=h)) for h in hours], "id string, created_time timestamp_ntz")

    clock = live.Ticker(spark, "2024-01-01", None, 1.0, 1.0)
    clock.process(at(0.5, 2.2), 0)
    assert [r["count"] for r in clock.given().orderBy("tick").collect()] == [1, 0]
    clock.process(at(1.5, 4.0), 1)  # the post at 1.5 is behind the clock: tick 2 was given out
    clock.process(at(1.5, 4.0), 1)
    assert [(r["tick"], r["count"]) for r in clock.given().orderBy("tick").collect()] == [(1, 1), (2, 0), (3, 1), (4, 1)]


# Sources and triggers


def test_replay_comes_in_order_one_file_to_a_batch(spark, base):
    seen = []
    stream = streams.replay_stream(base, ORDER, 5)
    q = start_batches(stream, "order", lambda df, b: seen.append(df.agg(F.min("created_time"), F.max("created_time"), F.count("*")).first()))
    q.awaitTermination()
    assert 4 <= len(seen) <= 6 and sum(r[2] for r in seen) == base.count()
    assert all(a[1] <= b[0] for a, b in zip(seen, seen[1:]))


def test_a_live_query_takes_a_trigger(spark, base, tmp_path):
    texts = base.withColumn("text", F.lit("tide tide")).limit(10)
    q = live.start_word_counts(streams.replay_stream(texts, ORDER, 1), str(tmp_path / "w"), every="1 second")
    try:
        q.processAllAvailable()
        assert q.isActive
    finally:
        q.stop()
    assert spark.read.parquet(str(tmp_path / "w" / "counts")).first()["count"] == 20


def test_newest_per_step_of_parts_is_that_of_the_whole(base):
    days = base.withColumn("start", F.date_trunc("day", "created_time").cast("timestamp_ntz"))
    parts = [live.newest_per_step(days.where(f"cast(id as int) % 2 = {k}"), 3).drop("rank") for k in (0, 1)]
    got = live.newest_per_step(parts[0].unionByName(parts[1]), 3)
    w = Window.partitionBy("start").orderBy(F.desc("created_time"), "id")
    assert as_set(got.select("id", "rank")) == as_set(days.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("id", "rank"))
