"""Live queries over a stream of posts: word counts, sliding grids, step images, hourly counts, ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegrid.functions import geo
from tidegrid.operators import grid, words
from tidegrid.schema import GRID_PRECISION, IMAGE_LIMIT
from tidegrid.session import work_dir
from tidegrid.streaming.state import Carried, Merged, added, read_batches, replaced
from tidegrid.streaming.upsert import batch_writer, run_batches, start_batches


def _timed(posts: DataFrame, delay: str | None) -> DataFrame:
    """Event time with zone. With a ``delay``, rows that come later than it are left out and old state is freed."""
    timed = posts.withColumn("event_time", F.col("created_time").cast("timestamp"))
    return timed.withWatermark("event_time", delay) if delay else timed


def _day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _root(spark: SparkSession, root: str | None, name: str) -> str:
    return root or work_dir(spark, name)


# Words of each batch


def batch_word_counts(posts: DataFrame, min_count: int = 2) -> DataFrame:
    """Word counts of each micro-batch on its own, without state: (batch, word, count)."""
    out = work_dir(posts.sparkSession, "words")
    write = batch_writer(out)
    run_batches(posts, "words", lambda df, b: write(words.word_count(df, min_count=min_count), b))
    return posts.sparkSession.read.parquet(out)


def start_word_counts(posts: DataFrame, out: str, every: str = "120 seconds", min_count: int = 2) -> StreamingQuery:
    """The same for good: every so often the counts of what came since go to ``out``; offsets lie beside them."""
    write = batch_writer(f"{out}/counts")
    return start_batches(posts, "words", lambda df, b: write(words.word_count(df, min_count=min_count), b), offsets=f"{out}/offsets", every=every)


def running_word_counts(batches: DataFrame) -> DataFrame:
    """Total over all batches of per-batch counts."""
    return batches.groupBy("word").agg(F.sum("count").alias("count"))


# Counts per window


def sliding_cells(posts: DataFrame, length: str = "1 hour", step: str = "30 minutes", delay: str | None = None,
                  precision: int = GRID_PRECISION) -> DataFrame:
    """Geohash counts of a sliding window over event time (half-open windows), of a stream or of one batch."""
    return (
        _timed(posts, delay)
        .groupBy(F.window("event_time", length, step).alias("w"), geo.geohash_key("lat", "lon", precision).alias("_cell"))
        .agg(F.count("*").alias("count"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"),
            geo.geohash_text("_cell", precision).alias("cell"), "count",
        )
    )


def hourly_counts(posts: DataFrame, unit: str = "1 hour", delay: str | None = None) -> DataFrame:
    """Growing count per time unit, and the newest post it holds, of a stream or of one batch."""
    return (
        _timed(posts, delay)
        .groupBy(F.window("event_time", unit).alias("w"))
        .agg(F.count("*").alias("count"), F.max("event_time").alias("_newest"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("bucket"), F.col("w.end").cast("timestamp_ntz").alias("end"),
            "count", F.col("_newest").cast("timestamp_ntz").alias("newest"),
        )
    )


class RunningTable:
    """Counts per window as a table that is up to date after every batch.

    Without a ``delay`` every batch is counted on its own and added to the days it touches, so the stream keeps no
    state and late posts count however late they come. With one, Spark keeps the open windows, leaves later
    posts out, and each update replaces the window's last value.
    """

    def __init__(self, spark: SparkSession, schema: str, keys: list[str], aggregates: dict, day: str, count, root: str | None = None,
                 delay: str | None = None):
        self.root, self.count, self.delay = _root(spark, root, "running"), count, delay
        merge = replaced(keys) if delay else added(keys, **aggregates)
        self.table = Merged(spark, f"{self.root}/table", schema, _day(day), merge)

    def process(self, df: DataFrame, batch: int) -> None:
        df.persist()
        self.table.merge(df, batch)
        df.unpersist()

    def _plan(self, posts: DataFrame):
        if self.delay:
            return self.count(posts, delay=self.delay), self.process, "update"
        return posts, lambda df, b: self.process(self.count(df), b), "append"

    def start(self, posts: DataFrame, every: str) -> StreamingQuery:
        stream, each, mode = self._plan(posts)
        return start_batches(stream, "running", each, mode, f"{self.root}/offsets", every)

    def run(self, posts: DataFrame) -> DataFrame:
        stream, each, mode = self._plan(posts)
        run_batches(stream, "running", each, mode, f"{self.root}/offsets")
        return self.table.read()


def grid_table(spark: SparkSession, root: str | None = None, delay: str | None = None, **kw) -> RunningTable:
    """Running geohash counts of sliding windows: start, end, cell, count."""
    return RunningTable(
        spark, "start timestamp_ntz, end timestamp_ntz, cell string, count bigint", ["start", "end", "cell"], {"count": F.sum},
        "start", lambda df, **d: sliding_cells(df, **d, **kw), root, delay)


def series_table(spark: SparkSession, root: str | None = None, delay: str | None = None, **kw) -> RunningTable:
    """Running counts per time unit: bucket, end, count, newest."""
    return RunningTable(
        spark, "bucket timestamp_ntz, end timestamp_ntz, count bigint, newest timestamp_ntz", ["bucket", "end"],
        {"count": F.sum, "newest": F.max}, "bucket", lambda df, **d: hourly_counts(df, **d, **kw), root, delay)


def with_full_units(series: DataFrame) -> DataFrame:
    """bucket, count, and whether a post at or after the unit's end was seen."""
    clock = series.agg(F.max("newest").alias("_now"))
    return series.join(F.broadcast(clock)).select("bucket", "count", (F.col("end") <= F.col("_now")).alias("full_unit"))


def sliding_grid(posts: DataFrame, root: str | None = None, delay: str | None = None, **kw) -> DataFrame:
    """Run :func:`grid_table` over the available data; returns the counts."""
    return grid_table(posts.sparkSession, root, delay, **kw).run(posts)


def hourly_update(posts: DataFrame, root: str | None = None, delay: str | None = None, **kw) -> DataFrame:
    """The running series after all available data: bucket, count, and whether the unit is complete."""
    return with_full_units(series_table(posts.sparkSession, root, delay, **kw).run(posts))


# Newest posts per step


def newest_per_step(posts: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` posts of each ``start``. Applied to parts first and to their union then, it gives the same."""
    w = Window.partitionBy("start").orderBy(F.desc("created_time"), "id")
    return posts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def _step(step: str) -> Column:
    return F.window(F.col("created_time").cast("timestamp"), step)


def step_images(posts: DataFrame, step: str = "30 minutes", limit: int = IMAGE_LIMIT) -> DataFrame:
    """The newest ``limit`` posts of every step window (batch form of the image feed)."""
    return newest_per_step(posts.withColumn("start", _step(step)["start"].cast("timestamp_ntz")), limit)


class StepImages:
    """The image feed of a stream: each step window is given out once, when the watermark passes its end.

    Open windows are carried from batch to batch with ``limit`` posts each. The watermark is the newest time
    of earlier batches less ``delay``; posts of windows that it has passed come too late and are left out.
    """

    def __init__(self, spark: SparkSession, columns: str = "link string", step: str = "30 minutes", limit: int = IMAGE_LIMIT,
                 delay: str = "1 hour", root: str | None = None):
        self.spark, self.step, self.limit, self.delay = spark, step, limit, delay
        self.root = _root(spark, root, "images")
        self.columns = ["id", "created_time", *[c.strip().split(" ")[0] for c in columns.split(",") if c.strip()]]
        schema = f"id string, created_time timestamp_ntz, {columns}, start timestamp_ntz, end timestamp_ntz, rank int"
        self.open = Carried(spark, f"{self.root}/open", schema)
        self.clock = Carried(spark, f"{self.root}/clock", "newest timestamp_ntz")
        self.out, self.schema = f"{self.root}/closed", schema

    def process(self, df: DataFrame, batch: int) -> None:
        passed = F.col("newest") - F.expr(f"interval {self.delay}")
        clock = F.broadcast(self.clock.before(batch).agg(F.max("newest").alias("newest")))
        w = _step(self.step)
        new = df.select(*self.columns, w["start"].cast("timestamp_ntz").alias("start"), w["end"].cast("timestamp_ntz").alias("end"))
        new = new.crossJoin(clock).where(F.col("newest").isNull() | (F.col("end") > passed)).drop("newest")  # one row
        self.clock.write(df.select(F.col("created_time").alias("newest")).unionByName(self.clock.before(batch)).agg(F.max("newest").alias("newest")), batch)
        old = self.open.before(batch).drop("rank")
        best = newest_per_step(newest_per_step(new, self.limit).drop("rank").unionByName(old), self.limit)
        best = best.persist()
        now = F.broadcast(self.clock.before(batch + 1))
        best.crossJoin(now).where(F.col("end") <= passed).drop("newest").write.mode("overwrite").parquet(f"{self.out}/batch={batch}")
        self.open.write(best.crossJoin(now).where(F.col("newest").isNull() | (F.col("end") > passed)).drop("newest"), batch)
        best.unpersist()

    def closed(self) -> DataFrame:
        return read_batches(self.spark, self.out, self.schema)

    def start(self, posts: DataFrame, every: str) -> StreamingQuery:
        return start_batches(posts, "images", self.process, offsets=f"{self.root}/offsets", every=every)

    def run(self, posts: DataFrame) -> DataFrame:
        """Everything available; the windows still open at the end are given too."""
        run_batches(posts, "images", self.process, offsets=f"{self.root}/offsets")
        return self.closed().unionByName(self.open.read())


# Ticks of a clock


class Ticker:
    """A clock that advances with the stream: every tick is given out once, with its trailing count.

    Ticks lie ``step_hours`` apart after ``start``. Each batch adds its posts to the ticks they fall under, and
    gives out the ticks up to the newest time seen; posts behind the clock count for later ticks only. With an
    ``end`` the clock stops there; without one it goes on as long as posts come.
    """

    def __init__(self, spark: SparkSession, start: str, end: str | None, trailing_hours: float = 1.0, step_hours: float = 0.5,
                 root: str | None = None):
        self.spark, self.begin, self.end, self.trailing, self.step = spark, start, end, trailing_hours, step_hours
        self.root = _root(spark, root, "ticks")
        self.out = f"{self.root}/given"
        self.counts = Merged(
            spark, f"{self.root}/counts", "tick bigint, count bigint", F.floor(F.col("tick") / F.lit(1000)).cast("bigint"), added(["tick"], count=F.sum))
        self.clock = Carried(spark, f"{self.root}/clock", "tick bigint")

    def _last(self) -> int | None:
        return None if self.end is None else grid.tick_number(self.spark, self.begin, self.end, self.step)

    def process(self, df: DataFrame, batch: int) -> None:
        hits = grid.tick_hits(df, self.begin, self._last(), self.trailing, self.step).persist()
        self.counts.merge(hits, batch)
        hits.unpersist()
        given = self.clock.before(batch).first()
        given = given[0] if given else 0
        newest = df.agg(F.max(grid.ticks_since(F.col("created_time"), self.begin, self.step))).first()[0]
        now = max(given, min(x for x in (given if newest is None else newest, self._last()) if x is not None))
        self._give(given, now, batch)

    def _give(self, given: int, now: int, batch: int) -> None:
        due = self.spark.range(given + 1, now + 1).withColumnRenamed("id", "tick")
        rows = due.join(self.counts.read(), "tick", "left")
        grid.tick_rows(rows, self.begin, self.step).write.mode("overwrite").parquet(f"{self.out}/batch={batch}")
        self.clock.write(self.spark.createDataFrame([(now,)], "tick bigint"), batch)

    def given(self) -> DataFrame:
        return read_batches(self.spark, self.out, "tick bigint, now timestamp_ntz, count bigint")

    def start(self, posts: DataFrame, every: str) -> StreamingQuery:
        return start_batches(posts, "ticks", self.process, offsets=f"{self.root}/offsets", every=every)

    def run(self, posts: DataFrame) -> DataFrame:
        """Everything available; a clock with an end then runs on to it."""
        run_batches(posts, "ticks", self.process, offsets=f"{self.root}/offsets")
        rows = self.given()
        last, given = self._last(), self.clock.read().first()
        if last is None:
            return rows
        rest = self.spark.range((given[0] if given else 0) + 1, last + 1).withColumnRenamed("id", "tick").join(self.counts.read(), "tick", "left")
        return rows.unionByName(grid.tick_rows(rest, self.begin, self.step))
