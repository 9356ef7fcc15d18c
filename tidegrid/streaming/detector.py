"""Count-window event detection on a stream.

Arrivals are numbered and appended to a log table in the shared folder. A window fires after every ``hop``
arrivals once ``size`` rows exist and reads its rows back from the log, so the stream keeps no rows in
memory, and a repeated batch finds the log as it was before its first attempt. Batches of the log that no
window to come can reach are deleted, so the log holds about one window and the newest batches. Log, count of
arrivals, events and offsets lie below one folder: with the same folder a new query goes on where one stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegrid.operators import detect
from tidegrid.operators.rank import numbered
from tidegrid.schema import HOP_ROWS, STREAM_DETECTOR, WINDOW_ROWS, Detector
from tidegrid.session import release, stage, work_dir
from tidegrid.streaming.state import Carried, delete, matching, read_batches
from tidegrid.streaming.upsert import run_batches, start_batches

_POST = ["id", "created_time", "lat", "lon"]
_EVENTS = (
    "win bigint, cl bigint, posts bigint, hashtags array<struct<tag:string,n:bigint>>, "
    "lat struct<min:double,max:double>, lon struct<min:double,max:double>"
)


class WindowDetector:
    """Feeds micro-batches into the detector: use :meth:`process` with ``foreachBatch``.

    Posts carry their text, or the columns from which ``captions`` finds it: given rows of them, it returns id and text
    of each. Texts are only asked for, and only moved, for posts of clusters.
    """

    def __init__(self, spark: SparkSession, size: int = WINDOW_ROWS, hop: int = HOP_ROWS, p: Detector = STREAM_DETECTOR,
                 root: str | None = None, columns: str = "text string", captions: Callable[[DataFrame], DataFrame] | None = None):
        self.size, self.hop, self.p = size, hop, p
        self.schema = f"id string, created_time timestamp_ntz, lat double, lon double, {columns}, seq bigint"
        self.columns = [c.strip().split(" ")[0] for c in columns.split(",")]
        self.captions = captions or (lambda rows: rows.select("id", "text"))
        self.root = root or work_dir(spark, "detector")
        self.log, self.out = f"{self.root}/arrivals", f"{self.root}/events"
        self.totals = Carried(spark, f"{self.root}/totals", "total bigint")

    def _logged(self, spark: SparkSession, batch: int) -> list[tuple[int, int, str]]:
        """(first, last, path) of the rows of each kept batch up to this one; they stand in the folder names."""
        found = []
        for path in matching(spark, f"{self.log}/batch=*/rows=*"):
            first, last = path.rsplit("rows=", 1)[1].split("-")
            if int(path.split("/batch=")[1].split("/")[0]) <= batch:
                found.append((int(first), int(last), path))
        return sorted(found)

    def process(self, df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        before = self.totals.before(batch).first()
        seen = before["total"] if before else 0
        new = numbered(df.select(*_POST, *self.columns), ["created_time", "id"], name="seq")
        total = seen + new.count()
        delete(spark, f"{self.log}/batch={batch}")
        if total > seen:
            new.withColumn("seq", F.col("seq") + F.lit(seen)).write.parquet(f"{self.log}/batch={batch}/rows={seen + 1}-{total}")
        self._fire(spark, seen, total, batch)
        self.totals.write(spark.createDataFrame([(total,)], "total bigint"), batch)
        # A repeat of this batch starts from ``seen``; no window after that reaches further back.
        oldest = self._first_window(seen) * self.hop - self.size
        for _, last, path in self._logged(spark, batch):
            if last <= oldest:
                delete(spark, path.rsplit("/rows=", 1)[0])

    def _first_window(self, seen: int) -> int:
        return max(seen // self.hop + 1, self.size // self.hop)

    def _fire(self, spark: SparkSession, seen: int, total: int, batch: int) -> None:
        first, last = self._first_window(seen), total // self.hop
        if first > last:
            return
        low, high = first * self.hop - self.size, last * self.hop
        paths = [p for a, b, p in self._logged(spark, batch) if b > low and a <= high]
        rows = spark.read.schema(self.schema).parquet(*paths).where((F.col("seq") > low) & (F.col("seq") <= high))
        a = F.greatest(F.ceil(F.col("seq") / F.lit(self.hop)).cast("bigint"), F.lit(first))
        b = F.least(F.ceil(F.col("seq") / F.lit(self.hop)).cast("bigint") + (self.size // self.hop - 1), F.lit(last))
        windows = rows.withColumn("win", F.explode(F.sequence(a, b))).withColumn(
            "pos", F.col("seq") - (F.col("win") * self.hop - self.size)
        )
        found = stage(detect.detect_in_windows(windows.drop(*self.columns), self.size, self.p).where("cl <> 0"), "found")
        told = rows.join(found.select("id").distinct(), "id", "left_semi")
        events = detect.event_summary(found, self.captions(told), ["win"])
        # Its shuffle files, with the texts of clustered posts, go with the staged copy of a few rows per window.
        events = stage(events, "events")
        events.write.mode("overwrite").parquet(f"{self.out}/batch={batch}")
        release(events)
        release(found)

    def start(self, posts: DataFrame, every: str) -> StreamingQuery:
        return start_batches(posts, "detector", self.process, offsets=f"{self.root}/offsets", every=every)

    def run(self, posts: DataFrame) -> DataFrame:
        """Process everything available; returns the events so far."""
        run_batches(posts, "detector", self.process, offsets=f"{self.root}/offsets")
        return read_batches(posts.sparkSession, self.out, _EVENTS)
