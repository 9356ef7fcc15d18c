"""Vote clustering on a stream: each post joins a cluster of the posts shortly before it, or opens one.

Between batches only the last ``memory`` posts with their labels are carried on, and two numbers: how many posts
came and how many clusters were opened. Results do not depend on where batches begin and end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegrid.operators.online import online_step
from tidegrid.operators.rank import numbered
from tidegrid.session import cut, work_dir
from tidegrid.streaming.state import Carried, read_batches
from tidegrid.streaming.upsert import run_batches, start_batches


class OnlineVotes:
    """Feeds micro-batches into the vote: use :meth:`process` with ``foreachBatch``.

    A batch is numbered by ``order`` after all earlier batches. Everything lies below ``root``: with the same
    folder a new query goes on where one stopped.
    """

    def __init__(self, spark: SparkSession, order: list[str], dims: list[str], memory: int, sigma: float, close: float, dense: int,
                 root: str | None = None):
        self.order, self.dims, self.memory, self.rule = order, dims, memory, (sigma, close, dense)
        self.root = root or work_dir(spark, "votes")
        self.out = f"{self.root}/assigned"
        columns = ", ".join(f"{c} double" for c in dims)
        self.last = Carried(spark, f"{self.root}/memory", f"id string, seq bigint, {columns}, cl bigint")
        self.counts = Carried(spark, f"{self.root}/counts", "seen bigint, opened bigint")

    def process(self, df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        known = self.counts.before(batch).first()
        seen, opened = (known["seen"], known["opened"]) if known else (0, 0)
        rows = numbered(df.select(*dict.fromkeys(["id", *self.order, *self.dims])), self.order, name="seq")
        rows = rows.withColumn("seq", F.col("seq") + F.lit(seen))
        prior = self.last.before(batch)
        done = cut(online_step(rows, prior, seen, opened, self.dims, self.memory, *self.rule))
        done.select("id", "seq", "n_close", "cl").write.mode("overwrite").parquet(f"{self.out}/batch={batch}")
        most = done.agg(F.max("seq"), F.max("cl")).first()
        seen, opened = max(seen, most[0] or 0), max(opened, most[1] or 0)
        recent = prior.unionByName(done.drop("n_close")).where(F.col("seq") > seen - self.memory)
        self.last.write(recent, batch)
        self.counts.write(spark.createDataFrame([(seen, opened)], "seen bigint, opened bigint"), batch)

    def start(self, posts: DataFrame, every: str) -> StreamingQuery:
        return start_batches(posts, "votes", self.process, offsets=f"{self.root}/offsets", every=every)

    def run(self, posts: DataFrame) -> DataFrame:
        """Process everything available; returns all assignments so far: id, seq, n_close, cl."""
        run_batches(posts, "votes", self.process, offsets=f"{self.root}/offsets")
        return read_batches(posts.sparkSession, self.out, "id string, seq bigint, n_close bigint, cl bigint")
