"""Tables that batches of a stream hand on to each other, kept in the shared folder.

Each batch writes a version of its own, and what it reads comes from versions before it. So a batch that is
repeated after a failure finds the state as it was, and replaces what its first attempt wrote. Versions that no
repeat can ask for any more are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of a pattern; none if the folder does not exist."""
    fs, p = _fs(spark, pattern)
    return sorted(str(s.getPath()) for s in fs.globStatus(p) or [])


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def read_batches(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """What batches wrote to their folders; empty if there are none."""
    paths = matching(spark, f"{out}/batch=*")
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def version(path: str) -> int:
    """Batch number of a path with a ``v=`` folder."""
    return int(path.split("/v=")[1].split("/")[0])


class Carried:
    """A whole table that one batch hands to the next; meant for state of bounded size."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def before(self, batch: int) -> DataFrame:
        """What the last batch before this one wrote; empty for the first."""
        return self._read([p for p in self._versions() if version(p) < batch][-1:])

    def read(self) -> DataFrame:
        return self._read(self._versions()[-1:])

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={batch}")
        for p in [p for p in self._versions() if version(p) < batch][:-1]:
            delete(self.spark, p)

    def _versions(self) -> list[str]:
        return sorted(matching(self.spark, f"{self.path}/v=*"), key=version)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)


Merge = Callable[[DataFrame, DataFrame], DataFrame]


def added(keys: list[str], **aggregates: Callable[[str], Column]) -> Merge:
    """Old and new rows of a key become one by the given aggregates (of partial results: sums, greatest, ..)."""
    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new).groupBy(*keys).agg(*[f(c).alias(c) for c, f in aggregates.items()])

    return merge


def replaced(keys: list[str]) -> Merge:
    """New rows take the place of old ones with the same key."""
    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))

    return merge


class Merged:
    """A table that grows with the stream, kept in parts. A batch reads and rewrites only the parts it touches.

    ``part`` gives a row's part as text that can stand in a path, such as a day.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, part: Column, merge: Merge):
        self.spark, self.path, self.schema = spark, path, schema
        self.part, self.how = F.coalesce(part.cast("string"), F.lit("none")), merge
        self.files_read = 0  # by the last merge

    def merge(self, new: DataFrame, batch: int) -> None:
        """Merge partial results of a batch, one row per key. They are read twice, so pass something cheap or staged."""
        new = new.select(*self._columns())
        touched = {r[0] for r in new.select(self.part.alias("p")).distinct().collect()}  # a few days, not rows
        if not touched:
            return
        kept = {p: [x for x in paths if version(x) != batch] for p, paths in self._parts().items() if p in touched}
        old = [[x for x in paths if version(x) < batch][-1] for paths in kept.values() if any(version(x) < batch for x in paths)]
        self.files_read = sum(len(matching(self.spark, f"{p}/part-*")) for p in old)
        rows = self.how(self._read(old), new).select(*self._columns()) if old else new
        rows = rows.withColumn("part", self.part)
        rows.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/v={batch}")
        for paths in kept.values():
            for stale in [x for x in paths if version(x) < batch][:-1]:
                delete(self.spark, stale)

    def read(self) -> DataFrame:
        """The newest version of every part."""
        return self._read([paths[-1] for paths in self._parts().values()])

    def _columns(self) -> list[str]:
        return [c.strip().split(" ")[0] for c in self.schema.split(",")]

    def _parts(self) -> dict[str, list[str]]:
        """Paths of each part, oldest first."""
        out: dict[str, list[str]] = {}
        for p in sorted(matching(self.spark, f"{self.path}/v=*/part=*"), key=version):
            out.setdefault(p.rsplit("part=", 1)[1], []).append(p)
        return out

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
