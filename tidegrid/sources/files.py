"""File sources and sinks: newline JSON, delimited text, parquet snapshots, images, replay slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions import timeops
from tidegrid.schema import POST_JSON


def time_range_scan(df: DataFrame, start: str, end: str, ts: str, tie: str) -> DataFrame:
    """Rows of a closed time range in time order (a range-partitioned sort, no single-task step)."""
    lo, hi = (F.lit(v).cast("timestamp_ntz") for v in (start, end))
    return df.where(F.col(ts).between(lo, hi)).orderBy(ts, tie)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per line; nested columns are kept. One compressed file per partition."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", "gzip").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def post_to_json(df: DataFrame) -> Column:
    """A post as the nested document that messages and exports carry (epoch seconds as text)."""
    sec = F.floor(F.unix_micros(F.col("created_time").cast("timestamp")) / F.lit(1000000)).cast("string")
    return F.struct(
        "id",
        sec.alias("created_time"),
        F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("location"),
        F.struct("text").alias("caption"),
        F.struct(F.col("user_id").cast("string").alias("username")).alias("user"),
        "tags",
        "link",
    )


def flatten_posts(docs: DataFrame) -> DataFrame:
    """Nested documents to the flat analysis frame; unreadable numbers become null."""
    return docs.select(
        "id",
        timeops.from_epoch("created_time").alias("created_time"),
        F.col("location.latitude").alias("lat"),
        F.col("location.longitude").alias("lon"),
        F.col("caption.text").alias("text"),
    )


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Newline JSON of posts, flattened. The schema is given, so no extra inference pass is made."""
    return flatten_posts(read_json(spark, path, POST_JSON))


def union_fill(*frames: DataFrame) -> DataFrame:
    """Append frames by column name; missing columns are filled with null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def save_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_dsv(df: DataFrame, path: str, sep: str = ",") -> None:
    w = df.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"')
    w.option("timestampNTZFormat", _MICROS).csv(path)


def read_dsv(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", multi_line: bool = False
) -> DataFrame:
    """Typed delimited text. Quoted fields may hold separators and doubled quotes.

    ``multi_line`` also allows line breaks in quoted fields, but then a file cannot be split.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("timestampNTZFormat", _MICROS)
        .csv(path)
    )


def list_scrapes(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Names of the sets of posts that exist and are on the allow list."""
    return df.select("scrape").where(F.col("scrape").isin(allowed)).distinct()


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images of a folder; unreadable files are skipped."""
    return spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", "*").load(path)


def write_features(features: DataFrame, path: str) -> None:
    """Name and feature values, one comma separated line per image."""
    n = 15
    features.select("name", *[F.col("features")[i].alias(f"f{i + 1}") for i in range(n)]).write.mode(
        "overwrite"
    ).csv(path)


def release_times(df: DataFrame, start: str, speed: float, ts: str = "created_time") -> DataFrame:
    """When a replay that runs ``speed`` times faster releases each post: seconds after its start."""
    t0 = F.unix_micros(F.lit(start).cast("timestamp_ntz").cast("timestamp"))
    wait = (F.unix_micros(F.col(ts).cast("timestamp")) - t0) / F.lit(speed * 1e6)
    return df.withColumn("release_sec", wait)


def write_replay(df: DataFrame, path: str, start: str, speed: float, slice_sec: float) -> None:
    """One folder per release slice; read back as a stream with ``maxFilesPerTrigger``."""
    timed = release_times(df, start, speed)
    sliced = timed.withColumn("slice", F.floor(F.col("release_sec") / F.lit(slice_sec)).cast("bigint"))
    sliced.repartition("slice").write.mode("overwrite").partitionBy("slice").parquet(path)


def head_by_time(df: DataFrame, n: int, ts: str = "created_time") -> DataFrame:
    """The first ``n`` rows in time order."""
    return df.orderBy(ts, "id").limit(n)
