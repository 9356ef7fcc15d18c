"""Stream sources and sinks. The same transformations run on files, Kafka topics or generated batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidegrid.functions import timeops
from tidegrid.schema import POST_JSON
from tidegrid.session import work_dir

EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """A table as a stream, be it one file or a folder of part files.

    The path is a pattern that only matches itself: a file stream takes one file only by a pattern.
    """
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")
    )


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def replay_stream(df: DataFrame, order: list[str], files: int) -> DataFrame:
    """A table as a stream in the order of some columns, one file to a batch.

    Rows are range-partitioned into about so many files, whose times are then set one after another, because a
    file stream takes files by time.
    """
    spark, path = df.sparkSession, work_dir(df.sparkSession, "replay")
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((s.getPath() for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*"))), key=str)
    for i, p in enumerate(found):
        fs.setTimes(p, 1_000_000_000_000 + 1000 * i, -1)
    return file_stream(spark, path, df.schema)


def kafka_stream(spark: SparkSession, servers: str, topics: list[str], start: str = "earliest", **options: str) -> DataFrame:
    """Messages of one or more topics as (topic, value, timestamp). Needs the Kafka connector on the class path.

    ``start`` only counts for a query without offsets; with its offsets folder kept it goes on where it stopped.
    """
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
    r = r.option("startingOffsets", start)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load().select("topic", F.col("value").cast("string").alias("value"), "timestamp")


def parse_posts(messages: DataFrame, value: str = "value") -> DataFrame:
    """Messages with a JSON array of posts to flat posts; messages that cannot be read give no rows."""
    items = messages.select(F.explode(F.from_json(value, T.ArrayType(POST_JSON))).alias("p"))
    return items.select(
        "p.id", timeops.from_epoch("p.created_time").alias("created_time"), F.col("p.user.username").alias("username"),
        F.col("p.location.latitude").alias("lat"), F.col("p.location.longitude").alias("lon"), F.col("p.caption.text").alias("text"),
    )


def to_messages(df: DataFrame, topic: str) -> DataFrame:
    """Rows as JSON messages for a topic."""
    return df.select(F.lit(topic).alias("topic"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_messages(messages: DataFrame, path: str) -> None:
    """Write (topic, value) rows to a folder for each topic, one message to a line."""
    messages.write.mode("overwrite").partitionBy("topic").text(path)


def kafka_sink(messages: DataFrame, servers: str, name: str, offsets: str | None = None) -> StreamingQuery:
    """Write (topic, value) rows; one pooled producer per executor, retries left to the client.

    Give the same ``offsets`` folder after a restart to go on where the query stopped.
    """
    return (
        messages.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", offsets or work_dir(messages.sparkSession, f"offsets-{name}"))
        .start()
    )


def console_sink(df: DataFrame, rows: int = 10) -> StreamingQuery:
    return df.writeStream.format("console").option("numRows", rows).option(
        "checkpointLocation", work_dir(df.sparkSession, "offsets-console")).start()


def forward(messages: DataFrame, topics: list[str], out: str) -> list[StreamingQuery]:
    """One query per topic, each writing its readable messages to a folder of JSON lines.

    Offsets lie beside the output, so a restart with the same ``out`` writes nothing twice.
    """
    started = []
    for t in topics:
        good = messages.where((F.col("topic") == t) & F.try_parse_json("value").isNotNull()).select("value")
        started.append(
            good.writeStream.format("text").option("path", f"{out}/{t}")
            .option("checkpointLocation", f"{out}/_offsets/{t}").trigger(availableNow=True).start()
        )
    return started
