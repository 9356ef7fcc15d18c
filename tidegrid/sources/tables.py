"""Table access, and geotagged posts derived from the ``events`` and ``documents`` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.text import hashtags


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def place(events: DataFrame) -> DataFrame:
    """Give each event a post id, scrape name and position (no text, no join)."""
    spot = F.col("event_type") == "purchase"
    e, u = F.col("event_id"), F.col("user_id")
    lat = F.when(spot, F.expr("39.284e0 + (event_id * 7919 % 100) / 1e5")).otherwise(
        F.expr("39.236e0 + ((event_id * 7919 + user_id * 104729) % 1370) / 1e4")
    )
    lon = F.when(spot, F.expr("-76.610e0 + (event_id * 6007 % 100) / 1e5")).otherwise(
        F.expr("-76.72e0 + ((event_id * 6007 + user_id * 15485863) % 1200) / 1e4")
    )
    return events.select(
        e.cast("string").alias("id"),
        F.concat(F.lit("s"), (u % 4).cast("string")).alias("scrape"),
        F.col("ts").alias("created_time"),
        "user_id",
        lat.alias("lat"),
        lon.alias("lon"),
        "event_id",
        "event_type",
        "props",
    )


def _text() -> Column:
    return F.concat(F.lit("#"), "event_type", F.lit(" "), "doc_text", F.lit(" #K"), F.get_json_object("props", "$.k"))


def caption(placed: DataFrame, documents: DataFrame) -> DataFrame:
    """Add the whole text of one document to each placed event.

    The number of documents comes from the file footers. Documents are cycled through by event
    number, so no document is joined much more often than another.
    """
    n_docs = documents.count()
    return (
        placed.withColumn("doc_id", F.col("event_id") % F.lit(n_docs))
        .join(documents.select("doc_id", F.col("text").alias("doc_text")), "doc_id")
        .select("id", "scrape", "created_time", "user_id", "lat", "lon", _text().alias("text"))
    )


def refer(placed: DataFrame, documents: DataFrame) -> DataFrame:
    """The rows of :func:`caption` with a reference to their text in place of it: doc_id and doc_hash."""
    n_docs = documents.count()
    return placed.withColumn("doc_id", F.col("event_id") % F.lit(n_docs)).join(
        documents.select("doc_id", F.xxhash64("text").alias("doc_hash")), "doc_id")


def resolve(referred: DataFrame, documents: DataFrame) -> DataFrame:
    """The text that :func:`caption` gives to rows with references, one row for each: id, text."""
    one = documents.select("doc_id", F.xxhash64("text").alias("doc_hash"), F.col("text").alias("doc_text")).dropDuplicates(["doc_id", "doc_hash"])
    return referred.join(one, ["doc_id", "doc_hash"]).select("id", _text().alias("text"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts without text: id, scrape, created_time, user_id, lat, lon."""
    return place(table(spark, sf_dir, "events")).drop("event_id", "event_type", "props")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole posts, with tags, link and image address."""
    df = caption(place(table(spark, sf_dir, "events")), table(spark, sf_dir, "documents"))
    return df.select(
        "*",
        hashtags("text").alias("tags"),
        F.concat(F.lit("https://posts.example/p/"), "id").alias("link"),
        F.concat(F.lit("https://posts.example/img/"), "id", F.lit(".jpg")).alias("img_url"),
    )


# The same two frames in DuckDB SQL, for the oracles.
POINTS_CTE = """
points as (
  select cast(event_id as varchar) as id, concat('s', cast(user_id % 4 as varchar)) as scrape,
         ts as created_time, user_id,
         case when event_type = 'purchase' then 39.284e0 + (event_id * 7919 % 100) / 1e5
              else 39.236e0 + ((event_id * 7919 + user_id * 104729) % 1370) / 1e4 end as lat,
         case when event_type = 'purchase' then -76.610e0 + (event_id * 6007 % 100) / 1e5
              else -76.72e0 + ((event_id * 6007 + user_id * 15485863) % 1200) / 1e4 end as lon
  from events)"""

POSTS_CTE = (
    POINTS_CTE
    + """,
posts as (
  select p.*, concat('#', e.event_type, ' ', d.text, ' #K', json_extract_string(e.props, '$.k')) as text,
         list_transform(list_filter(string_split(
           concat('#', e.event_type, ' ', d.text, ' #K', json_extract_string(e.props, '$.k')), ' '),
           lambda t: starts_with(t, '#')), lambda t: lower(t)) as tags,
         'https://posts.example/p/' || p.id as link,
         'https://posts.example/img/' || p.id || '.jpg' as img_url
  from points p join events e on cast(e.event_id as varchar) = p.id
  join documents d on d.doc_id = e.event_id % (select count(*) from documents))"""
)


def over_points(body: str, *ctes: str) -> str:
    return "with " + ",\n".join([POINTS_CTE, *ctes]) + "\n" + body


def over_posts(body: str, *ctes: str) -> str:
    return "with " + ",\n".join([POSTS_CTE, *ctes]) + "\n" + body
