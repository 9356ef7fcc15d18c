"""Canonical schemas and named parameter sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

POST = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("scrape", T.StringType()),
        T.StructField("created_time", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("link", T.StringType()),
        T.StructField("img_url", T.StringType()),
    ]
)

# A post as it travels in a message or an exported line; created_time is epoch seconds, often quoted.
POST_JSON = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("created_time", T.StringType()),
        T.StructField(
            "location",
            T.StructType(
                [
                    T.StructField("latitude", T.DoubleType()),
                    T.StructField("longitude", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("caption", T.StructType([T.StructField("text", T.StringType())])),
        T.StructField("user", T.StructType([T.StructField("username", T.StringType())])),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("link", T.StringType()),
    ]
)

MIN_MAX = T.StructType([T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType())])

EVENT = T.StructType(
    [
        T.StructField("win", T.LongType()),
        T.StructField("cl", T.LongType()),
        T.StructField("posts", T.LongType()),
        T.StructField(
            "hashtags",
            T.ArrayType(
                T.StructType([T.StructField("tag", T.StringType()), T.StructField("n", T.LongType())])
            ),
        ),
        T.StructField("lat", MIN_MAX),
        T.StructField("lon", MIN_MAX),
    ]
)


@dataclass(frozen=True)
class Box:
    """A geographic box; ``west > east`` means that it crosses the antimeridian."""

    south: float
    west: float
    north: float
    east: float


@dataclass(frozen=True)
class Detector:
    """Parameters of one density and clustering run."""

    sigma: float
    close: float
    dense: int
    eps: float
    min_points: int


# Parameters of the stream detector, the day batch and the two vote runs.
STREAM_DETECTOR = Detector(sigma=1.0, close=0.85, dense=25, eps=0.1, min_points=10)
DAY_DETECTOR = Detector(sigma=1.0, close=0.95, dense=50, eps=0.25, min_points=15)
DAY_VOTE = Detector(sigma=1.0, close=0.95, dense=40, eps=0.0, min_points=0)
ONLINE_VOTE = Detector(sigma=1.0, close=0.95, dense=30, eps=0.0, min_points=0)
ONLINE_MEMORY = 2000
WINDOW_ROWS, HOP_ROWS = 4000, 1000
CITY_BOX = Box(south=39.236, west=-76.72, north=39.373, east=-76.6)
GRID_PRECISION, DAY_GRID_PRECISION, GRID_LIMIT = 6, 7, 10000
TRENDING_LIMIT, IMAGE_LIMIT, TAG_LIMIT = 5, 10, 10
TRAILING_HOURS, STEP_HOURS = 1.0, 0.5
REPLAY_SPEED = 60 * 250
