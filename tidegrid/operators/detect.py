"""Event detection over count windows, and event summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators import density
from tidegrid.operators.rank import count_windows
from tidegrid.operators.words import top_tags
from tidegrid.schema import HOP_ROWS, STREAM_DETECTOR, WINDOW_ROWS, Detector
from tidegrid.session import cut


def detect_in_windows(windows: DataFrame, size: int = WINDOW_ROWS, p: Detector = STREAM_DETECTOR) -> DataFrame:
    """Clusters of the newest quarter of each count window: adds ``n_close`` and ``cl`` (0 = none).

    ``windows`` has win, pos (1..size), id, created_time, lat and lon. Positions are ranked against the
    first three quarters; posts with more than ``dense`` close posts are clustered by position. The ranking
    windows hold ``size`` rows by definition; everything else is joins and aggregates.
    """
    history = F.col("pos") <= F.lit(int(size * 0.75))

    def rank(c: str):
        upto = Window.partitionBy("win").orderBy(c).rangeBetween(Window.unboundedPreceding, 0)
        return F.sum(F.when(history, 1).otherwise(0)).over(upto)

    ranked = windows.withColumn("filat", rank("lat")).withColumn("filon", rank("lon")).where(~history)
    posts = ranked.select(
        "win", "pos", "id", "created_time", "lat", "lon", "filat", "filon",
        (F.unix_micros(F.col("created_time").cast("timestamp")) / F.lit(1e6)).alias("time"),
        (F.col("win") * size + F.col("pos")).alias("pid"),
    )
    close = cut(density.kernel_density(cut(posts), ["win"], ["filat", "filon"], "time", "pid", p.sigma, p.close))
    crowd = close.where(F.col("n_close") > p.dense).select("win", "pid", "lat", "lon")
    labels = density.dbscan(crowd, ["win"], ["lat", "lon"], "pid", p.eps, p.min_points).select("pid", "cl")
    return close.join(labels, "pid", "left").select(
        "win", "pos", "id", "created_time", "lat", "lon", "n_close", F.coalesce("cl", F.lit(0).cast("bigint")).alias("cl")
    )


def detect_events(posts: DataFrame, size: int = WINDOW_ROWS, hop: int = HOP_ROWS, p: Detector = STREAM_DETECTOR) -> DataFrame:
    """Run the detector on every full count window of a table of posts."""
    base = posts.select("id", "created_time", "lat", "lon")
    return detect_in_windows(count_windows(base, ["created_time", "id"], size, hop), size, p)


def event_summary(clustered: DataFrame, captions: DataFrame, keys: list[str]) -> DataFrame:
    """One event per cluster: posts, ranges of position, and its most frequent hashtags in falling order.

    ``captions`` has id and text; cluster 0 is left out.
    """
    members = clustered.where("cl <> 0")
    group = [*keys, "cl"]
    size = members.groupBy(*group).agg(
        F.count("*").alias("posts"),
        F.struct(F.min("lat").alias("min"), F.max("lat").alias("max")).alias("lat"),
        F.struct(F.min("lon").alias("min"), F.max("lon").alias("max")).alias("lon"),
    )
    tags = top_tags(members.select(*group, "id").join(captions.select("id", "text"), "id"), *group)
    listed = tags.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("rank", "tag", "n"))).alias("_t"))  # <= 10 each
    named = F.transform("_t", lambda t: F.struct(t["tag"].alias("tag"), t["n"].alias("n")))
    return size.join(listed, group, "left").select(*group, "posts", named.alias("hashtags"), "lat", "lon")
