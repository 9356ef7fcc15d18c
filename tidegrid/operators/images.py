"""Colour features of images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANNELS, COLOUR_BINS = 3, 5


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _histogram(pixels: pd.Series) -> pd.Series:
    """Counts of five equal colour ranges for red, green and blue, divided by their total."""
    def one(raw):
        if not raw:
            return None
        v = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
        channel = CHANNELS - 1 - np.arange(v.size) % CHANNELS  # stored blue first
        counts = np.bincount(channel * COLOUR_BINS + v * COLOUR_BINS // 256, minlength=CHANNELS * COLOUR_BINS)
        return counts / v.size

    return pixels.map(one)


def color_histogram(images: DataFrame, name: str = "name", data: str = "data") -> DataFrame:
    """15 colour features per image: (name, features)."""
    return images.select(name, _histogram(F.col(data)).alias("features"))


def image_rows(source: DataFrame) -> DataFrame:
    """Rows of the image source as (name, data); only three-channel images qualify."""
    return source.where(F.col("image.nChannels") == CHANNELS).select(
        F.element_at(F.split("image.origin", "/"), -1).alias("name"), F.col("image.data").alias("data")
    )
