"""Shards of nearly equal size from sampled splitters. DataFrame operations only.

Records are ordered by (hash of the text, hash of the id, place in the staged table), so equal texts are neighbours
and records that repeat id and text are still divisible. The number of ranges follows the number of records. A sample weighted by size gives splitters; records are
range-partitioned by them, ranges that turn out overfull are divided by splitters of their own, and exact
running sums over ranges of bounded size place every record.

Defined results: null text has no bytes (size 16, checksum 0); repeated rows are records of their own; ids
may be null or repeat (ties between identical records are interchangeable); an empty table gives no rows;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import stage, uniform

OVERHEAD = 16  # bytes that each record costs besides its text
RANGE_ROWS = 4_000_000  # records that a range holds on average at most
KEY = ("h", "g", "i")

Cut = tuple[int, int, int]


def records(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size, checksum and sort keys of each record: all that sharding moves."""
    t = F.col(text)
    return df.select(
        F.col(id).alias("doc_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)).cast("bigint") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(t).alias("h"),
        F.xxhash64(F.lit(7), F.col(id)).alias("g"),
        F.monotonically_increasing_id().alias("i"),
    )


def ranged(rows: DataFrame, cuts: list[Cut]) -> DataFrame:
    """``rows`` with ``r``: the number of splitters at or below the key, by binary search.

    The splitters are one constant array, so the plan and its code do not grow with them.
    """
    if not cuts:
        return rows.withColumn("r", F.lit(0))
    held = F.from_json(F.lit(json.dumps([dict(zip(KEY, c)) for c in cuts])), "array<struct<h bigint, g bigint, i bigint>>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])

    def step(r: Column, s: Column) -> Column:
        below = (r + s <= len(cuts)) & (F.get(held, r + s - 1) <= F.struct(*KEY))
        return F.when(below, r + s).otherwise(r)

    return rows.withColumn("r", F.aggregate(steps, F.lit(0), step))


def _sample(rows: DataFrame, rate: Column, seed: int) -> list[Cut]:
    """Keys of a sample that takes each record with chance ``rate``; its expected size is set by the caller."""
    picked = rows.where(uniform("doc_id", *KEY, seed=seed) < rate).select(*KEY)
    return sorted(tuple(r) for r in picked.collect())


def _quantiles(keys: list[Cut], parts: int) -> list[Cut]:
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def splitters(rows: DataFrame, ranges: int, per_range: int = 24, rounds: int = 2, range_rows: int = RANGE_ROWS) -> list[Cut]:
    """Range boundaries from a weighted sample of about ``ranges * per_range`` keys.

    There are at least ``ranges``, and one for every ``range_rows`` records. The weight is half the share of bytes and half the share of records, so ranges are even in both.
    A range of more than twice the even share is divided by a further sample of its own.
    The sample has a fixed number of keys per range.
    """
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return []
    ranges = max(ranges, -(-n // range_rows))
    weight = (F.col("size") / F.lit(float(total)) + F.lit(1.0 / n)) / 2
    found = _quantiles(_sample(rows, weight * (ranges * per_range), 1), ranges)
    for k in range(rounds):
        placed = ranged(rows, found)
        sums = {x["r"]: x["w"] for x in placed.groupBy("r").agg(F.sum(weight).alias("w")).collect()}
        over = {r: int(w * ranges) + 1 for r, w in sums.items() if w * ranges > 2}
        if not over:
            break
        keys = _sample(placed.where(F.col("r").isin(list(over))), weight * (ranges * per_range * 2), 2 + k)
        bounds = [None, *found, None]
        more = set(found)
        for r, parts in over.items():
            lo, hi = bounds[r], bounds[r + 1]
            more.update(_quantiles([x for x in keys if (lo is None or x >= lo) and (hi is None or x < hi)], parts))
        if len(more) == len(found):
            break
        found = sorted(more)
    return found


def shard(df: DataFrame, shards: int = 40, id: str = "doc_id", text: str = "text", ranges_per_shard: int = 4) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, shard (0 to shards - 1) and slot (0, 1, ... in its shard).

    A record belongs to the shard that holds the middle of its bytes in the global order. So shards are
    contiguous runs whose sizes differ by no more than about one record.
    """
    rows = stage(records(df, id, text), "shard-records")
    cuts = splitters(rows, shards * ranges_per_shard)
    in_range = ranged(rows, cuts)
    sums = in_range.groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("c"))
    # One row per range, so this window sees a bounded table.
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sums.select(
        "r", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"),
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.sum("b").over(every).alias("total"))
    inside = Window.partitionBy("r").orderBy(*KEY)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        in_range.withColumn("end", F.sum("size").over(upto))
        .withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(starts), "r")
    )
    twice_mid = 2 * (F.col("b0") + F.col("end")) - F.col("size")
    where = F.floor(twice_mid.cast("decimal(38,0)") * shards / (2 * F.col("total").cast("decimal(38,0)")))
    placed = stage(
        placed.select(
            "doc_id", "size", "text_crc32", F.least(where.cast("int"), F.lit(shards - 1)).alias("shard"),
            (F.col("c0") + F.col("nth") - 1).alias("at")),
        "shard-placed")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).cast("bigint").alias("slot"))
