"""Ranks, running sums and out-of-sample ranks without a single-task window."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import cut

_ROW_BITS = 33  # row number bits of monotonically_increasing_id


def join_on(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys``, where null equals null, so that rows of a null group keep their group."""
    there = b.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys])
    return a.join(there, same, how).drop(*[f"_same_{k}" for k in keys])


def numbered(df: DataFrame, order: list[str | Column], by: list[str] | None = None, name: str = "rn") -> DataFrame:
    """Add the 1-based row number over ``order`` (per ``by`` group), spread over all partitions.

    The rows are range-partitioned and sorted, so the partition and the place inside it give the
    number once the rows before each partition are known. Only one small row per partition and group
    passes through the offset window; a group that holds most rows is still spread over many tasks.
    The sorted rows are checkpointed because places and offsets must come from the same partitioning.
    """
    by = by or []
    keys = [F.col(b) for b in by] + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = cut(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_part", F.shiftright("_pos", _ROW_BITS))
    sizes = placed.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", *by, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return join_on(placed, offsets, ["_part", *by]).withColumn(
        name, F.col("_before") + F.col("_pos") - F.col("_first") + 1
    ).drop("_part", "_pos", "_first", "_before")


def running_sum(df: DataFrame, order: list[str], value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Add the sum of ``value`` over all rows up to and including this one in ``order`` (per group)."""
    by = by or []
    keys = [*by, *order]
    placed = cut(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_pos", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_pos", _ROW_BITS))
    sizes = placed.groupBy("_part", *by).agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", *by, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy("_part", *by).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_on(placed, offsets, ["_part", *by])
        .withColumn(name, F.col("_before") + F.sum(value).over(local))
        .drop("_part", "_pos", "_before")
    )


def previous(df: DataFrame, order: list[str], columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Add ``seq`` and ``prev_<column>``: the row before this one in ``order`` (null on the first).

    A lag that no single task carries: numbered rows are joined on (group, number), and those keys
    spread evenly however large one group is.
    """
    by = by or []
    seq = numbered(df, order, by, "seq")
    prev = seq.select(*by, (F.col("seq") + 1).alias("seq"), *[F.col(c).alias(f"prev_{c}") for c in columns])
    return join_on(seq, prev, [*by, "seq"], "left")


def rank_scaled(df: DataFrame, columns: list[str], tie: str) -> DataFrame:
    """Add ``r_<column>``: the unique rank of each value rescaled to [0, 1]; ties by ``tie``."""
    n = df.count()
    for c in columns:
        df = numbered(df, [c, tie], name="_rn").withColumn(
            f"r_{c}", (F.col("_rn") - 1) / F.lit(float(max(n - 1, 1)))
        ).drop("_rn")
    return df


def scaled_min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``s_<column>`` in [0, 1]; a column without spread gives 0."""
    lims = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(F.broadcast(lims))  # one row
    for c in columns:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        out = out.withColumn(f"s_{c}", F.when(span == 0, 0.0).otherwise((F.col(c) - F.col(f"_lo_{c}")) / span))
    return out.drop(*lims.columns)


def standardised(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Add ``z_<column>`` = (value - mean) / sample deviation, per ``by`` group; no spread gives 0.

    Means and deviations are one small row per group, joined back, so no group is gathered in a task.
    """
    by = by or []
    stats = df.groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_d_{c}") for c in columns]
    )
    out = join_on(df, stats, by) if by else df.join(F.broadcast(stats))
    for c in columns:
        d = F.col(f"_d_{c}")
        out = out.withColumn(
            f"z_{c}", F.when(F.coalesce(d, F.lit(0.0)) == 0, 0.0).otherwise((F.col(c) - F.col(f"_m_{c}")) / d)
        )
    return out.drop(*[c for c in stats.columns if c not in by])


def out_of_sample_rank(df: DataFrame, value: str, day: str, name: str) -> DataFrame:
    """Add the number of values of earlier days that are not above this one (0 on the first day).

    Every day is ranked against its own history at once. Distinct values get a dense number; the
    values up to a number are the union of at most one block of ``2^k`` numbers per level ``k``, so each
    (block, day) total is made once and each row adds up the blocks that cover its range. Work is
    n log n, all of it grouped sums and equi-joins on merged (value, day) rows.
    """
    per_day = df.groupBy(F.col(value).alias("_v"), F.col(day).alias("_day")).agg(F.count("*").alias("_n"))
    per_day = cut(per_day)
    values = numbered(per_day.select("_v").distinct(), ["_v"], name="_r")
    ranked = cut(per_day.join(values, "_v"))  # _r from 1
    top = ranked.agg(F.max("_r").alias("m")).first()["m"] or 1
    levels = F.sequence(F.lit(0), F.lit(int(top).bit_length()))
    blocks = (
        ranked.select("_r", "_day", "_n", F.explode(levels).alias("_k"))
        .groupBy("_k", F.expr("shiftright(_r - 1, _k)").alias("_b"), "_day")
        .agg(F.sum("_n").alias("_n"))
    )
    # Number r covers 1..r: one block below each set bit of r.
    need = (
        ranked.select("_v", "_r", "_day", F.explode(levels).alias("_k"))
        .where(F.expr("(shiftright(_r, _k) & 1) = 1"))
        .withColumn("_b", F.expr("shiftright(_r, _k) - 1"))
    )
    asked = need.select("_k", "_b", "_day", F.lit(0).cast("bigint").alias("_n")).distinct()
    earlier = Window.partitionBy("_k", "_b").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        blocks.unionByName(asked)
        .groupBy("_k", "_b", "_day")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_sum", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))  # at most one row per day
        .select("_k", "_b", "_day", "_sum")
    )
    counts = (
        need.join(totals, ["_k", "_b", "_day"])
        .groupBy("_v", "_day")
        .agg(F.sum("_sum").alias(name))
        .withColumnRenamed("_v", value)
        .withColumnRenamed("_day", day)
    )
    return df.join(counts, [value, day], "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def history_rank(history: DataFrame, target: DataFrame, value: str, name: str) -> DataFrame:
    """Add to ``target`` the number of ``history`` values that are not above its own value."""
    h = history.select(F.col(value).alias("_v")).groupBy("_v").agg(F.count("*").alias("_n"))
    t = target.select(F.col(value).alias("_v")).distinct().withColumn("_n", F.lit(0).cast("bigint"))
    merged = h.unionByName(t).groupBy("_v").agg(F.sum("_n").alias("_n"))
    ranks = running_sum(merged, ["_v"], "_n", name).select(F.col("_v").alias(value), name)
    return target.join(ranks, value, "left")


def last_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows per group. ``row_number() <= n`` is cut down inside each task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def count_windows(df: DataFrame, order: list[str], size: int, hop: int, by: list[str] | None = None) -> DataFrame:
    """Explode rows to the count windows that hold them: ``win`` (numbered by hop) and ``pos`` (1..size).

    A window fires after every ``hop`` arrivals once ``size`` rows exist and holds the last ``size`` rows.
    """
    by = by or []
    if size % hop:
        raise ValueError("the window must be a whole number of hops")
    seq = numbered(df, order, by, "seq")
    total = seq.groupBy(*by).agg(F.max("seq").alias("_total"))
    seq = join_on(seq, total, by) if by else seq.join(F.broadcast(total))
    per = size // hop
    first = F.greatest(F.ceil(F.col("seq") / F.lit(hop)).cast("bigint"), F.lit(per))
    last = F.least(
        F.ceil(F.col("seq") / F.lit(hop)).cast("bigint") + (per - 1), F.floor(F.col("_total") / F.lit(hop)).cast("bigint")
    )
    return (
        seq.withColumn("_a", first)
        .withColumn("_b", last)
        .where("_a <= _b")
        .withColumn("win", F.explode(F.sequence("_a", "_b")))
        .withColumn("pos", F.col("seq") - (F.col("win") * hop - size))
        .drop("_a", "_b", "_total")
    )
