"""Distribution statistics, histograms, classes, nesting and set operations over tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.binning import equal_bin, sturges
from tidegrid.operators.rank import join_on, numbered, previous, running_sum
from tidegrid.session import cut


def clean(x: Column | str) -> Column:
    """A number, or null where the value is missing, not a number, or unreadable text."""
    c = F.col(x) if isinstance(x, str) else x
    n = c.try_cast("double")
    return F.when(~F.isnan(n), n)


def extent(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    v = clean(value)
    return df.groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max"))


def sum_mean(df: DataFrame, value: Column | str, by: list[str]) -> DataFrame:
    v = clean(value)
    return df.groupBy(*by).agg(F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.count(v).alias("n"))


def quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per group with ``n`` and ``q0, q1, ...``.

    Equal values are merged, a distributed running count places them, and each wanted position picks
    its two neighbours in one grouped maximum. No task ever holds a group's values.
    """
    by = by or []
    merged = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    ranked = running_sum(merged, [value], "_c", "_end", by)
    n = merged.groupBy(*by).agg(F.sum("_c").alias("n"))
    ranked = join_on(ranked, n, by) if by else ranked.join(F.broadcast(n))  # without groups: one row

    def at(index: Column) -> Column:
        holds = (index >= F.col("_end") - F.col("_c")) & (index < F.col("_end"))
        return F.max(F.when(holds, F.col(value)))

    aggs = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(float(p))
        aggs += [at(F.floor(h)).alias(f"_lo{i}"), at(F.floor(h) + 1).alias(f"_hi{i}")]
    picked = ranked.groupBy(*by, "n").agg(*aggs)
    out = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + (F.coalesce(hi, lo) - lo) * (h - F.floor(h))).alias(f"q{i}"))
    return picked.select(*by, "n", *out)


def histogram(df: DataFrame, value: str, bins: int | None = None) -> DataFrame:
    """Equal-width histogram with ``x`` (left edge), ``dx``, frequency and probability; empty bins kept.

    Without ``bins`` the number follows the size of the data (Sturges).
    """
    v = df.where(F.col(value).isNotNull())
    lims = v.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n"))
    k = F.lit(bins).cast("bigint") if bins else sturges(F.col("n"))
    lims = cut(lims.withColumn("k", k))  # one row
    counts = (
        v.join(F.broadcast(lims))
        .groupBy(equal_bin(F.col(value), F.col("lo"), F.col("hi"), F.col("k")).alias("bin"))
        .agg(F.count("*").alias("c"))
    )
    width = (F.col("hi") - F.col("lo")) / F.col("k")
    spine = lims.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("bin"))
    c = F.coalesce("c", F.lit(0).cast("bigint"))
    return spine.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + width * F.col("bin")).alias("x"), width.alias("dx"),
        c.alias("frequency"), (c / F.col("n")).alias("probability"),
    )


def cumulative_bins(df: DataFrame, value: str, bins: int, name: str) -> DataFrame:
    """Add ``bin`` and the number of rows in this and all lower bins. The running total sees one row per bin."""
    lims = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    binned = df.join(F.broadcast(lims)).withColumn(
        "bin", equal_bin(F.col(value), F.col("_lo"), F.col("_hi"), bins)
    ).drop("_lo", "_hi")
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    table = binned.groupBy("bin").agg(F.count("*").alias("_c")).select("bin", F.sum("_c").over(upto).alias(name))
    return binned.join(F.broadcast(table), "bin")  # at most ``bins`` rows


def nested_bins(df: DataFrame, outer: int = 10, inner: int = 3) -> DataFrame:
    """Counts per outer cell, inner cell and day; inner edges follow the data of each outer cell."""
    lims = df.agg(*[f(c).alias(f"_{n}_{c}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(F.broadcast(lims))
    for c in ("lat", "lon"):
        out = out.withColumn(f"{c}_bin", equal_bin(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), outer))
    out = out.drop(*lims.columns)
    cell = ["lat_bin", "lon_bin"]
    inside = out.groupBy(*cell).agg(
        *[f(c).alias(f"_{n}_{c}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))]
    )
    out = out.join(F.broadcast(inside), cell)  # at most outer * outer rows
    for c in ("lat", "lon"):
        out = out.withColumn(f"{c}_sub", equal_bin(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), inner))
    return out.groupBy(*cell, "lat_sub", "lon_sub", F.to_date("created_time").alias("day")).agg(
        F.count("*").alias("count")
    )


def zero_filled_days(counts: DataFrame, keys: list[str]) -> DataFrame:
    """All days of the data for each key that occurs, 0 where nothing was counted."""
    span = counts.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    keyed = counts.select(*keys).distinct().join(F.broadcast(span))
    full = keyed.select(*keys, F.explode(F.sequence("a", "b")).alias("day"))
    return full.join(counts, [*keys, "day"], "left").withColumn(
        "count", F.coalesce("count", F.lit(0).cast("bigint"))
    )


def day_distances(counts: DataFrame, key: str, day: str, days: list) -> DataFrame:
    """Euclidean distance between the cell-count vectors of every two days (one row per day pair).

    Each task adds up the products of its cells in one days x days matrix and emits it once, so the
    shuffle carries day pairs only, however many cells there are.
    """
    wide = counts.groupBy(key).pivot(day, days).agg(F.sum("count"))
    vec = F.array(*[F.coalesce(F.col(f"`{d}`"), F.lit(0)).cast("double") for d in days]).alias("v")
    n = len(days)

    def products(batches):
        total = np.zeros((n, n))
        for b in batches:
            if len(b):
                m = np.stack(b["v"].to_numpy())
                total += m.T @ m
        i, j = np.triu_indices(n)
        yield pd.DataFrame({"i": i, "j": j, "p": total[i, j]})

    sums = wide.select(vec).mapInPandas(products, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p"))
    sums = cut(sums)
    own = sums.where("i = j")
    names = F.array(*[F.lit(d) for d in days])
    return (
        sums.where("i < j")
        .join(own.select("i", F.col("p").alias("pi")), "i")
        .join(own.select(F.col("i").alias("j"), F.col("p").alias("pj")), "j")
        .select(
            names[F.col("i")].alias("day_a"), names[F.col("j")].alias("day_b"),
            F.sqrt(F.col("pi") + F.col("pj") - 2 * F.col("p")).alias("distance"),
        )
    )


def nest(df: DataFrame, outer: str, inner: str, **aggs: Column) -> DataFrame:
    """Two-level grouping: one row per outer key with its sorted inner groups."""
    flat = df.groupBy(outer, inner).agg(*[c.alias(k) for k, c in aggs.items()])
    return flat.groupBy(outer).agg(F.array_sort(F.collect_list(F.struct(inner, *aggs))).alias("values"))


def pairs(df: DataFrame, order: list[str], columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Consecutive pairs: each row with the row before it."""
    return previous(df, order, columns, by).where("seq > 1")


def transpose(df: DataFrame, row: str, column: str, value: str, columns: list | None = None) -> DataFrame:
    """Turn a tall table into one with the values of ``column`` as columns: all that occur, or those named.

    A table has a limited width; Spark refuses more than ``spark.sql.pivotMaxValues`` columns.
    """
    return df.groupBy(row).pivot(column, columns).agg(F.sum(value)).na.fill(0)


def permute(df: DataFrame, places: DataFrame, place: str = "place") -> DataFrame:
    """Row numbers of ``df`` (column ``place``, from 0) taken in the order of ``places`` (``to``, ``place``)."""
    return places.join(df, place).select("to", *[c for c in df.columns if c != place])


def hash_sample(df: DataFrame, key: str, share: float) -> DataFrame:
    """A repeatable sample of about ``share`` of the rows, by a digest of the key; keys may be of any type."""
    digest = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8)
    return df.where(digest < F.lit(f"{int(share * 2**32):08x}")) if share < 1 else df


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A repeatable random order: ``place`` from 1, by a digest of the key, which may be of any type."""
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return numbered(df, [digest, F.col(key)], name="place").orderBy("place")


def stacked(series: DataFrame, x: str, name: str, value: str, names: list[str] | None = None, offset: str = "zero") -> DataFrame:
    """Stacked series: each value with its base line ``y0`` for one of four offsets.

    ``zero`` starts at 0, ``expand`` scales every column to 1, ``silhouette`` centres the columns and
    ``wiggle`` keeps the weighted slope of the layers small. Missing points count as 0. Layers are all
    names that occur, in order, unless given; like any pivot they are limited in number.
    """
    if names is None:
        names = [r[name] for r in series.where(F.col(name).isNotNull()).select(name).distinct().orderBy(name).collect()]
    wide = series.groupBy(x).pivot(name, names).agg(F.sum(value)).na.fill(0)
    entry = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(n).alias(name), F.col(f"`{n}`").cast("double").alias("y")) for i, n in enumerate(names)]
    )
    tall = wide.select(x, entry.alias("layers"))
    total = F.aggregate("layers", F.lit(0.0), lambda a, e: a + e["y"])
    tall = tall.withColumn("_total", total)
    zero = F.lit(0.0)
    if offset == "expand":
        share = F.transform(
            "layers",
            lambda e: F.struct(
                e["i"].alias("i"), e[name].alias(name),
                F.when(F.col("_total") == 0, 1.0 / len(names)).otherwise(e["y"] / F.col("_total")).alias("y"),
            ),
        )
        tall = tall.withColumn("layers", share).withColumn("_base", zero)
    elif offset == "silhouette":
        peak = tall.agg(F.max("_total").alias("_peak"))
        tall = tall.join(F.broadcast(peak)).withColumn("_base", (F.col("_peak") - F.col("_total")) / 2).drop("_peak")
    elif offset == "wiggle":
        tall = _wiggle(tall, x, len(names))
    elif offset == "zero":
        tall = tall.withColumn("_base", zero)
    else:
        raise ValueError(f"unknown offset {offset!r}")
    below = F.aggregate(
        F.slice("layers", 1, F.col("e.i")), F.lit(0.0), lambda a, b: a + b["y"]
    )
    return tall.select("*", F.explode("layers").alias("e")).select(
        x, F.col(f"e.{name}").alias(name), F.col("e.y").alias("y"), (F.col("_base") + below).alias("y0")
    )


def _wiggle(tall: DataFrame, x: str, n: int) -> DataFrame:
    """Base line whose step is minus the value-weighted mean slope of the layer middles."""
    xs = tall.withColumn("_x", F.unix_micros(F.col(x).cast("timestamp")) / F.lit(1e6)
                         if dict(tall.dtypes)[x].startswith(("timestamp", "date")) else F.col(x).cast("double"))
    lagged = previous(xs, [x], ["_x", "layers"])
    dx = F.col("_x") - F.col("prev__x")
    slope = [(F.col("layers")[i]["y"] - F.col("prev_layers")[i]["y"]) / dx for i in range(n)]
    moment = F.lit(0.0)
    run = F.lit(0.0)
    for i in range(n):
        moment = moment + (run + slope[i] / 2) * F.col("layers")[i]["y"]
        run = run + slope[i]
    step = F.when((F.col("seq") == 1) | (F.col("_total") == 0), 0.0).otherwise(-moment / F.col("_total") * dx)
    run_total = running_sum(lagged.withColumn("_step", step).select(x, "layers", "_total", "_step"), [x], "_step", "_o")
    run_total = cut(run_total)
    low = run_total.agg(F.least(F.lit(0.0), F.min("_o")).alias("_low"))
    return run_total.join(F.broadcast(low)).withColumn("_base", F.col("_o") - F.col("_low")).drop("_o", "_low", "_step")


def box_stats(df: DataFrame, value: str, by: list[str], whisker: float | None = None) -> DataFrame:
    """Quartiles, whisker ends and number of outliers per group.

    Without ``whisker`` the whiskers are the extremes; with it they are the last values within
    ``whisker`` interquartile ranges of the quartiles.
    """
    q = quantiles(df, value, [0.25, 0.5, 0.75], by)
    v = join_on(df, q, by)  # one row per group
    lo, hi = F.lit(float("-inf")), F.lit(float("inf"))
    if whisker is not None:
        reach = (F.col("q2") - F.col("q0")) * F.lit(float(whisker))
        lo, hi = F.col("q0") - reach, F.col("q2") + reach
    x = F.col(value)
    inside = (x >= lo) & (x <= hi)
    return v.groupBy(*by, "n", "q0", "q1", "q2").agg(
        F.min(F.when(inside, x)).alias("low"), F.max(F.when(inside, x)).alias("high"), F.count_if(~inside).alias("outliers")
    )


def qq_pairs(df: DataFrame, value: str, sample: str, first: str, second: str, n: int) -> DataFrame:
    """``n`` matching order statistics of two samples: positions trunc(i * (size - 1) / n)."""
    # Equal values are merged first, so a value with very many copies is one row.
    merged = df.where(F.col(sample).isin(first, second)).groupBy(sample, value).agg(F.count("*").alias("_c"))
    placed = running_sum(merged, [value], "_c", "_end", [sample])
    sizes = placed.groupBy(sample).agg(F.max("_end").alias("_m"))
    wanted = sizes.select(
        sample, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
            i.alias("i"), (F.floor(i * (F.col("_m") - 1) / F.lit(n)) + 1).alias("rn")))).alias("w")
    ).select(sample, F.col("w.i").alias("i"), F.col("w.rn").alias("_rn"))
    wanted = F.broadcast(wanted.withColumnRenamed(sample, "_of"))  # 2 * n rows
    holds = (F.col("_rn") <= F.col("_end")) & (F.col("_rn") > F.col("_end") - F.col("_c"))
    hit = placed.join(wanted, (F.col(sample) == F.col("_of")) & holds)
    return hit.groupBy("i").agg(
        F.max(F.when(F.col(sample) == first, F.col(value))).alias("x"),
        F.max(F.when(F.col(sample) == second, F.col(value))).alias("y"),
    )


def horizon_bands(df: DataFrame, key: str, value: str, bands: int, mode: str = "offset") -> DataFrame:
    """Each value cut into ``bands`` layers of equal height over the largest magnitude.

    ``part`` is the filled share of the band. In ``mirror`` mode negative values rise from the base
    line; in ``offset`` mode they hang from the top edge of their band.
    """
    peak = df.agg(F.max(F.abs(value)).alias("_peak"))
    scaled = df.join(F.broadcast(peak)).withColumn("_s", F.abs(value) / F.col("_peak") * F.lit(float(bands)))
    out = scaled.select("*", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    part = F.least(F.greatest(F.col("_s") - F.col("band"), F.lit(0.0)), F.lit(1.0))
    negative = F.col(value) < 0
    base = F.when(negative & F.lit(mode == "offset"), 1.0 - part).otherwise(0.0)
    return out.select(key, value, "band", negative.alias("negative"), part.alias("part"), base.alias("base")).where("part > 0")


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("count"))


def index_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in ``order``."""
    rest = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(key).agg(last).select(key, "_r.*")


def split_by(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy a predicate, and all others (also where it is unknown)."""
    hit = F.coalesce(predicate, F.lit(False))
    return df.where(hit), df.where(~hit)


def with_defaults(df: DataFrame, **defaults) -> DataFrame:
    return df.select(*[F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in df.columns])


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` that are not in ``b``; duplicates of ``a`` stay."""
    return a.join(b, keys, "left_anti")
