"""Grid density estimates, k-means on samples and recent rows, decayed grids, micro-clusters, purity."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.binning import equal_bin
from tidegrid.operators.density import dbscan
from tidegrid.operators.graph import connected_components
from tidegrid.operators.rank import numbered
from tidegrid.operators.stats import quantiles
from tidegrid.session import cut


def grid_density(df: DataFrame, dims: list[str], side: int, bandwidth: float) -> DataFrame:
    """Kernel density on a ``side``-cube grid over columns in [0, 1]: (g0, g1, .., density), every cell reached.

    Points are counted per cell first. The kernel is a product over axes, so it is spread one axis at a
    time over all ``side`` cells of that axis, and no part of it is cut off. ``bandwidth`` is in cells.
    """
    keys = [f"g{i}" for i in range(len(dims))]
    bins = [equal_bin(F.col(d), F.lit(0.0), F.lit(1.0), side).alias(k) for d, k in zip(dims, keys)]
    n = df.agg(F.count("*").alias("_all"))
    mass = df.groupBy(*bins).agg(F.count("*").alias("n")).join(F.broadcast(n)).select(*keys, (F.col("n") / F.col("_all")).alias("density"))
    for k in keys:
        spread = mass.withColumn("_to", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(side - 1).cast("bigint"))))
        gap = (F.col("_to") - F.col(k)).cast("double")
        w = F.exp(gap * gap / F.lit(-2.0 * bandwidth * bandwidth))
        mass = spread.withColumn("_m", F.col("density") * w).drop(k).withColumnRenamed("_to", k).groupBy(*keys).agg(F.sum("_m").alias("density"))
    return mass


def densest_cells(density: DataFrame, dims: int, side: int, share: float) -> DataFrame:
    """Cells above the ``1 - share`` quantile of the whole grid, empty cells counting as 0."""
    spine = density.sparkSession.range(side**dims)
    for i in range(dims):
        spine = spine.withColumn(f"g{i}", F.expr(f"id div {side ** i} % {side}"))
    keys = [f"g{i}" for i in range(dims)]
    full = cut(spine.drop("id").join(density, keys, "left").withColumn("density", F.coalesce("density", F.lit(0.0))))
    top = quantiles(full, "density", [1.0 - share]).select("q0")
    return full.join(F.broadcast(top), F.col("density") > F.col("q0")).drop("q0")


def _features(df: DataFrame, dims: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=dims, outputCol="features").transform(df)


def sample_kmeans(df: DataFrame, dims: list[str], key: str, k: int = 4, size: int | None = None, seed: int = 1) -> DataFrame:
    """k-means on all rows, or on a repeatable random sample of ``size``; all rows get one of the found centres."""
    f = _features(df, dims)
    sample = f if size is None else f.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(size)
    model = KMeans(k=k, seed=seed).fit(sample)
    return model.transform(f).withColumnRenamed("prediction", "cl").drop("features")


def recent_kmeans(df: DataFrame, dims: list[str], order: list[str], k: int = 4, horizon: int = 100, seed: int = 1) -> DataFrame:
    """k-means on the ``horizon`` newest rows, which are returned with their cluster."""
    recent = _features(df.orderBy(*[F.desc(o) for o in order]).limit(horizon), dims)
    return KMeans(k=k, seed=seed).fit(recent).transform(recent).withColumnRenamed("prediction", "cl").drop("features")


def silhouette(clustered: DataFrame, dims: list[str]) -> float:
    return ClusteringEvaluator(predictionCol="cl").evaluate(_features(clustered, dims))


def _cells(df: DataFrame, dims: list[str], side: float, time_days: str, decay: float, keys: list[str]) -> DataFrame:
    """Decayed weight, and weighted sums and squares per cell; age is measured from the newest row."""
    now = df.agg(F.max(time_days).alias("_now"))
    w = F.pow(F.lit(decay), F.col("_now") - F.col(time_days))
    cell = [F.floor(F.col(c) / F.lit(side)).cast("bigint").alias(f"c{i}") for i, c in enumerate(dims)]
    aggs = [F.count("*").alias("n"), F.sum(w).alias("weight")]
    for i, c in enumerate(dims):
        aggs += [F.sum(w * F.col(c)).alias(f"s{i}"), F.sum(w * F.col(c) * F.col(c)).alias(f"ss{i}")]
    return df.join(F.broadcast(now)).groupBy(*keys, *cell).agg(*aggs)


def decayed_grid(df: DataFrame, dims: list[str], side: float, time_days: str, decay: float, dense: float) -> DataFrame:
    """Grid density clusters: cells with their decayed weight; dense cells that touch form a cluster.

    Cells touch along one axis. Clusters are numbered by their smallest cell; sparse cells get 0.
    """
    keys = [f"c{i}" for i in range(len(dims))]
    cells = cut(_cells(df, dims, side, time_days, decay, []).select(*keys, "n", "weight"))
    solid = cut(numbered(cells.where(F.col("weight") >= dense), keys, name="id").select(*keys, "id"))
    links = None
    for k in keys:
        moved = solid.select(*[(F.col(c) + 1).alias(c) if c == k else F.col(c) for c in keys], F.col("id").alias("dst"))
        part = solid.join(moved, keys).select(F.col("id").alias("src"), "dst")
        links = part if links is None else links.unionByName(part)
    comp = connected_components(solid.select("id"), links)
    order = numbered(comp.select("component").distinct(), ["component"], name="cl")
    named = solid.join(comp, "id").join(order, "component").select(*keys, "cl")
    return cells.join(named, keys, "left").withColumn("cl", F.coalesce("cl", F.lit(0).cast("bigint")))


def micro_clusters(
    df: DataFrame, dims: list[str], side: float, time_days: str, decay: float, eps: float, min_weight: float
) -> DataFrame:
    """Micro-clusters (decayed weight, centre, spread per cell) joined into macro-clusters by weighted density."""
    keys = [f"c{i}" for i in range(len(dims))]
    cells = _cells(df, dims, side, time_days, decay, [])
    centres = [(F.col(f"s{i}") / F.col("weight")).alias(f"m{i}") for i in range(len(dims))]
    var = sum((F.col(f"ss{i}") / F.col("weight") - F.pow(F.col(f"s{i}") / F.col("weight"), 2) for i in range(len(dims))), F.lit(0.0))
    micro = cells.select(*keys, "n", "weight", *centres, F.sqrt(F.greatest(var, F.lit(0.0))).alias("spread"))
    micro = cut(numbered(cut(micro), keys, name="pid"))
    return dbscan(micro, [], [f"m{i}" for i in range(len(dims))], "pid", eps, min_weight, scale=False, weight="weight").drop("pid")


CENTRES_PER_STEP = 500


def nearest_centre(df: DataFrame, vector: str, centres: DataFrame, centre_id: str) -> DataFrame:
    """Add the id of the nearest centre (``cl``) and its squared distance (``d2``); ties take the smaller id.

    Centres are model parameters. They are shipped in rows of at most a few hundred centres, one step
    per row, so that no shipped row grows with their number.
    """
    numbered_centres = cut(numbered(centres, [centre_id], name="_rn").withColumn("_step", F.floor((F.col("_rn") - 1) / CENTRES_PER_STEP)))
    steps = (numbered_centres.agg(F.max("_step")).first()[0] or 0) + 1
    out = df
    for s in range(steps):
        part = numbered_centres.where(F.col("_step") == s).agg(F.array_sort(F.collect_list(F.struct(centre_id, "centre"))).alias("_c"))

        def distance(c):
            return F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), c["centre"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b)

        best = F.array_min(F.transform("_c", lambda c: F.struct(distance(c).alias("d2"), c[centre_id].alias("cl"))))
        best = F.least(best, F.col("_best")) if s else best
        out = out.join(F.broadcast(part)).withColumn("_best", best).drop("_c")
    return out.select("*", "_best.cl", "_best.d2").drop("_best")


def mean_vectors(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean vector per label (vector length is fixed, so one row per label and place is summed)."""
    places = df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    pairs = places.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_v"))
    return pairs.select(label, F.transform("_v", lambda v: v["m"]).alias("centre"))


def purity(assigned: DataFrame, label: str, cluster: str = "cl") -> DataFrame:
    """Size and share of the most frequent label per cluster."""
    n = assigned.groupBy(cluster, label).agg(F.count("*").alias("n"))
    return n.groupBy(cluster).agg(
        F.sum("n").alias("size"), F.max("n").alias("_top"), F.max_by(label, F.struct("n", -F.col(label))).alias("main")
    ).select(cluster, "size", "main", (F.col("_top") / F.col("size")).alias("purity"))
