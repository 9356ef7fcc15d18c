"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Every document gets the key ``-ln(u) / w``: ``u`` is a hash of its id and text, ``w`` its quality weight. A
source whose target is e + f times its size takes e complete epochs and then documents in key order, up to
the fraction f of its words. Taken words differ from the target by half a document at most.

No source is sorted whole: about sqrt(n) key buckets per source are summed, and only the documents of the
one bucket in which the target ends are ordered, equal ones as one. What is left is one row per source, and each
document decides from it alone.

Defined results: null text and text without words have size 0 and take no words; a null source is a source
of its own, last in order; a null weight counts as 1; weights must be above 0; repeated rows take part one
by one: they have one key and are summed up under it, and where the target ends among them as many are taken as
fit, whichever; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import stage, uniform, word_count
from tidegrid.operators.rank import numbered
from tidegrid.session import cut

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
SHARE = 1.5  # of all words
MOST = 2.0  # times the size of a source
FEW_SOURCES = 10_000


def _named(source: str) -> Column:
    """Name of a source that null has too."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def keyed(df: DataFrame, weights: DataFrame | None = None, id: str = "doc_id", text: str = "text", source: str = "source",
          seed: int = 17) -> DataFrame:
    """One slim row per document: doc_id, source and what the decision needs. Texts are not shuffled.

    ``weights`` has the columns doc_id and weight, each id once. Added are _size, _source, _e (place of the
    exponential key in 0..1), _h (hash of id and text) and _row (a number of its own, fixed once the rows are staged).
    """
    rows = df.select(
        F.col(id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("_size"),
        _named(source).alias("_source"), F.xxhash64(id, text).alias("_h"),
        uniform(id, F.xxhash64(text), seed=seed).alias("_u"))
    weight = F.lit(1.0)
    if weights is not None:
        rows = rows.join(weights.select("doc_id", F.col("weight").cast("double").alias("_w")), "doc_id", "left")
        weight = F.coalesce("_w", F.lit(1.0))
    return rows.withColumn("_e", 1 - F.pow("_u", 1 / weight)).select("doc_id", "source", "_size", "_source", "_e", "_h").withColumn(
        "_row", F.monotonically_increasing_id())


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``target`` to (_source, total, n): shares by weight, stopped at ``most`` times a source's size.

    The level (words per unit of weight) rises until no source is above its stop; each round is one small
    aggregation, and every round but the last stops at least one more source.
    """
    ranked = numbered(sizes, [F.col("_source") == "", "_source"])
    by_rank = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
    ranked = cut(ranked.select("_source", "total", "n", by_rank.alias("w"), (most * F.col("total")).alias("stop")))
    level, stopped = 0.0, -1
    while True:
        full = F.col("stop") <= F.col("w") * level
        r = ranked.agg(
            F.sum("total").alias("all"), F.sum(F.when(full, F.col("stop")).otherwise(0.0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("open"), F.sum(full.cast("long")).alias("stopped")).first()
        if not r["all"] or not r["open"] or r["stopped"] == stopped:
            break
        stopped, level = r["stopped"], (share * r["all"] - r["held"]) / r["open"]
    return ranked.select("_source", "total", "n", F.least("stop", F.col("w") * level).alias("target"))


def _beside(per_source: DataFrame) -> DataFrame:
    """Sent to all tasks if there are few sources; otherwise an ordinary join."""
    return F.broadcast(per_source) if per_source.count() <= FEW_SOURCES else per_source


def _bucket(n: Column) -> Column:
    """Key bucket of a document in a source of ``n`` documents."""
    return F.floor(F.col("_e") * F.ceil(F.sqrt(n))).cast("long")


def plan(rows: DataFrame, **how) -> DataFrame:
    """One row per source: its target, complete epochs, and the key up to which documents are taken once more."""
    sizes = rows.groupBy("_source").agg(F.sum("_size").alias("total"), F.count("*").alias("n"))
    goal = targets(sizes, **how)
    epochs = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("long")
    goal = cut(goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("total")))
    buckets = (
        rows.join(_beside(goal.select("_source", "n")), "_source").groupBy("_source", _bucket(F.col("n")).alias("b"))
        .agg(F.sum("_size").alias("s")).join(goal.select("_source", "rest"), "_source")
    )
    order = Window.partitionBy("_source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        buckets.withColumn("upto", F.sum("s").over(order)).where("upto > rest").groupBy("_source")
        .agg(F.min_by(F.struct("b", (F.col("upto") - F.col("s")).alias("before")), "b").alias("end"))
    )
    goal = cut(goal.join(ends, "_source", "left").select("*", "end.b", "end.before").drop("end"))
    inside = rows.join(_beside(goal.select("_source", "n", "b", "before", "rest")), "_source").where(_bucket(F.col("n")) == F.col("b"))
    # Equal rows are one group of c; the first m of the group fit.
    groups = inside.groupBy("_source", "_e", "_h", "before", "rest").agg(F.count("*").alias("c"), F.max("_size").alias("s"))
    key = Window.partitionBy("_source").orderBy("_e", "_h").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("c") * F.col("s")).over(key), F.lit(0))
    fit = F.when(F.col("s") > 0, F.floor(left / F.col("s") + 0.5)).otherwise(F.when(left >= 0, F.col("c")).otherwise(0))
    groups = cut(groups.withColumn("m", F.greatest(F.least(fit, F.col("c")), F.lit(0)).cast("long")).where("m > 0"))
    last = groups.where("m = c").groupBy("_source").agg(F.max(F.struct("_e", "_h")).alias("last"))
    part = groups.where("m < c").select("_source", "_e", "_h", "m")  # one of a source at most
    goal = goal.join(last, "_source", "left").select("_source", "total", "n", "target", "epochs", "rest", "b", "last")
    if part.isEmpty():
        return cut(goal.withColumns({"edge": F.col("last"), "edge_row": F.lit(-1).cast("long")}))
    among = numbered(rows.join(_beside(part), ["_source", "_e", "_h"]).select("_source", "_e", "_h", "m", "_row"), ["_row"], ["_source"])
    edge = among.where("rn = m").select("_source", F.struct("_e", "_h").alias("edge"), F.col("_row").alias("edge_row"))
    return cut(goal.join(edge, "_source", "left"))


def decide(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target and copies (how often each document is taken) to keyed rows."""
    mine = _bucket(F.col("n"))
    key = F.struct("_e", "_h")
    taken = F.coalesce(key <= F.col("last"), F.lit(False)) | F.coalesce((key == F.col("edge")) & (F.col("_row") <= F.col("edge_row")), F.lit(False))
    once_more = F.col("b").isNull() | (mine < F.col("b")) | ((mine == F.col("b")) & taken)
    copies = F.col("epochs") + F.when((F.col("rest") > 0) & once_more, 1).otherwise(0)
    return rows.join(_beside(plan), "_source").withColumn("copies", copies.cast("long")).withColumnRenamed("total", "source_size")


def mix(df: DataFrame, weights: DataFrame | None = None, id: str = "doc_id", text: str = "text", source: str = "source",
        **how) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs, copies, taken, _h."""
    rows = stage(keyed(df, weights, id, text, source), "mix-keys")
    return decide(rows, plan(rows, **how)).select(
        "doc_id", "source", F.col("_size").alias("size"), "source_size", "target", "epochs", "copies",
        (F.col("copies") * F.col("_size")).alias("taken"), "_h")


def quality_weights(labels: DataFrame, good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """(doc_id, weight) of labelled documents; where labels of one id disagree, the better one counts."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("mark"))
    return marks.select("doc_id", F.when(F.col("mark") == 1, good).otherwise(bad).alias("weight"))


def repeated(df: DataFrame, weights: DataFrame | None = None, id: str = "doc_id", text: str = "text", source: str = "source",
             **how) -> DataFrame:
    """The mixed rows of ``df``: each as often as it is taken. Rows of equal id, text and source share what is taken of them."""
    taken = mix(df, weights, id, text, source, **how)
    per = F.floor(F.col("all") / F.col("c")).cast("long")
    groups = taken.groupBy(_named("source").alias("_source"), "_h").agg(F.sum("copies").alias("all"), F.count("*").alias("c"))
    groups = groups.where("all > 0").select("_source", "_h", per.alias("_copies"), (F.col("all") - per * F.col("c")).alias("_extra"))
    keyed_rows = df.withColumns({"_h": F.xxhash64(id, text), "_source": _named(source)})
    uneven = cut(groups.where("_extra > 0"))  # one of a source at most
    rows = keyed_rows.join(groups.where("_extra = 0"), ["_source", "_h"])
    if not uneven.isEmpty():
        some = numbered(keyed_rows.join(uneven, ["_source", "_h"]).withColumn("_row", F.monotonically_increasing_id()), ["_row"], ["_source", "_h"], "_rn")
        some = some.withColumn("_copies", F.col("_copies") + (F.col("_rn") <= F.col("_extra")).cast("long")).where("_copies > 0")
        rows = rows.unionByName(some.select(*rows.columns))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*df.columns)
