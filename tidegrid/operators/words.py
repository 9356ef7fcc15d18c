"""Word and hashtag counts, stop words, hashtag similarity, message parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.text import caption_words, has_caption, hashtags, stop_words
from tidegrid.schema import TAG_LIMIT
from tidegrid.session import cut


def drop_stop_words(words: DataFrame) -> DataFrame:
    return words.join(F.broadcast(stop_words(words)), "word", "left_anti")


def word_count(captions: DataFrame, text: str = "text", min_count: int = 2) -> DataFrame:
    """Words of all non-blank captions with their counts; rare words and stop words are left out.

    Counting comes first (partial sums before the shuffle); the stop list meets only distinct words.
    """
    words = captions.where(has_caption(text)).select(F.explode(caption_words(text)).alias("word"))
    counts = words.where("word <> ''").groupBy("word").agg(F.count("*").alias("count"))
    return drop_stop_words(counts.where(F.col("count") >= min_count))


def word_cloud(captions: DataFrame, text: str = "text") -> DataFrame:
    """Counts of whitespace separated words."""
    words = captions.select(F.explode(F.split(text, r"\s+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("count"))


def tag_counts(posts: DataFrame, *keys: str) -> DataFrame:
    """Hashtag counts per group (repeats inside a post count)."""
    return (
        posts.select(*keys, F.explode(hashtags("text")).alias("tag"))
        .groupBy(*keys, "tag")
        .agg(F.count("*").alias("n"))
    )


def top_tags(posts: DataFrame, *keys: str, limit: int = TAG_LIMIT) -> DataFrame:
    """The most frequent hashtags of each group; ties by tag."""
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "tag")
    return tag_counts(posts, *keys).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def tag_vectors(posts: DataFrame) -> DataFrame:
    """Distinct hashtag vectors with the number of posts that have them: (vec, terms, posts).

    ``terms`` holds (tag, tf, w) with ``w = tf / (1 + sqrt(sum tf^2))``. Posts with equal vectors are
    merged before any pair is formed, so copies cost one row.
    """
    tags = hashtags("text")
    uniq = F.array_sort(F.array_distinct("_tags"))
    tf = F.transform(uniq, lambda t: F.struct(t.alias("tag"), F.size(F.filter(F.col("_tags"), lambda x: x == t)).cast("double").alias("tf")))
    base = posts.select(tags.alias("_tags")).where(F.size("_tags") > 0)
    base = base.groupBy("_tags").agg(F.count("*").alias("posts")).select(tf.alias("tf"), "posts")
    base = base.groupBy("tf").agg(F.sum("posts").alias("posts"))
    norm = F.sqrt(F.aggregate("tf", F.lit(0.0), lambda a, t: a + t["tf"] * t["tf"]))
    vec = F.array_join(F.transform("tf", lambda t: F.concat(t["tag"], F.lit(":"), t["tf"].cast("bigint").cast("string"))), " ")
    return base.select(
        vec.alias("vec"),
        "posts",
        (norm / (1.0 + norm)).alias("length"),
        F.transform("tf", lambda t: F.struct(t["tag"].alias("tag"), (t["tf"] / (1.0 + norm)).alias("w"))).alias("terms"),
    )


def tag_similarity(posts: DataFrame, min_sim: float) -> DataFrame:
    """Pairs of hashtag vectors whose weighted overlap reaches ``min_sim`` (exact).

    Terms are ordered from rare to frequent. A pair that shares only the frequent end of one vector
    cannot score more than the length of that end times the longest vector, so a vector is looked up
    only by the leading terms that are left when this bound falls below ``min_sim``. A tag that a third
    of all posts use is then a lookup key only for the few vectors in which it still matters.
    """
    vecs = cut(tag_vectors(posts))  # read four times below
    term = vecs.select("vec", F.explode("terms").alias("t")).select("vec", "t.tag", "t.w")
    freq = term.groupBy("tag").agg(F.count("*").alias("df"))
    longest = vecs.agg(F.max("length").alias("m")).first()["m"] or 0.0
    ranked = term.join(freq, "tag")
    by_rarity = Window.partitionBy("vec").orderBy("df", "tag")
    rest = F.sqrt(F.sum(F.col("w") * F.col("w")).over(by_rarity.rowsBetween(0, Window.unboundedFollowing)))
    # A tiny allowance keeps pairs whose bound differs from the score only by rounding.
    keys = ranked.withColumn("rest", rest).where(F.col("rest") * longest >= min_sim - 1e-9).select("vec", "tag")
    found = (
        keys.alias("a")
        .join(keys.alias("b"), "tag")
        .where("a.vec <= b.vec")
        .select(F.col("a.vec").alias("vec_a"), F.col("b.vec").alias("vec_b"))
        .distinct()
    )
    left = vecs.select(F.col("vec").alias("vec_a"), F.col("posts").alias("posts_a"), F.col("terms").alias("terms_a"))
    right = vecs.select(F.col("vec").alias("vec_b"), F.col("posts").alias("posts_b"), F.col("terms").alias("terms_b"))
    other = F.map_from_entries("terms_b")
    sim = F.aggregate("terms_a", F.lit(0.0), lambda acc, t: acc + F.coalesce(t["w"] * F.col("_b")[t["tag"]], F.lit(0.0)))
    return (
        found.join(left, "vec_a")
        .join(right, "vec_b")
        .withColumn("_b", other)
        .withColumn("sim", sim)
        .where(F.col("sim") >= min_sim)
        .select("vec_a", "vec_b", "posts_a", "posts_b", "sim")
    )


def explode_messages(messages: DataFrame, item: T.StructType, value: str = "value") -> DataFrame:
    """Each message holds a JSON array; one row per element. Unreadable messages give no rows."""
    parsed = messages.withColumn("_items", F.from_json(value, T.ArrayType(item)))
    return parsed.select("*", F.explode("_items").alias("item")).drop("_items")


def split_topics(messages: DataFrame, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """One parsed frame per topic; messages that are not valid JSON are dropped."""
    out = {}
    for topic, schema in schemas.items():
        full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
        parsed = F.from_json("value", full, {"columnNameOfCorruptRecord": "_bad"})
        rows = messages.where(F.col("topic") == topic).select("*", parsed.alias("p"))
        out[topic] = rows.where("p is not null and p._bad is null").select(
            *messages.columns, *[F.col(f"p.{f.name}").alias(f.name) for f in schema.fields]
        )
    return out


def unreadable(messages: DataFrame) -> DataFrame:
    """Number of messages per topic that are not valid JSON."""
    bad = F.try_parse_json("value").isNull()
    return messages.groupBy("topic").agg(F.count_if(bad).alias("unreadable"))


def url_encode_pairs(pairs: F.Column | str) -> F.Column:
    """An array of (key, value) as a form-urlencoded string; a null value leaves the bare key."""
    c = F.col(pairs) if isinstance(pairs, str) else pairs
    return F.array_join(
        F.transform(
            c,
            lambda p: F.concat(
                F.url_encode(p["key"]),
                F.when(p["value"].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.url_encode(p["value"]))),
            ),
        ),
        "&",
    )
