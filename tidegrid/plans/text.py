"""Text queries: word counts, hashtags, similarity, JSON messages."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.text import STOP_WORDS, hashtags
from tidegrid.operators import words
from tidegrid.plans.registry import query
from tidegrid.sources.tables import over_posts, posts, table

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
WORDS_CTE = """w as materialized (select unnest(string_split(replace(lower(text), '#', ' '), ' ')) as word from posts)"""


@query("word_count", over_posts(
    f"select word, count(*) as count from w where word <> '' and word not in {STOP_SQL} group by 1 having count(*) > 1",
    WORDS_CTE))
def word_count(spark, d):
    return words.word_count(posts(spark, d).select("text"))


@query("word_cloud", over_posts(
    "select word, count(*) as count from w where word <> '' group by 1",
    r"w as materialized (select unnest(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+')) as word from posts)"))
def word_cloud(spark, d):
    return words.word_cloud(posts(spark, d).select("text"))


@query("stopword_anti", over_posts(
    f"select word, count(*) as count from w where word not in {STOP_SQL} and word <> '' group by 1", WORDS_CTE))
def stopword_anti(spark, d):
    return words.word_count(posts(spark, d).select("text"), min_count=1)


@query("hashtags", over_posts(
    "select tag, count(*) as n, count(distinct id) as posts from (select id, unnest(tags) as tag from posts) group by tag"))
def hashtag_counts(spark, d):
    tagged = posts(spark, d).select("id", F.explode(hashtags("text")).alias("tag"))
    per_post = tagged.groupBy("tag", "id").agg(F.count("*").alias("k"))
    return per_post.groupBy("tag").agg(F.sum("k").alias("n"), F.count("*").alias("posts"))


@query("cluster_hashtags", over_posts(
    """select scrape, tag, n, rank from (
         select scrape, tag, n, cast(row_number() over (partition by scrape order by n desc, tag) as integer) as rank
         from (select scrape, tag, count(*) as n from (select scrape, unnest(tags) as tag from posts) group by 1, 2))
       where rank <= 10"""))
def cluster_hashtags(spark, d):
    """Top ten hashtags per group; here the sets of posts are the groups."""
    return words.top_tags(posts(spark, d).select("scrape", "text"), "scrape")


@query("hashtag_cosine", over_posts(
    """select a.vec as vec_a, b.vec as vec_b, any_value(a.posts) as posts_a, any_value(b.posts) as posts_b,
              round(sum(a.w * b.w), 6) as sim
       from w a join w b on a.tag = b.tag and a.vec <= b.vec group by a.vec, b.vec having sum(a.w * b.w) >= 0.17e0""",
    "t0 as materialized (select id, tag, count(*) as tf from (select id, unnest(tags) as tag from posts) group by id, tag)",
    "v0 as materialized (select id, string_agg(tag || ':' || tf, ' ' order by tag) as vec from t0 group by id)",
    "v as (select vec, min(id) as id, count(*) as posts from v0 group by vec)",
    "w as materialized (select vec, posts, tag, tf / (1 + sqrt(sum(tf * tf) over (partition by vec))) as w from v join t0 using (id))"))
def hashtag_cosine(spark, d):
    sim = words.tag_similarity(posts(spark, d).select("text"), 0.17)
    return sim.withColumn("sim", F.round("sim", 6))


@query("json_props", """
    select event_id, cast(json_extract_string(props, '$.k') as bigint) as k,
           '{"id":' || event_id || ',"k":' || json_extract_string(props, '$.k') || '}' as value from events""")
def json_props(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    out = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("p.k").alias("k")))
    return e.select("event_id", F.col("p.k").alias("k"), out.alias("value"))


@query("explode_json_array", """
    select doc_id, cast(n as bigint) as n, line from (
      select doc_id, unnest(string_split(text, chr(10))) as line,
             unnest(range(0, len(string_split(text, chr(10))))) as n from documents)""")
def explode_json_array(spark, d):
    lines = F.split("text", "\n")
    docs = table(spark, d, "documents")
    items = F.transform(lines, lambda x, i: F.struct(i.cast("bigint").alias("n"), x.alias("line")))
    messages = docs.select("doc_id", F.to_json(items).alias("value"))
    item = T.StructType([T.StructField("n", T.LongType()), T.StructField("line", T.StringType())])
    return words.explode_messages(messages, item).select("doc_id", "item.n", "item.line")


@query("topic_demux", """
    select topic, count(*) as messages, count(*) filter (where event_type <> 'error') as readable,
           cast(sum(case when event_type <> 'error' then event_id end) as bigint) as id_sum
    from (select *, case when user_id % 3 = 0 then 'proc' else 'raw' end as topic from events) group by topic""")
def topic_demux(spark, d):
    e = table(spark, d, "events")
    payload = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))
    topic = F.when(F.col("user_id") % 3 == 0, "proc").otherwise("raw")
    # Error events stand for messages that were cut off on the way.
    value = F.when(F.col("event_type") == "error", F.substring(payload, 1, 9)).otherwise(payload)
    messages = e.select(topic.alias("topic"), value.alias("value"))
    item = T.StructType([T.StructField("id", T.LongType()), T.StructField("kind", T.StringType())])
    parts = words.split_topics(messages, {"raw": item, "proc": item})
    good = parts["raw"].unionByName(parts["proc"]).groupBy("topic").agg(
        F.count("*").alias("readable"), F.sum("id").alias("id_sum"))
    return messages.groupBy("topic").agg(F.count("*").alias("messages")).join(good, "topic")


@query("urlencode", """
    select event_id, 'type=' || replace(url_encode(event_type), '%20', '+') || '&value=' || replace(url_encode(cast(value as varchar)), '%20', '+')
           || '&props=' || replace(url_encode(props), '%20', '+') as query from events""")
def urlencode(spark, d):
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    pairs = F.array(pair("type", F.col("event_type")), pair("value", F.col("value")), pair("props", F.col("props")))
    return table(spark, d, "events").select("event_id", words.url_encode_pairs(pairs).alias("query"))
