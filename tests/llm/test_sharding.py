import zlib

from pyspark.sql import functions as F

from tests.llm.helpers import empty, odd
from tidegrid.llm import queries, sharding


def check(rows, shards):
    total = sum(r.size for r in rows)
    biggest = max(r.size for r in rows)
    for s in range(shards):
        mine = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / shards) <= biggest


def test_query_places_every_document(spark, sf_dir):
    rows = queries.op5(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    check(rows, 40)


def test_hot_key_is_divided(spark):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = sharding.shard(df, 10).collect()
    check(rows, 10)
    copies = {r.shard for r in rows if r.doc_id % 3 == 0}
    assert len(copies) <= 5  # a run of neighbours: a third of ten shards and both ends


def test_records_that_repeat_id_and_text_are_divided(spark):
    df = spark.range(4000).select(F.lit(5).alias("doc_id"), F.lit("same").alias("text"))
    rows = sharding.stage(sharding.records(df), "same-records")
    cuts = sharding.splitters(rows, 2, range_rows=250)
    sizes = [r["count"] for r in sharding.ranged(rows, cuts).groupBy("r").count().collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 12 and max(sizes) <= 1000
    check(sharding.shard(df, 7).collect(), 7)


def test_range_is_the_number_of_splitters_at_or_below(spark):
    rows = spark.createDataFrame([(a, b, c) for a in (-1, 0, 1) for b in (0, 1) for c in (0, 1)], "h long, g long, i long")
    every = sorted(map(tuple, rows.collect()))
    for cuts in ([], every[3:4], every[1::2], every):
        got = {tuple(r)[:3]: r.r for r in sharding.ranged(rows, cuts).collect()}
        assert got == {k: sum(c <= k for c in cuts) for k in every}


def test_plan_does_not_grow_with_the_splitters(spark, capsys):
    rows = spark.createDataFrame([(0, 0, 0)], "h long, g long, i long")
    plans = []
    for n in (10, 1000):
        sharding.ranged(rows, [(k, -k, 2**62) for k in range(n)]).explain()
        plans.append(capsys.readouterr().out)
    assert plans[0].count("CASE WHEN") == plans[1].count("CASE WHEN") == 1


def test_reruns_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = (sorted(map(tuple, sharding.shard(x, 7).collect())) for x in (docs, docs.repartition(5)))
    assert a == b


def test_odd_rows_and_empty_table(spark):
    rows = sharding.shard(odd(spark), 3).collect()
    assert len(rows) == 10
    check(rows, 3)
    assert {r["size"] for r in rows if r.doc_id in (1, 2)} == {16}
    assert sharding.shard(empty(spark), 3).collect() == []
