import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import empty, odd
from tidegrid.llm import mixing, queries


def levels(sizes, share=1.5, most=2.0):
    """Targets by resharing the excess step by step."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        left = share * sum(sizes.values()) - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def check(rows, texts):
    sizes, taken, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r.size)
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        assert r.taken in (r.epochs * r.size, (r.epochs + 1) * r.size) and r.taken <= 2 * r.size
    want = levels(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s] / 2 + 1e-6


def test_query_against_direct_sums(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(queries.op10(spark, sf_dir).collect(), docs)


def test_hot_source_and_rerun(spark):
    df = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.expr("repeat('word ', cast(1 + id % 40 as int))").alias("text"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id") % 7)).cast("string").alias("source"))
    rows = mixing.mix(df).collect()
    check(rows, {r.doc_id: r.text for r in df.collect()})
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))


def test_heavier_documents_are_taken_more_often(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "'a b c d' as text", "if(id < 3000, 'small', 'large') as source", "id % 2 as good")
    weights = df.select("doc_id", F.when(F.col("good") == 1, 4.0).otherwise(1.0).alias("weight"))
    rows = mixing.mix(df.where("source = 'large' or doc_id < 600"), weights).collect()
    part = [r for r in rows if r.source == "large"]
    more = [r.doc_id % 2 for r in part if r.copies > r.epochs]
    assert 0.1 < len(more) / len(part) < 0.99 and sum(more) / len(more) > 0.55


def test_odd_rows_and_empty_table(spark):
    rows = mixing.mix(odd(spark)).collect()
    assert len(rows) == 10 and all(r.taken == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert mixing.mix(empty(spark)).collect() == []


def test_rows_are_repeated_as_often_as_taken(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = mixing.repeated(docs, None)
    assert out.columns == docs.columns
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: c for k, c in copies.items() if c}
    assert mixing.repeated(odd(spark)).columns == odd(spark).columns
    assert mixing.repeated(empty(spark)).collect() == []


def _third_equal(spark, docs=300, words=10):
    """One source in which a third of the rows are one repeated row."""
    return spark.range(docs).select(
        F.when(F.col("id") < docs // 3, -1).otherwise(F.col("id")).alias("doc_id"),
        F.expr(f"repeat('word ', {words})").alias("text"), F.lit("a").alias("source")).repartition(4)


@pytest.mark.parametrize("seed", range(6))
def test_repeated_rows_are_taken_one_by_one(spark, seed):
    df = _third_equal(spark).withColumn("doc_id", F.when(F.col("doc_id") < 0, -1 - seed).otherwise(F.col("doc_id")))
    rows = mixing.mix(df).collect()
    assert len(rows) == 300 and abs(sum(r.taken for r in rows) - 4500) <= 10
    assert all(r.taken <= 2 * r.size for r in rows)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


@pytest.mark.parametrize("seed", [0, 3])
def test_mixed_rows_repeat_as_often_as_they_are_taken(spark, seed):
    df = _third_equal(spark).withColumn("doc_id", F.when(F.col("doc_id") < 0, -1 - seed).otherwise(F.col("doc_id")))
    df = df.unionByName(df.limit(50).withColumn("source", F.lit(None).cast("string"))).withColumn("extra", F.monotonically_increasing_id())
    df = spark.createDataFrame(df.collect(), df.schema)
    want = {(r.source, r.doc_id): r.t for r in mixing.mix(df).groupBy("source", "doc_id").agg(F.sum("copies").alias("t")).collect() if r.t}
    got = mixing.repeated(df)
    assert got.columns == df.columns
    assert {(r.source, r.doc_id): r["count"] for r in got.groupBy("source", "doc_id").count().collect()} == want
    each = got.groupBy("extra").count().agg(F.max("count")).first()[0]
    assert each <= 2
