"""From raw documents to shards: language, near copies, benchmark leaks, source mix, shards.

Each stage takes all rows that the stage before it kept and its decisions take effect: rejected rows are
gone, mixed rows repeat as often as they are taken. All stages but the last return the columns they were
given, whatever these are called. Every stage is written as a table before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import decontaminate, langid, mixing, ngram_join, sharding
from tidegrid.llm.common import stage
from tidegrid.sources.tables import table

LEAST_LANGUAGE_SCORE = 0.1  # below, no learned language fits
SHARDS = 40

ORACLE_SQL = None  # learned languages and sampled decisions have no SQL form; the stages are tested apart


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows with column names that no operator uses, and the name each column now has."""
    now = {c: f"column{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*now.values()), now


def _back(rows: DataFrame, now: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for c, n in now.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that no learned language fits."""
    rows, now = _apart(docs)
    id, text = now["doc_id"], now["text"]
    prototypes = langid.learn(rows.where(~langid.held_out(id)), text=text, lang=now["lang"], id=id)
    out = langid.predict(rows, prototypes, text=text)
    return _back(out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)), now)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of linked documents."""
    rows, now = _apart(docs)
    return _back(ngram_join.one_per_group(rows, now["doc_id"], now["text"]), now)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover a benchmark item."""
    rows, now = _apart(docs)
    out = decontaminate.cover(rows, table(spark, sf_dir, "benchmark"), text=now["text"])
    return _back(out.where(~F.col("contaminated")), now)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources have their target shares."""
    rows, now = _apart(docs)
    weights = mixing.quality_weights(table(spark, sf_dir, "labels"))
    return _back(mixing.repeated(rows, weights, now["doc_id"], now["text"], now["source"]), now)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per mixed row: doc_id, size, text_crc32, shard and slot."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", leaks),
    ("mixing sources", mix),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
