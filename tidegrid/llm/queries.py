"""The registered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import (
    collocations, decontaminate, htmltext, langid, licenses, mixing, neighbours, ngram_join, secrets, sharding, substrings,
    toxicity, whitening,
)
from tidegrid.llm.registry import query
from tidegrid.sources.tables import table


@query("op5_sampled_splitters")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op10_weighted_mix")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mixing.quality_weights(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), weights).drop("copies", "_h")


@query("op3_secret_ownership")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op9_hyperdimensional_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    prototypes = langid.learn(documents.where(~langid.held_out()))
    slim = documents.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.predict(slim, prototypes).select("doc_id", "held_out", "lang_pred", "score")


@query("op1_string_tiling")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.cover(documents, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "contaminated", F.col("hit_item").alias("item_id"), "coverage", "tiles")


@query("op7_prefix_tree_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query("op6_factorization_machine")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.learn(documents, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    slim = documents.select("doc_id", toxicity.held_out().alias("held_out"), "text")
    return toxicity.score(slim, model).select("doc_id", "held_out", "score", "predicted")


@query("op8_hilbert_neighbours")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0)


@query("op4_paragraph_banding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents"))


@query("op2_layout_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", "visible_text", F.length("visible_text").alias("n_chars"))


@query("op12_signature_licenses")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


@query("op13_feast_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return whitening.whiten(embeddings, whitening.learn(embeddings))


@query("op11_misra_gries_phrases", """
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents),
words as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from pieces),
total as (select lang, cast(sum(len(w)) as bigint) as n from words group by lang),
places as (
  select lang, w, size, unnest(range(1, len(w) - size + 2)) as pos
  from words, (select unnest(range(1, 6)) as size) where len(w) >= size),
counts as (
  select lang, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') as phrase, count(*) as f
  from places group by all having count(*) >= 100),
phrases as (select lang, size, phrase, f as a, string_split(phrase, ' ') as w from counts where size > 1),
cuts as (
  select lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') as p, array_to_string(list_slice(w, k + 1, size), ' ') as q
  from (select *, unnest(range(1, size)) as k from phrases)),
scored as (
  select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, t.n,
         (cast(1000 as hugeint) * c.a * t.n) // (cast(x.f as hugeint) * y.f) as score
  from cuts c join counts x on x.lang = c.lang and x.phrase = c.p join counts y on y.lang = c.lang and y.phrase = c.q
  join total t on t.lang = c.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select lang, a, array_to_string(list_slice(w, pos, pos + m - 1), ' ') as phrase
  from (select *, unnest(range(1, size - m + 2)) as pos from (select *, unnest(range(2, size)) as m from phrases where size > 2))),
kept as (
  select * from best b where not exists (
    select 1 from inside i where i.lang = b.lang and i.phrase = b.phrase and 100 * i.a >= 100 * b.a))
select * from (
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n,
         cast(score as bigint) as score from kept) where rank <= 2000
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(collocations.frequent(table(spark, sf_dir, "documents")))
