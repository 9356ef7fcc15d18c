from collections import Counter

import corpus_pipeline as cp
from tests.llm.helpers import empty, odd
from tidegrid.llm import decontaminate, langid, mixing, ngram_join


def test_stages_follow_their_operators(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("benchmark", "labels"))
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    a = cp.language(spark, docs, sf_dir)
    want = langid.predict(docs, langid.learn(docs.where(~langid.held_out()))).where("lang_pred <> 'und' and score >= 0.1")
    assert ids(a) == ids(want) and a.columns == docs.columns
    b = cp.near_copies(spark, docs, sf_dir)
    groups = ngram_join.groups(docs).collect()
    assert ids(b) == Counter({r.component_id for r in groups}) and b.columns == docs.columns
    c = cp.leaks(spark, docs, sf_dir)
    assert ids(c) == ids(decontaminate.cover(docs, bench).where("not contaminated")) and c.columns == docs.columns
    d = cp.mix(spark, docs, sf_dir)
    assert d.columns == docs.columns
    assert ids(d) == Counter({r.doc_id: r.copies for r in mixing.mix(docs, mixing.quality_weights(labels)).collect() if r.copies})


def test_run_keeps_what_no_stage_drops(spark, sf_dir):
    out = cp.run(spark, sf_dir).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id for r in out} <= docs and len(out) > 0.8 * len(docs)
    for s in range(cp.SHARDS):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))


def test_odd_rows_and_empty_table(spark, sf_dir):
    for rows in (odd(spark), empty(spark)):
        for _, step in cp.STAGES[:-1]:
            out = step(spark, rows, sf_dir)
            assert out.columns == rows.columns and out.dtypes == rows.dtypes
            out.collect()
        cp.shards(spark, rows, sf_dir).collect()
