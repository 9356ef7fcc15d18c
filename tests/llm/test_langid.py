import zlib

import numpy as np

from tests.llm.helpers import empty, odd
from tidegrid.llm import langid, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op9(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95


def test_bundle_equals_bound_letters():
    v = langid.Vectors(64)
    code = langid.letters_of("Ab, bé!")
    assert "".join(map(chr, code)) == " ab bé "
    want = sum(np.roll(v._letter(a), 2) * np.roll(v._letter(b), 1) * v._letter(c) for a, b, c in zip(code, code[1:], code[2:]))
    for _ in range(2):  # made, then kept
        assert np.allclose(v.bundle(*langid.trigrams(code)), want)
    assert not np.allclose(langid.Vectors(64).bundle(*langid.trigrams(langid.letters_of("eb ba"))), want)


def test_learning_ignores_partitioning_and_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = (langid.learn(x.where(~langid.held_out())) for x in (docs, docs.repartition(6)))
    assert list(a) == list(b) and all(np.allclose(a[k], b[k], atol=1e-5) for k in a)


def test_odd_rows_and_empty_table(spark):
    rows = langid.identify(odd(spark).drop("score")).collect()
    assert len(rows) == 10
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 8)} == {"und"}
    assert all(r.lang_pred == "en" for r in rows if r.doc_id in (4, 5, 6))
    assert langid.identify(empty(spark)).collect() == []
    assert {r.lang_pred for r in langid.predict(odd(spark), {}).collect()} == {"und"}


def test_rare_languages_are_learned_from_large_tables(spark):
    rows = [(i, f"the quick fox number {'abcdefgh'[i % 8] * 3} runs home", "en") for i in range(6000)]
    rows += [(10_000 + i, "быстрая лиса бежит домой", "ru") for i in range(4)]
    rows += [(None, "ταχεία αλεπού τρέχει", "el") for _ in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = langid.learn(df, most_rows=600)
    assert list(made) == ["el", "en", "ru"]
    whole = langid.learn(df.where("lang = 'ru'"))
    assert np.allclose(made["ru"], whole["ru"])
