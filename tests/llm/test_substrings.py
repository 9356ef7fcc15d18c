import glob
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import empty, odd
from tidegrid.llm import queries, substrings, tokens
from tidegrid.llm.common import CLEANUP, stage
from tidegrid.session import work_root


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))


def removed(row, text):
    raw = text.encode()
    return " ".join(raw[int(a): int(b)].decode() for a, b in (s.split(":") for s in row.spans.split(",") if s)).split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    passage, line = words(rng, 60), words(rng, 60)
    edited = line.split()
    edited[30] = "other"
    docs = {i: words(rng, 150) for i in range(40)}
    docs |= {100 + i: f"{words(rng, 37 + i)} {passage} {words(rng, 50)}" for i in range(20)}  # inside one long paragraph
    docs |= {200: f"{words(rng, 30)}\n{line}\n{words(rng, 9)}", 201: f"{words(rng, 30)}\n{' '.join(edited)}", 202: line.upper()}
    docs |= {300: f"{line[:50]}", 301: "short line\n" * 50, 302: "short line\n" * 50}
    return docs, passage, line


def test_planted_passages_are_found_and_others_left_alone(spark, corpus):
    docs, passage, line = corpus
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.repeats(df.repartition(5)).collect()}
    assert set(got) == set(docs)
    assert all(got[i].spans == "" for i in [*range(40), 100, 200, 300])
    inside = set(passage.split())
    shares = [len(set(removed(got[i], docs[i])) & inside) / 60 for i in range(101, 120)]
    assert min(shares) > 0.4
    assert all(set(removed(got[i], docs[i])) <= inside for i in range(101, 120))
    assert removed(got[201], docs[201]) == docs[201].split("\n")[1].split()
    assert removed(got[202], docs[202]) == line.upper().split()
    again = {r.doc_id: r for r in substrings.repeats(df).collect()}
    assert again == got


def test_query_finds_long_repeats(spark):
    sf = "/root/testdata/sf0.01"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op4(spark, sf).collect()}
    assert set(got) == {d for d, _ in docs}
    first, need, hit = {}, 0, 0
    for d, t in docs:
        w = (t or "").lower().split()
        again = set()
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i: i + 50]), d) != d:
                again |= set(range(i, i + 50))
        if len(again) == len(w) and w:
            need, hit = need + 1, hit + (len(removed(got[d], t)) > 0.8 * len(w))
    assert need and hit >= 0.9 * need


def test_bands_collide_for_similar_sets_and_parts_are_local():
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    near = base[:30] + ["x"] + base[31:]
    far = words(rng, 60).split()
    p = next(tokens.pieces(pa.array([" ".join(x) for x in (base, near, far)])))
    b = substrings.bands(*tokens.distinct(*tokens.shingles(p)))
    assert (b[0] == b[1]).any() and not (b[0] == b[2]).any()
    shared = words(rng, 80)
    p = next(tokens.pieces(pa.array([shared, words(rng, 13) + " " + shared + " " + words(rng, 5)])))
    h, first, _ = substrings.parts(p)
    one, two = set(h[first < 80].tolist()), set(h[first >= 80].tolist())
    assert len(one & two) >= len(one) - 2


def test_odd_rows_and_empty_table(spark):
    got = substrings.repeats(odd(spark)).collect()
    assert len(got) == 10 and all(r.spans == "" for r in got)
    assert substrings.repeats(empty(spark)).collect() == []
    t = words(random.Random(1), 60)
    null_id = spark.createDataFrame([(None, t), (None, t), (4, t), (4, t)], "doc_id long, text string").withColumn("f", F.lit("x"))
    got = substrings.repeats(null_id).collect()
    assert all((r.spans == "") == (r.doc_id == 4) for r in got)


def test_one_row_without_an_id_keeps_what_no_other_row_holds(spark):
    rng = random.Random(21)
    line, passage = words(rng, 60), words(rng, 60)
    inside = lambda: f"{words(rng, 40)} {passage} {words(rng, 40)}"
    rows = [(None, line), (None, line), (None, line), (None, inside()), (None, inside()), (7, words(rng, 60)), (None, f"{words(rng, 30)} {line[:80]}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substrings.repeats(df).collect()
    assert len(got) == 7
    whole = [r for r in got if r.n_words == 60 and r.doc_id is None]
    assert sorted(r.spans != "" for r in whole) == [False, True, True]
    assert sorted(r.spans != "" for r in got if r.n_words == 140) == [False, True]
    assert [r.spans for r in got if r.doc_id == 7] == [""]


def test_no_passage_of_over_fifty_words_is_lost(spark):
    rng = random.Random(11)
    docs, inside = {}, {}
    for i in range(300):
        passage = words(rng, 51 + i % 10)
        inside[1000 + i] = passage.split()
        docs[i] = f"{words(rng, 40)} {passage} {words(rng, 30)}"
        docs[1000 + i] = f"{words(rng, 25 + i % 7)} {passage} {words(rng, 45)}"
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: removed(r, docs[r.doc_id]) for r in substrings.repeats(df).collect()}
    assert all(not got[i] for i in range(300))
    for i, passage in inside.items():
        assert len(got[i]) >= len(passage) - 2 * (24 - 13) and set(got[i]) <= set(passage)


def test_common_short_runs_are_no_passage(spark):
    """Five words at a time occur elsewhere, but never 24 in a row."""
    rng = random.Random(12)
    phrases = [words(rng, 5) for _ in range(40)]
    docs = [(i, " ".join(rng.sample(phrases, 30))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert all(r.spans == "" for r in substrings.repeats(df).collect())


def test_near_copies_of_wrapped_paragraphs(spark):
    rng = random.Random(13)
    wrap = lambda w: "\n".join(" ".join(w[i: i + 12]) for i in range(0, len(w), 12))
    docs, copies = {}, {}
    for i in range(30):
        one = words(rng, 100).split()
        edited = list(one)
        edited[25 + i % 5], edited[70 - i % 7] = "other", "words"
        docs[i] = f"{wrap(words(rng, 30).split())}\n\n{wrap(one)}\n \n{wrap(words(rng, 40).split())}"
        docs[100 + i] = f"é {wrap(words(rng, 50).split())}\n\n{wrap(edited)}"
        copies[100 + i] = edited
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: removed(r, docs[r.doc_id]) for r in substrings.repeats(df).collect()}
    assert all(not got[i] for i in range(30))
    assert all(got[i] == w for i, w in copies.items())


def test_paragraphs_are_long_lines_and_blocks():
    long = " ".join(["word"] * 20)
    text = f"a\n{long}\n\r\n{long}\n{long}\n\nalone\n" + "\n".join(["b c d e f g h"] * 9)
    raw = text.encode()
    got = list(substrings.paragraphs(text))
    assert [p for _, p in got] == [long.encode(), f"a\n{long}".encode(), long.encode(), long.encode(), raw[raw.index(b"alone"):]]
    assert all(raw[at: at + len(p)] == p for at, p in got)
    assert list(substrings.paragraphs(None)) == list(substrings.paragraphs("")) == []


def test_staging_leaves_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*")}
    before, setting = files(), spark.conf.get(CLEANUP, "false")
    staged = stage(spark.range(10000).groupBy((F.col("id") % 100).alias("k")).count(), "counted")
    for _ in range(50):  # they are removed in the background
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(CLEANUP, "false") == setting
    assert staged.count() == 100


def test_units_and_sets_go_before_the_result_is_read(spark, corpus):
    docs, _, _ = corpus
    left = lambda: {d for name in ("passages", "passage-keys", "paragraph-bands", "paragraph-blocks", "paragraph-sets") for d in glob.glob(f"{work_root(spark)}/{name}-*")}
    before = left()
    got = substrings.repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert left() == before
    assert got.count() == len(docs)
