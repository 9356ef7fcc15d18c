import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import empty, odd
from tidegrid.llm import ngram_join, queries


def sets_of(docs):
    out = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def expected(docs):
    """Smallest reachable id over all pairs of documents."""
    sets = sets_of(docs)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(rng, n, edits, size=90):
    """Chains of near copies of one text, so that ends of a chain need the links between."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        words = list(words)
        for _ in range(edits):
            words[rng.randrange(size)] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [256, 3])
def test_chains_copies_and_shared_passages(spark, block):
    rng = random.Random(block)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [t for k in (1, 2, 3) for t in family(rng, 14, k)]
    texts += [passage + " " + " ".join(f"u{i}x{rng.randrange(10**6)}" for _ in range(25)) for i in range(30)]
    texts += [passage + " " + " ".join(f"q{j}" for j in range(k)) for k in range(8)] + ["Same Copy of a text here"] * 20 + ["a b", "A b", "", None, "c"]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.groups(df, block=block).collect()}
    assert got == expected(docs)
    kept = sorted(r.doc_id for r in ngram_join.one_per_group(df, block=block).collect())
    assert kept == sorted({c for _, c in got.values()})


def test_order_by_one_frequent_shingle_gives_the_same(spark):
    docs = list(enumerate(family(random.Random(3), 25, 2)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.groups(df, frequent=1).collect()}
    assert got == expected(docs)


def template_pages(n, shared=84, size=100):
    """Pages that share ``shared`` of their words: similar, but below 0.8."""
    return [" ".join([f"t{k}" for k in range(shared)] + [f"u{i}x{k}" for k in range(size - shared)]) for i in range(n)]


def test_template_pages_move_sets_in_proportion(spark, monkeypatch):
    moved = []
    real = ngram_join._links
    monkeypatch.setattr(ngram_join, "_links", lambda blocks, sets: moved.append(blocks.count()) or real(blocks, sets))
    per_page = []
    for n in (128, 512):
        moved.clear()
        texts = template_pages(n)
        # every eighth page has a near copy: its links must be found among the others
        docs = list(enumerate(texts + [t.replace(f"u{8 * i}x15", "other") for i, t in enumerate(texts[::8])]))
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
        got = {r.id: r.component_id for r in ngram_join.groups(df, block=16).collect()}
        assert got == {i: i if i < n else 8 * (i - n) for i, _ in docs}
        per_page.append(sum(moved) / len(docs))
    assert per_page[1] < 1.5 * per_page[0] and per_page[1] < 8


def test_links_across_sizes_in_divided_blocks(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(130)]
    docs = [words[: rng.randrange(70, 131)] for _ in range(50)]
    for d in docs:
        for _ in range(rng.randrange(6)):
            d[rng.randrange(len(d))] = f"x{rng.randrange(10**6)}"
    docs = list(enumerate(" ".join(d) for d in docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.groups(df, block=2).collect()}
    assert got == expected(docs)


def test_query_against_all_pairs(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7(spark, sf_dir).collect()}
    assert got == expected(docs)


def test_trie_against_set_arithmetic():
    rng = random.Random(1)
    sets = [np.array(sorted(rng.sample(range(60), rng.randrange(1, 40))), dtype=np.uint64) for _ in range(80)]
    sets += [np.delete(s, rng.randrange(len(s))) for s in sets if len(s) > 8]
    trie = ngram_join.Trie(sets)
    for s in sets[::3] + [np.array([5, 999], dtype=np.uint64)]:
        want = {j for j, t in enumerate(sets) if 5 * len(set(s.tolist()) & set(t.tolist())) >= 4 * len(set(s.tolist()) | set(t.tolist()))}
        assert set(trie.matches(trie.ranks_of(s), len(s))) == want


def test_odd_rows_and_empty_table(spark):
    got = ngram_join.groups(odd(spark)).collect()
    assert len(got) == 10
    by = {r.id: r for r in got}
    assert by[4].component_id == by[5].component_id == 4
    assert all(by[i].component_id == i and by[i].n_shingles == 0 for i in (1, 2, 3))
    kept = ngram_join.one_per_group(odd(spark))
    assert kept.columns == odd(spark).columns
    assert kept.count() == 8  # one of the three copies stays
    assert ngram_join.groups(empty(spark)).collect() == []
    assert ngram_join.one_per_group(empty(spark)).collect() == []
    null_ids = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.groups(null_ids).collect()} == {3}
    assert ngram_join.one_per_group(null_ids.withColumn("x", F.lit(1))).count() == 1
