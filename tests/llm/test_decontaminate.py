import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.helpers import empty, odd
from tidegrid.llm import decontaminate, queries, tokens

LONG_TEST = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango"


def greedy(doc, item, least=5):
    """Marked item words: search every pair of places for the longest unmarked match, again and again."""
    used_d, used_i, marked = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not used_i[i + n] and not used_d[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        if best[0] < least:
            return marked
        n, i, d = best
        used_i[i: i + n] = used_d[d: d + n] = [True] * n
        marked += n


def tiled(doc, item):
    place, spot = np.array(hits_of(doc, item), dtype=np.int64).reshape(-1, 2).T
    met = decontaminate.runs(np.zeros_like(place), spot - place, place, place)
    return decontaminate.tile(len(doc), len(item), *met[1:])


def hits_of(doc, item):
    at = {}
    for d in range(len(doc) - 4):
        at.setdefault(tuple(doc[d: d + 5]), []).append(d)
    return [(i, d) for i in range(len(item) - 4) for d in at.get(tuple(item[i: i + 5]), [])]


def test_tiling_against_exhaustive_search():
    rng = random.Random(5)
    for _ in range(60):
        item = [rng.randrange(4) for _ in range(rng.randrange(5, 25))]
        cut = rng.randrange(len(item))
        doc = item[cut:] + [rng.randrange(4) for _ in range(10)] + item[:cut]
        got, _ = tiled(doc, item)
        assert abs(got - greedy(doc, item)) <= 4  # equal lengths may be taken in another order
    item = list(range(30))
    doc = item[15:] + [99] + item[:15]
    assert tiled(doc, item) == (30, 2)


def test_words_and_shingles_against_plain_python():
    texts = ["A b  C\tdé", None, "", " x ", "one two three four five six", "ONE two three four five", "w " * 9]
    seen = {}
    got = []
    for p in tokens.pieces(pa.array(texts)):
        h, bounds = tokens.shingles(p)
        u, ub = tokens.distinct(h, bounds)
        for r in range(p.rows):
            words = p.words[p.bounds[r]: p.bounds[r + 1]].tolist()
            plain = (texts[r] or "").translate({c: c + 32 for c in range(65, 91)}).split()
            assert len(words) == len(plain)
            for a, b in zip(words, plain):
                assert seen.setdefault(a, b) == b
            got.append(set(u[ub[r]: ub[r + 1]].tolist()))
    assert [len(s) for s in got] == [1, 0, 0, 1, 2, 1, 1]
    assert got[5] < got[4] and len(set(seen.values())) == len(seen)


def cases(spark):
    w = LONG_TEST.split()
    docs = [
        (1, "before " + LONG_TEST.upper() + " after", None), (2, " ".join(w[10:] + ["x"] + w[:10]), "r"), (3, " ".join(w[:8]), "r"),
        (4, " ".join(w[::-1]), "r"), (5, None, "r"), (6, "", "r"), (2, " ".join(w[10:] + ["x"] + w[:10]), "r"), (None, LONG_TEST, "r"),
    ]
    tests = [(7, LONG_TEST), (9, LONG_TEST), (8, "too short"), (3, None), (None, "no id " * 9), (10, "")]
    return (spark.createDataFrame(docs, "doc_id long, text string, coverage string"), spark.createDataFrame(tests, "item_id long, text string"))


def test_both_ways_agree_and_catch_reordered_passages(spark):
    docs, tests = cases(spark)
    one, other = (sorted(map(str, decontaminate.cover(docs, tests, most_words=m).collect())) for m in (10**6, 0))
    assert one == other and len(one) == 8
    got = {r.doc_id: r for r in decontaminate.cover(docs, tests).collect()}
    assert [k for k in got if got[k].contaminated] == [1, 2, None] or {k for k in got if got[k].contaminated} == {1, 2, None}
    assert got[1].hit_item == 7 and got[2].tiles == 2 and got[3].coverage == 0.4 and got[4].coverage == 0.0


def test_query_against_containment(spark):
    sf = "/root/testdata/sf0.01"
    words = lambda t: (t or "").lower().split()
    tests = [" ".join(words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r.doc_id: " ".join(words(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1(spark, sf).collect()
    whole = {d for d, t in docs.items() if any(x in t for x in tests)}
    assert len(rows) == len(docs) and whole <= {r.doc_id for r in rows if r.contaminated}
    assert all(r.coverage < 0.3 for r in rows if not r.contaminated)


def test_odd_rows_and_empty_tables(spark):
    docs, tests = cases(spark)
    for m in (10**6, 0):
        assert decontaminate.cover(odd(spark), tests, most_words=m).where("contaminated").count() == 0
        assert decontaminate.cover(odd(spark), tests, most_words=m).count() == 10
        assert decontaminate.cover(empty(spark), tests, most_words=m).collect() == []
        assert decontaminate.cover(docs, tests.where(F.lit(False)), most_words=m).where("contaminated").count() == 0


def test_long_texts_of_one_word_take_little_memory(monkeypatch):
    import time
    import tracemalloc

    items = decontaminate.Items([1, 2], ["ha " * 200, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50))])
    tracemalloc.start()
    began = time.time()
    got = [x for p in decontaminate.pieces(pa.array(["ha " * 200_000, "ha " * 100])) for x in items.best(p)]
    assert got == [(1, 1.0, 1), (1, 0.5, 1)]
    assert tracemalloc.get_traced_memory()[1] < 300e6 and time.time() - began < 60
    tracemalloc.stop()
    # The pairs made at once do not change the result.
    texts = pa.array(["ha " * 700 + "ho " * 20 + "ha " * 90])
    whole = [x for p in decontaminate.pieces(texts) for x in items.best(p)]
    monkeypatch.setattr(decontaminate, "PAIRS", 300)
    assert [x for p in decontaminate.pieces(texts) for x in items.best(p)] == whole
