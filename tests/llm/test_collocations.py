"""Collocations against counting by hand, and the guarantee of the summaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import empty, odd
from tidegrid.llm import collocations as col

SCHEMA = "doc_id bigint, text string, lang string"


def by_hand(rows, least, top):
    """The contract, phrase by phrase."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i: i + k])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = set()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            covered |= {(lang, w[i: i + k]) for i in range(len(w) - k + 1) if a >= f[lang, w[i: i + k]]}
    out = []
    for (lang, w), a in cand.items():
        if (lang, w) in covered:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    result = []
    for lang in {r[0] for r in out}:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        result += [(r[0], i, *r[1:]) for i, r in enumerate(best, 1)]
    return sorted(result)


def got(counts, top):
    return sorted(tuple(r) for r in col.collocations(counts, top).collect())


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Été", "x.y", "a\x1cb", "漢", "THE", "the", "The"]
    idioms = ["red Herring soup of the day", "kick the bucket", "ö ü"]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 60)):
            parts.append(rnd.choice(idioms) if rnd.random() < 0.1 else rnd.choice(words))
            parts.append(rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r", ";"]))
        out.append((i, "".join(parts), rnd.choice(["en", "de", None, "und"])))
    return out + [(n, "so so so so so so so so " * 20, "en"), (n + 1, None, "en"), (n + 2, "", None), (n + 1, "kick the bucket", "en")]


@pytest.mark.parametrize(("room", "least"), [(1 << 20, 5), (40, 7)])
def test_counts_and_scores_are_exact(spark, room, least):
    rows = corpus(room, 300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = by_hand([r[1:] for r in rows], least, 30)
    assert len(want) > 10
    assert got(col.frequent(df, least, room=room), 30) == want


def test_small_flushes_change_nothing(spark, monkeypatch):
    rows = corpus(3, 120)
    df = spark.createDataFrame(rows, SCHEMA)
    want = by_hand([r[1:] for r in rows], 4, 2000)
    for flush in (1, 1 << 30):
        pick = col.candidates([], False)
        monkeypatch.setattr(col, "TEXT_FLUSH", flush)
        assert got(col.frequent(df, 4), 2000) == want
        batch = next(iter(df.select("text", "lang").fillna("und").fillna("").limit(50).toArrow().to_batches()))
        assert sum(b.column("c").to_numpy().sum() for b in col._own_sums(pick)(iter([batch]))) > 0


def test_a_summary_keeps_every_frequent_key():
    rnd = np.random.default_rng(5)
    stream = np.concatenate([rnd.zipf(1.3, 20000) % 5000, rnd.integers(10**6, 10**9, 20000)]).astype(np.uint64)
    rnd.shuffle(stream)
    true, least = Counter(stream.tolist()), 50
    parts = [col.Summary(len(stream) // least + 1) for _ in range(4)]
    for k, chunk in enumerate(np.array_split(stream, 40)):
        parts[k % 4].merge(*col.summed(chunk))
    whole = parts[0]
    for p in parts[1:]:
        whole.merge(p.keys, p.counts, p.off)
    assert 0 < whole.off < least and len(whole.keys) <= whole.capacity
    held = dict(zip(whole.keys.tolist(), whole.counts.tolist()))
    assert all(held.get(k, 0) <= c <= held.get(k, 0) + whole.off for k, c in true.items())
    assert {k for k, c in true.items() if c >= least} <= {k for k, c in held.items() if c + whole.off >= least}


def test_uneven_partitions_are_dealt_again(spark):
    """A partition that takes off the threshold or more says so with a null."""
    import pyarrow as pa

    keys = np.arange(1, 5000, dtype=np.int64)
    batch = pa.RecordBatch.from_pydict({"h": pa.array(keys), "c": pa.array(np.full(len(keys), 9))})
    out = pa.Table.from_batches(list(col._merged(10, 5)(iter([batch]))))
    assert out["h"].null_count == 1
    out = pa.Table.from_batches(list(col._merged(5000, 5)(iter([batch]))))
    assert out["h"].null_count == 0 and len(out) == len(keys)


def test_gate_lets_all_members_through(spark):
    members = [0, -1, 1, 2**63 - 1, -(2**63), 123456789 << 30]
    g = col.Gate(col.gate(spark.createDataFrame([(h,) for h in members], "h bigint")).value)
    assert g(np.array(members, dtype=np.int64).view(np.uint64)).all()
    assert g(np.random.default_rng(0).integers(0, 2**63, 10000).astype(np.uint64)).sum() < 10


def test_large_products_stay_exact(spark):
    rows = [("en", 0, "", 10**13), ("en", 1, "a", 10**12), ("en", 1, "b", 10**12 + 1), ("en", 2, "a b", 10**12 - 7)]
    out = col.collocations(spark.createDataFrame(rows, "lang string, size int, phrase string, f bigint")).collect()
    assert out[0]["score"] == 1000 * (10**12 - 7) * 10**13 // (10**12 * (10**12 + 1))


def test_odd_and_empty_tables(spark):
    assert got(col.frequent(empty(spark)), 10) == []
    rows = [(r["text"], r["lang"]) for r in odd(spark).collect()]
    assert got(col.frequent(odd(spark), 2), 2000) == by_hand(rows, 2, 2000)
