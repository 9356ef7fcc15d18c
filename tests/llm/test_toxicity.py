import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.helpers import empty, odd
from tidegrid.llm import queries, toxicity


def auc(scores, marks):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    pos = np.array(marks) == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_documents_are_ranked_well(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op6(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in rows.items())
    assert all(r.predicted == (r.score >= 0.7) for r in rows.values())
    marks = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert auc([rows[d].score for d, _ in marks], [t for _, t in marks]) > 0.95
    flagged = [t for d, t in marks if rows[d].predicted]
    assert np.mean(flagged) > 0.95 and len(flagged) > 0.6 * sum(t for _, t in marks)


def test_pairs_are_learned():
    """Two terms that are toxic together only: no sum of single weights can tell."""
    rng = random.Random(2)
    texts, marks = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=6) + ["insult"] * a + ["group"] * b))
        marks.append(int(a and b))
    terms = [bucket for _, _, row, all_ in toxicity._buckets(pa.array(texts)) for bucket in np.split(all_, np.searchsorted(row, np.arange(1, row.max() + 1)))]
    model = toxicity.fit(terms, np.array(marks))
    got = toxicity.score_column(model, pa.array(["insult alpha group", "insult alpha", "group beta", "gamma", None, ""]))
    assert got[0] > 0.7 and (got[1:] < 0.3).all()
    # The linear-time form equals the sum over all pairs.
    t = np.unique(model.place[np.concatenate([b for *_, b in toxicity._buckets(pa.array(["insult alpha group"]))])])
    t = t[t >= 0]
    z = model.bias + model.linear[t].sum() + sum(float(model.factors[i] @ model.factors[j]) for k, i in enumerate(t) for j in t[k + 1:])
    assert abs(got[0] - 1 / (1 + np.exp(-z))) < 1e-6


def fitted(rows):
    texts, marks = zip(*rows)
    terms = [bucket for _, n, row, all_ in toxicity._buckets(pa.array(texts)) for bucket in np.split(all_, np.searchsorted(row, np.arange(1, n)))]
    return toxicity.fit(terms, np.array(marks))


def noise(rng):
    return [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in rng.choices(range(400), k=20)]


def test_terms_that_tell_nothing_alone_are_learned():
    """Exclusive-or: each of two terms is as common in toxic as in clean rows."""
    rng = random.Random(3)
    rows = []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((" ".join(noise(rng) + ["left"] * a + ["right"] * b), int(a != b)))
    got = toxicity.score_column(fitted(rows), pa.array(["left wab", "right wab", "left right wab", "wab wac"]))
    assert (got[:2] > 0.7).all() and (got[2:] < 0.3).all()


def test_a_neutral_group_word_is_learned_beside_an_insult():
    rng = random.Random(4)
    rows = []
    for _ in range(4000):
        toxic, group = rng.random() < 0.3, rng.random() < 0.5  # the group word is equally common in both classes
        rows.append((" ".join(noise(rng) + ["insult" if toxic == group else "slur"] + ["group"] * group), int(toxic)))
    got = toxicity.score_column(fitted(rows), pa.array(["insult group", "slur", "insult", "slur group"]))
    assert (got[:2] > 0.7).all() and (got[2:] < 0.3).all()


def test_joint_effect_equals_the_plain_count():
    rng = np.random.default_rng(5)
    x, y = rng.random((900, 6)) < [0.5, 0.4, 0.6, 0.3, 0.5, 0.01], rng.random(900) < 0.4
    y |= x[:, 0] & x[:, 2]
    row, flat = np.nonzero(x)
    got = toxicity._joint(flat, row, y.astype(np.float32), np.bincount(flat, minlength=1 << toxicity.BITS))
    p = y.mean()
    best = np.zeros(6)
    for i in range(5):
        for j in range(5):
            cells = [y[(x[:, i] == u) & (x[:, j] == v)] for u, v in ((1, 1), (1, 0), (0, 1), (0, 0))]
            if min(map(len, cells)) * p * (1 - p) < 5:
                continue
            share = [(c.sum() + p) / (len(c) + 1) for c in cells]
            error = sum(max(p * (1 - p), q * (1 - q)) / len(c) for q, c in zip(share, cells))
            best[i] = max(best[i], abs(share[0] - share[1] - share[2] + share[3]) / error**0.5)
    assert np.allclose(got[:6], best, rtol=1e-4) and not got[6:].any() and best[5] == 0


def test_rows_to_the_driver_are_bounded_when_ids_repeat(spark, monkeypatch):
    rows = [(1, f"text number {chr(97 + i % 26)}{chr(97 + i // 26)} here") for i in range(600)] + [(2, "an insult"), (2, "an insult")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda terms, toxic: seen.append(len(toxic)))
    toxicity.learn(docs, marks)
    toxicity.learn(docs, marks, most_rows=50)
    assert seen[0] == 601 and 10 < seen[1] < 110


def test_fit_needs_both_classes_and_ignores_order(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    assert toxicity.learn(docs, labels.where("toxic = 0")) is None
    assert toxicity.learn(docs, labels.where(F.lit(False))) is None
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs.repartition(5), labels.union(labels))
    assert np.allclose(a.linear, b.linear) and np.allclose(a.factors, b.factors)


def test_odd_rows_and_empty_table(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    rows = toxicity.score(odd(spark), model).collect()
    assert len(rows) == 10 and len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(empty(spark), model).collect() == []
    assert {r.score for r in toxicity.score(odd(spark), None).collect()} == {0.0}
    unlabelled = labels.select("doc_id", F.lit(None).cast("int").alias("toxic"))
    assert toxicity.learn(docs, unlabelled) is None
