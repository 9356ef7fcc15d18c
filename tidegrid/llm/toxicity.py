"""Toxicity scores from a factorization machine over hashed terms.

Terms are lower-cased runs of letters, hashed into 2**20 buckets; a text has or has not a bucket. The score
is the logistic of  w0 + sum of w_i + sum over pairs of <v_i, v_j>:  the pair part learns what two terms mean
together, such as an insult with the mention of a group. It is computed in time linear in the terms.

It is fitted on a bounded sample of labelled rows (``most_rows``, chosen by a hash of the id and then of the row,
so an id that repeats cannot exceed it), on the buckets whose share differs most between the classes and on those of which
some pair does, whatever its members do alone. Scoring reads every whole text once and shuffles nothing.

Defined results: null and empty texts get the score of a text without known terms; rows without a label are
scored like others; where labels of one id disagree it counts as toxic; without labelled rows of both
classes every score is 0; repeated rows are rows of their own; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import uniform
from tidegrid.llm.tokens import NOT_LETTER, pieces

BITS = 20
MOST_ROWS = 20_000  # labelled documents in the fit, as expected number
TERMS = 2048  # buckets kept in the model at most
SINGLE_Z, PAIR_Z = 3.0, 8.0  # standard errors by which a bucket, or two together, must tell the classes apart
PAIR_TERMS = 2048  # buckets whose pairs are tested, those that split the sample most evenly
RANK = 8  # factors of a term
THRESHOLD = 0.7


class Model(NamedTuple):
    place: np.ndarray  # bucket -> term of the model, -1 for others
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # terms x RANK


def _buckets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, rows, and sorted distinct (row, bucket) of each piece of a text column."""
    for p in pieces(pc.utf8_lower(column), NOT_LETTER):
        row = np.repeat(np.arange(p.rows, dtype=np.int64), np.diff(p.bounds))
        code = np.unique((row << BITS) | (p.words >> np.uint64(64 - BITS)).astype(np.int64))
        yield p.first, p.rows, code >> BITS, code & ((1 << BITS) - 1)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, rows, row, bucket in _buckets(b["text"]):
            ends = np.searchsorted(row, np.arange(rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket, pa.int32()))
            part = b.slice(first, rows)
            yield pa.RecordBatch.from_arrays([part["k"], part["h"], part["toxic"], lists], names=["k", "h", "toxic", "terms"])


def _joint(flat: np.ndarray, row: np.ndarray, toxic: np.ndarray, have: np.ndarray, most: int = PAIR_TERMS) -> np.ndarray:
    """How far each bucket's strongest pair departs from the sum of its members, in standard errors.

    The departure is p11 - p10 - p01 + p00 over the shares of toxic rows with both, one and none of two buckets,
    so it shows terms that tell nothing alone, such as a group word or an exclusive-or. Cells with too
    few rows for a normal error do not count. Done in strips, so that memory is a few hundred bytes a row.
    """
    n, base = len(toxic), float(toxic.mean())
    out = np.zeros(1 << BITS, dtype=np.float32)
    spread = base * (1 - base)
    tested = np.flatnonzero(np.minimum(have, n - have) * spread >= 5)
    tested = np.sort(tested[np.argsort(-np.minimum(have, n - have)[tested], kind="stable")[:most]])
    if len(tested) < 2:
        return out
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[tested] = np.arange(len(tested))
    keep = place[flat] >= 0
    x = np.zeros((n, len(tested)), dtype=np.uint8)
    x[row[keep], place[flat[keep]]] = 1
    each, each_pos = have[tested], x[toxic > 0].sum(0, dtype=np.int64)
    for lo in range(0, len(tested), 128):
        mine, rest = slice(lo, lo + 128), slice(lo, None)  # a pair is met once
        both = np.zeros((len(each[mine]), len(tested) - lo))
        both_pos = np.zeros_like(both)
        for at in range(0, n, 1024):
            part = x[at: at + 1024, rest].astype(np.float32)
            strip = np.ascontiguousarray(part[:, :128].T)
            both += strip @ part
            marked = toxic[at: at + 1024] > 0
            both_pos += strip[:, marked] @ part[marked]
        a, b, a_pos, b_pos = each[mine, None], each[None, rest], each_pos[mine, None], each_pos[None, rest]
        effect, error, sound = 0.0, 0.0, True
        for sign, rows, pos in ((1, both, both_pos), (-1, a - both, a_pos - both_pos), (-1, b - both, b_pos - both_pos),
                                (1, n - a - b + both, toxic.sum() - a_pos - b_pos + both_pos)):
            share = (pos + base) / (rows + 1)
            effect = effect + sign * share
            error = error + np.maximum(spread, share * (1 - share)) / np.maximum(rows, 1)
            sound = sound & (rows * spread >= 5)
        score = np.where(sound, np.abs(effect) / np.sqrt(error), 0)
        out[tested[mine]] = np.maximum(out[tested[mine]], score.max(1))
        out[tested[rest]] = np.maximum(out[tested[rest]], score.max(0))
    return out


def fit(terms: list[np.ndarray], toxic: np.ndarray, most_terms: int = TERMS, rank: int = RANK, epochs: int = 60,
        seed: int = 5) -> Model | None:
    """Fit by Adam on mini-batches; None unless both classes are present."""
    toxic = toxic.astype(np.float32)
    n, pos = len(toxic), float(toxic.sum())
    if not 0 < pos < n:
        return None
    flat, row = np.concatenate(terms).astype(np.int32, copy=False), np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in terms])
    have = np.bincount(flat, minlength=1 << BITS)
    have_pos = np.bincount(flat[toxic[row] > 0], minlength=1 << BITS)
    # Difference of the two shares in standard errors.
    share, a, b = have / n, have_pos / pos, (have - have_pos) / (n - pos)
    z = np.abs(a - b) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / pos + 1 / (n - pos)))
    z[(have < 3) | (z <= SINGLE_Z)] = 0
    joint = _joint(flat, row, toxic, have)
    z = np.maximum(z, np.where(joint > PAIR_Z, joint, 0))
    picked = np.sort(np.argsort(-z, kind="stable")[:most_terms])
    picked = picked[z[picked] > 0]
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[picked] = np.arange(len(picked))
    x = np.zeros((n, len(picked)), dtype=np.uint8)
    known = place[flat] >= 0
    x[row[known], place[flat[known]]] = 1
    rng = np.random.default_rng(seed)
    theta = [np.array([np.log(pos / (n - pos))], dtype=np.float32), np.zeros(len(picked), dtype=np.float32),
             rng.normal(0, 0.02, (len(picked), rank)).astype(np.float32)]
    first, second, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 512):
            at = order[lo: lo + 512]
            xb, (w0, w, v) = x[at].astype(np.float32), theta
            sums = xb @ v
            z_ = w0 + xb @ w + 0.5 * ((sums**2).sum(1) - xb @ (v**2).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z_, -30, 30))) - toxic[at]) / len(at)
            count = g @ xb
            grads = [g.sum(keepdims=True), count + 2e-5 * w, xb.T @ (g[:, None] * sums) - count[:, None] * v + 5e-4 * v]
            step += 1
            for t, m, s, d in zip(theta, first, second, grads):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                t -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Model(place, float(theta[0][0]), theta[1], theta[2])


def learn(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", toxic: str = "toxic",
          most_rows: int = MOST_ROWS) -> Model | None:
    """Fit on a sample of the labelled rows of ``labels``; of ``df`` only those rows' texts are used."""
    marks = labels.where(F.col(id).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(id).alias("k")).agg(
        F.max(toxic).cast("int").alias("toxic"))
    n = marks.count()
    if n > most_rows:
        marks = marks.where(uniform("k", seed=11) < most_rows / n)
    # The sample is bounded, so it goes to the texts and not the other way.
    rows = df.select(F.col(id).alias("k"), F.col(text).alias("text")).join(F.broadcast(marks), "k").select("k", "toxic", "text")
    # An id that repeats brings all its rows: the texts of one id count once each, and the rows are bounded too.
    rows = rows.withColumn("h", F.xxhash64("text"))
    many = rows.select("k", "h").distinct().count()
    if many > 2 * most_rows:
        rows = rows.where(uniform("k", "h", seed=12) < most_rows / many)
    rows = rows.dropDuplicates(["k", "h"])
    got = rows.mapInArrow(_terms, f"k {dict(rows.dtypes)['k']}, h long, toxic int, terms array<int>").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["k", "h"], kind="stable")
    terms, marks = got["terms"].tolist(), got["toxic"].to_numpy()
    del got
    return fit(terms, marks)


def score_column(model: Model | None, column: pa.Array) -> np.ndarray:
    if model is None:
        return np.zeros(len(column))
    out = np.empty(len(column))
    square = (model.factors.astype(np.float64) ** 2).sum(1)
    for first, rows, row, bucket in _buckets(column):
        term = model.place[bucket]
        row, term = row[term >= 0], term[term >= 0]
        add = lambda v: np.bincount(row, weights=v, minlength=rows)
        z = model.bias + add(model.linear[term]) - 0.5 * add(square[term])
        for f in range(model.factors.shape[1]):
            z += 0.5 * add(model.factors[term, f]) ** 2
        out[first: first + rows] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def score(df: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` and ``predicted`` to every row."""
    rows = df.drop("score", "predicted")
    keep = rows.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b[c] for c in keep] + [pa.array(score_column(model, b[text]), pa.float64())], names=[*keep, "score"])

    out = rows.mapInArrow(task, rows.select("*", F.lit(0.0).alias("score")).schema)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id: str | Column = "doc_id") -> Column:
    id = F.col(id) if isinstance(id, str) else id
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
