"""Benchmark decontamination by greedy string tiling.

Shared runs of five words (Karp-Rabin hashes) are the seeds that bring a document and a test item together.
Seeds on one diagonal make maximal matches; again and again the longest match is marked and its words are
taken out of play, until no unmarked run of five words is left. Coverage is the share of the item's words
that are marked, so an item whose sentences were reordered is still covered.

The items are a stated test set. While its words are below ``most_words`` it is sent to all tasks and each
document is read once, without a shuffle; beyond that, seeds are joined as tables and only pairs that share
one are brought together.

Defined results: null and empty texts are never contaminated; items with fewer than five words (null ones
too) match nothing; repeated rows get one result each; ties go to the smaller item id; without documents or
without items nothing is contaminated; other columns pass through. Memory follows the runs of equal seeds, not their
pairs, so a long text of one repeated word is like any other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import stage, word_count
from tidegrid.llm.tokens import K, Piece, distinct, pieces, shingles

THRESHOLD = 0.6
MOST_WORDS = 2_000_000  # of all items together, for sending them to every task
PAIRS = 1_000_000  # of equal seeds held at once
_ADDED = "hit_item long, coverage double, tiles int"


class Runs(NamedTuple):
    """Unbroken runs of equal seeds, sorted by item, diagonal (document place less item place) and first place."""

    owner: np.ndarray
    diagonal: np.ndarray
    first: np.ndarray  # item place
    last: np.ndarray


def runs(owner: np.ndarray, diagonal: np.ndarray, first: np.ndarray, last: np.ndarray) -> Runs:
    """Join runs that follow one another; a single pair of equal seeds is a run of one."""
    order = np.lexsort((first, diagonal, owner))
    owner, diagonal, first, last = owner[order], diagonal[order], first[order], last[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (diagonal[1:] != diagonal[:-1]) | (first[1:] != last[:-1] + 1)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(order))[: len(starts)] - 1
    return Runs(owner[starts], diagonal[starts], first[starts], last[ends])


def tile(doc_words: int, item_words: int, diagonal: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[int, int]:
    """Marked words of the item and number of tiles, from the runs of one document with one item."""
    length = last - first + K
    # The matches in order of length wait in arrays, only what is left of a broken one goes to the heap.
    order = np.lexsort((first + diagonal, first, -length))
    free_item, free_doc = np.ones(item_words, dtype=bool), np.ones(doc_words, dtype=bool)
    heap: list[tuple[int, int, int]] = []
    marked = tiles = at = 0
    while (heap or at < len(order)) and marked <= item_words - K:
        k = order[at] if at < len(order) else -1
        top = (-int(length[k]), int(first[k]), int(first[k] + diagonal[k])) if k >= 0 else None
        if top is None or (heap and heap[0] < top):
            top = heapq.heappop(heap)
        else:
            at += 1
        words, i, d = -top[0], top[1], top[2]
        free = free_item[i: i + words] & free_doc[d: d + words]
        if free.all():
            free_item[i: i + words] = False
            free_doc[d: d + words] = False
            marked, tiles = marked + words, tiles + 1
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):  # what is left of it may still be the longest
            if b - a >= K:
                heapq.heappush(heap, (-(b - a), i + a, d + a))
    return marked, tiles


class Items:
    """The test set with its seeds in one sorted array."""

    def __init__(self, ids: list, texts: list):
        self.ids, self.words, seeds, owner, place = [], [], [], [], []
        for p in pieces(pa.array(texts, pa.large_string())):
            h, bounds = shingles(p, whole_short=False)
            for r in range(p.rows):
                mine = h[bounds[r]: bounds[r + 1]]
                if ids[p.first + r] is None or not len(mine):
                    continue
                seeds.append(mine)
                owner.append(np.full(len(mine), len(self.ids)))
                place.append(np.arange(len(mine)))
                self.ids.append(ids[p.first + r])
                self.words.append(p.words[p.bounds[r]: p.bounds[r + 1]])
        flat = lambda x, t: np.concatenate(x) if x else np.empty(0, dtype=t)
        seeds, owner, place = flat(seeds, np.uint64), flat(owner, np.int64), flat(place, np.int64)
        self.flat = flat(self.words, np.uint64)
        self.begin = np.cumsum([0, *map(len, self.words)])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.place = seeds[order], owner[order], place[order]

    def best(self, p: Piece) -> Iterator[tuple[int | None, float, int]]:
        """Best covered item, coverage and tiles of each row of a piece."""
        h, bounds = shingles(p, whole_short=False)
        lo = np.searchsorted(self.seeds, h, side="left")
        found = np.zeros(len(h), dtype=bool)
        inside = lo < len(self.seeds)
        found[inside] = self.seeds[lo[inside]] == h[inside]
        at = np.flatnonzero(found)
        hi = np.searchsorted(self.seeds, h[at], side="right")
        cut = np.searchsorted(at, bounds)
        lo = lo[at]
        for r in range(p.rows):
            top = (None, 0.0, 0)
            doc = p.words[p.bounds[r]: p.bounds[r + 1]]
            mine = slice(cut[r], cut[r + 1])
            met = self._runs(doc, at[mine] - bounds[r], lo[mine], hi[mine])
            edges = [0, *(np.flatnonzero(np.diff(met.owner)) + 1).tolist(), len(met.owner)]
            for a, z in zip(edges, edges[1:]):
                if a == z:
                    continue
                o = int(met.owner[a])
                marked, tiles = tile(len(doc), len(self.words[o]), met.diagonal[a:z], met.first[a:z], met.last[a:z])
                share = marked / len(self.words[o])
                if share > top[1] or (share == top[1] and top[0] is not None and self.ids[o] < top[0]):
                    top = (self.ids[o], share, tiles)
            yield top

    def _runs(self, doc: np.ndarray, spot: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Runs:
        """Runs of the seeds at ``spot`` with all items; the pairs of equal seeds are made ``PAIRS`` or so at a time."""
        ends = np.cumsum(hi - lo)
        found = [Runs(*[np.empty(0, dtype=np.int64)] * 4)]
        a = 0
        while a < len(spot):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
            count = (hi - lo)[a:z]
            back = np.cumsum(count) - count
            seed = np.arange(count.sum()) - np.repeat(back - lo[a:z], count)
            d, i, owner = np.repeat(spot[a:z], count), self.place[seed], self.owner[seed]
            same = np.ones(len(seed), dtype=bool)
            for k in range(K):  # equal hashes, equal words
                same &= self.flat[self.begin[owner] + i + k] == doc[d + k]
            found.append(runs(owner[same], (d - i)[same], i[same], i[same]))
            a = z
        return runs(*[np.concatenate(x) for x in zip(*found)])


def _scan(rows: DataFrame, items: Items, text: str) -> DataFrame:
    keep = rows.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [x for p in pieces(b[text]) for x in items.best(p)]
            cols = [pa.array([x[i] for x in got], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b[c] for c in keep] + cols, names=[*keep, "hit_item", "coverage", "tiles"])

    types = rows.select("*", F.lit(None).cast("long").alias("hit_item"), F.lit(0.0).alias("coverage"), F.lit(0).alias("tiles"))
    return rows.mapInArrow(task, types.schema)


def _joined(rows: DataFrame, tests: DataFrame, text: str) -> DataFrame:
    """The same result for a test set of any size: join seeds, then tile each pair that shares one."""
    rows = stage(rows.withColumn("_rid", F.monotonically_increasing_id()), "decontaminate")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b["t"]):
                h, bounds = distinct(*shingles(p, whole_short=False))
                key = np.repeat(b["k"].to_numpy(zero_copy_only=False)[p.first: p.first + p.rows], np.diff(bounds))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(h.view(np.int64))], names=["k", "h"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for item, test, doc in zip(b["item_id"].to_pylist(), b["test"].to_pylist(), b["doc"]):
                one = Items([item], [test])
                out += [x for p in pieces(pa.array([doc.as_py()], pa.large_string())) for x in one.best(p)]
            cols = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b["_rid"], *cols], names=["_rid", "hit_item", "coverage", "tiles"])

    of = lambda df, key, t: df.select(F.col(key).alias("k"), F.col(t).alias("t")).mapInArrow(seeds, "k long, h long")
    pairs = of(rows, "_rid", text).withColumnRenamed("k", "_rid").join(
        of(tests, "item_id", "test").withColumnRenamed("k", "item_id"), "h").select("_rid", "item_id").distinct()
    full = pairs.join(rows.select("_rid", F.col(text).alias("doc")), "_rid").join(tests, "item_id")
    best = full.mapInArrow(pair, "_rid long, " + _ADDED).groupBy("_rid").agg(
        F.max(F.struct("coverage", (-F.col("hit_item")).alias("m"), "hit_item", "tiles")).alias("b"))
    out = rows.join(best, "_rid", "left")
    return out.withColumns({
        "hit_item": F.col("b.hit_item"), "coverage": F.coalesce("b.coverage", F.lit(0.0)), "tiles": F.coalesce("b.tiles", F.lit(0)),
    }).drop("b", "_rid")


def cover(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
          threshold: float = THRESHOLD, most_words: int = MOST_WORDS) -> DataFrame:
    """Add hit_item, coverage, tiles and contaminated (coverage of some item at or above ``threshold``)."""
    tests = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("test")).where(
        "item_id is not null and test is not null")
    rows = df.drop("hit_item", "coverage", "tiles", "contaminated")
    words = tests.agg(F.sum(word_count("test"))).first()[0] or 0
    if words <= most_words:
        got = tests.collect()  # bounded by the check above
        out = _scan(rows, Items([r["item_id"] for r in got], [r["test"] for r in got]), text)
    else:
        out = _joined(rows, tests, text)
    return out.withColumn("contaminated", F.col("coverage") >= threshold)
