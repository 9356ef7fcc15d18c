"""Repeated passages: near copies of paragraphs by MinHash banding, and passages inside longer paragraphs.

Paragraphs are lines, and blocks of lines between blank lines, of ``LINE_WORDS`` words or more. Their word shingles give 64 MinHash values in 16 bands
of 4, so that two paragraphs with similarity 0.8 meet in some band with chance 0.9998. Paragraphs that
collide are brought into blocks, their exact Jaccard similarity is checked there, and connected components
are the groups of copies.

A passage inside a longer paragraph is found through runs of ``RUN_WORDS`` words: of every ``APART`` neighbouring
runs the one with the least hash is chosen, so in each equal stretch of RUN_WORDS + APART - 1 words the same run is
chosen whatever surrounds it. All words of a chosen run that another document holds are a repeated passage; no
passage of that length is missed, but up to APART - 1 words at each end are not seen.

Of each group the document with the smallest id keeps its copy; all others lose theirs. Repeats inside one
document are left alone.

Defined results: null and empty texts have no spans; rows without an id keep a shared passage
only if no row with an id holds it, and then the first of them does, by its place in the table; rows
that repeat an id are one document; positions are bytes of the UTF-8 text, ends exclusive; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import ngram_join
from tidegrid.llm.collocations import Gate, gate
from tidegrid.llm.common import release, stage
from tidegrid.llm.tokens import Piece, distinct, pieces, scramble, shingles

LINE_WORDS = 20
BANDS, ROWS = 16, 4
RUN_WORDS = 24  # words compared at once
APART = 12  # neighbouring runs of which one at least is chosen

_A = scramble(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_B = scramble(np.arange(5001, 5001 + BANDS * ROWS, dtype=np.uint64))


def _keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Key of each row's set."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(scramble(h + np.uint64(77)), dtype=np.uint64)])
    return scramble(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def bands(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Band keys (sets x BANDS) of non-empty shingle sets."""
    out = np.zeros((len(bounds) - 1, BANDS), dtype=np.uint64)
    for b in range(BANDS):
        for r in range(ROWS):
            i = b * ROWS + r
            low = np.minimum.reduceat(scramble(h * _A[i] + _B[i]), bounds[:-1])
            out[:, b] = scramble(out[:, b] + low)
    return out


def parts(p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, word after the last) of the chosen runs of ``RUN_WORDS`` words, as places in ``p.words``.

    Of every ``APART`` neighbouring runs the one with the least hash is chosen, the last of equal ones. Equal runs
    one word apart (one word again and again) are one unit.
    """
    none = np.empty(0, dtype=np.int64)
    n = len(p.words)
    counts = np.maximum(np.diff(p.bounds) - RUN_WORDS + 1, 0)  # runs of each row
    ends = np.cumsum(counts)
    if not n or not ends[-1]:
        return np.empty(0, dtype=np.uint64), none, none
    at = np.arange(ends[-1]) + np.repeat(p.bounds[:-1] - (ends - counts), counts)
    power = np.full(n, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64).cumprod(dtype=np.uint64)
    back = np.full(n, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64), dtype=np.uint64).cumprod(dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(p.words * power, dtype=np.uint64)])
    h = scramble((sums[at + RUN_WORDS] - sums[at]) * back[at] + np.uint64(RUN_WORDS))
    chosen = np.zeros(len(h), dtype=bool)
    if len(h) >= APART:
        m = len(h) - APART + 1
        least, where = h[:m].copy(), np.arange(m)
        for j in range(1, APART):
            lower = h[j: j + m] <= least
            least[lower] = h[j: j + m][lower]
            where[lower] = np.flatnonzero(lower) + j
        row = np.repeat(np.arange(p.rows), counts)
        chosen[where[row[:m] == row[APART - 1:]]] = True
    for r in np.flatnonzero((counts > 0) & (counts < APART)):
        mine = h[ends[r] - counts[r]: ends[r]]
        chosen[ends[r] - 1 - np.argmin(mine[::-1])] = True
    pick = np.flatnonzero(chosen)
    h, at = h[pick], at[pick]
    new = np.ones(len(h) + 1, dtype=bool)
    new[1:-1] = (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1)
    return h[new[:-1]], at[new[:-1]], at[new[1:]] + RUN_WORDS


_UNITS = (
    "rid long, doc long, line boolean, f long, start int, end int, words int, bands array<long>"
)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chosen runs and paragraphs of every text; band keys once per distinct paragraph of a batch."""
    i64 = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())
    names = ["rid", "doc", "line", "f", "start", "end", "words", "bands"]
    for b in batches:
        rid, doc = b["rid"].to_numpy(), b["doc"]
        seen: set[int] = set()
        for p in pieces(b["text"]):
            count = np.diff(p.bounds)
            yield pa.RecordBatch.from_arrays(  # one row for the text itself
                [pa.array(rid[p.first: p.first + p.rows]), doc.slice(p.first, p.rows), pa.nulls(p.rows, pa.bool_()),
                 pa.nulls(p.rows, pa.int64()), *[pa.nulls(p.rows, pa.int32())] * 2, pa.array(count, pa.int32()),
                 pa.nulls(p.rows, pa.list_(pa.int64()))], names=names)
            h, first, after = parts(p)
            row = np.searchsorted(p.bounds, first, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid[row + p.first]), doc.take(pa.array(row + p.first)), pa.array(np.zeros(len(h), dtype=bool)), i64(h),
                 pa.array(p.starts[first], pa.int32()), pa.array(p.ends[after - 1], pa.int32()),
                 pa.array(after - first, pa.int32()), pa.nulls(len(h), pa.list_(pa.int64()))], names=names)
        yield from _lines(b, rid, doc, seen, names, i64)


def paragraphs(text: str | None) -> Iterator[tuple[int, bytes]]:
    """First byte and bytes of what can be a paragraph: long lines, and blocks of lines between blank ones.

    A block of one line or of long lines only has nothing that its lines do not have.
    """
    raw = (text or "").encode()
    at, first, lines, short = 0, 0, 0, False
    for line in [*raw.split(b"\n"), b""]:
        words = len(line.split())
        if words >= LINE_WORDS:
            yield at, line
        if words:
            first = first if lines else at
            lines, short = lines + 1, short or words < LINE_WORDS
        elif lines:
            if lines > 1 and short and at - 1 - first > 2 * LINE_WORDS - 2:
                yield first, raw[first: at - 1]
            lines, short = 0, False
        at += len(line) + 1


def _lines(b: pa.RecordBatch, rid: np.ndarray, doc: pa.Array, seen: set, names: list, i64) -> Iterator[pa.RecordBatch]:
    texts, row, start = [], [], []
    for r, text in enumerate(b["text"].to_pylist()):
        for at, paragraph in paragraphs(text):
            texts.append(paragraph)
            row.append(r)
            start.append(at)
    if not texts:
        return
    row, start = np.array(row), np.array(start)
    for p in pieces(pa.array(texts, pa.large_binary()).cast(pa.large_string())):
        count = np.diff(p.bounds)
        every, every_bounds = distinct(*shingles(p))
        pick = np.flatnonzero(count >= LINE_WORDS)
        if not len(pick):
            continue
        size = np.diff(every_bounds)[pick]
        bounds = np.concatenate([[0], np.cumsum(size)])
        h = every[np.repeat(every_bounds[pick] - bounds[:-1], size) + np.arange(bounds[-1])]
        key = _keys(h, bounds)
        new = []
        for i, k in enumerate(key.tolist()):
            if k not in seen:
                seen.add(k)
                new.append(i)
        found = bands(h, bounds)
        lists: list = [None] * len(pick)
        for i in new:
            lists[i] = found[i].view(np.int64)
        src = row[p.first + pick]
        base = start[p.first + pick]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rid[src]), doc.take(pa.array(src)), pa.array(np.ones(len(pick), dtype=bool)), i64(key),
             pa.array(base + p.starts[p.bounds[pick]], pa.int32()), pa.array(base + p.ends[p.bounds[pick + 1] - 1], pa.int32()),
             pa.array(count[pick], pa.int32()), pa.array(lists, pa.list_(pa.int64()))], names=names)


def _line_sets(sent):
    """Shingle sets of the wanted paragraphs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Gate(sent.value)
        for b in batches:
            lines = [x for t in b["text"].to_pylist() for _, x in paragraphs(t)]
            seen: set[int] = set()
            for p in pieces(pa.array(lines, pa.large_binary()).cast(pa.large_string())):
                h, bounds = distinct(*shingles(p))
                key = _keys(h, bounds)
                take = (np.diff(p.bounds) >= LINE_WORDS) & wanted(key)
                key = key.view(np.int64)
                rows = []
                for r in np.flatnonzero(take):
                    if key[r] not in seen:
                        seen.add(key[r])
                        rows.append(r)
                if rows:
                    sets = [h[bounds[r]: bounds[r + 1]].view(np.int64) for r in rows]
                    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[rows], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))],
                        names=["f", "tokens"])

    return task


def paragraph_blocks(units: DataFrame) -> DataFrame:
    """(leader, f): paragraphs with an equal band key go to the block of the smallest of them.

    A key names its band too: the bands are hashed differently.
    """
    keyed = units.where("line and bands is not null").select("f", F.explode("bands").alias("key"))
    ends = keyed.groupBy("key").agg(F.min("f").alias("leader"), F.max("f").alias("last")).where("leader < last")
    ends = stage(ends.select("key", "leader"), "paragraph-bands")
    met = stage(keyed.join(ends, "key").select("leader", "f").distinct(), "paragraph-blocks")
    release(ends)
    return met


def paragraph_links(met: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (src, dst) between keys of paragraphs of one block with Jaccard similarity 0.8 or more."""
    keys = met.select("f").distinct()
    wanted = gate(keys.select(F.col("f").alias("h")))
    sets = ngram_join.sets_of(keys, texts.mapInArrow(_line_sets(wanted), "f long, tokens array<long>"), "paragraph-sets")
    wanted.unpersist()
    found = ngram_join.linked_in_blocks(met, sets)
    release(sets)
    return found


def _merge(found: pd.Series) -> pd.DataFrame:
    """Repeated runs and lines of each text as byte spans."""
    out = []
    for items in found:
        spans = [(x["start"], x["end"]) for x in items]
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out.append((len(merged), sum(b - a for a, b in merged), ",".join(f"{a}:{b}" for a, b in merged)))
    return pd.DataFrame(out, columns=["n_spans", "removed_bytes", "spans"])


def repeats(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: doc_id, n_words, n_spans, removed_bytes, spans ("start:end", comma-joined)."""
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    units = stage(rows.mapInArrow(_units, _UNITS), "passages")
    spot = ["rid", "start", "end"]
    whole = stage(units.where("line is null").select("rid", "doc", F.col("words").alias("n_words")), "passage-texts")
    lines = stage(units.where("line").select(*spot, "doc", "f"), "passage-lines")

    pieces_ = units.where("not line").select(*spot, "doc", "f")
    known = pieces_.groupBy("f").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(F.when(F.col("doc").isNull(), F.col("rid"))).alias("loose"))
    # Where no row has an id, the first row keeps its copy; ``loose`` is the first row without an id.
    again = F.col("lo").isNull() | (F.col("lo") != F.col("hi")) | F.col("loose").isNotNull()
    other = F.when(F.col("lo").isNull(), F.col("rid") != F.col("loose")).otherwise(F.col("doc").isNull() | (F.col("doc") != F.col("lo")))
    known = stage(known.where(again).select("f", "lo", "loose"), "passage-keys")
    cut_parts = stage(pieces_.join(known, "f").where(other).select(*spot), "passage-cuts")
    release(known)

    # The units go before the paragraphs' sets are moved: they take most of the disk.
    met = paragraph_blocks(units)
    release(units)
    links = paragraph_links(met, df.select(F.col(text).alias("text")))
    release(met)
    comps = ngram_join.components(links)
    classes = lines.groupBy("f").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(F.when(F.col("doc").isNull(), F.col("rid"))).alias("loose"))
    classes = classes.join(comps, "f", "left").withColumn("c", F.coalesce("c", "f"))
    groups = classes.groupBy("c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("loose").alias("loose")).where(again)
    cut_lines = lines.join(classes.select("f", "c").join(groups.select("c", "lo", "loose"), "c").select("f", "lo", "loose"), "f").where(other).select(*spot)

    merge = F.pandas_udf(_merge, "n_spans int, removed_bytes long, spans string")
    spans = (
        cut_parts.unionByName(cut_lines).groupBy("rid").agg(F.collect_list(F.struct(*spot[1:])).alias("found"))  # of one text
        .select("rid", merge("found").alias("m")).select("rid", "m.*")
    )
    return whole.join(spans, "rid", "left").select(
        F.col("doc").alias("doc_id"), "n_words", F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("removed_bytes", F.lit(0).cast("long")).alias("removed_bytes"), F.coalesce("spans", F.lit("")).alias("spans"))
