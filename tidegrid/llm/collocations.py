"""Phrase collocations: frequent n-grams by mergeable Misra-Gries summaries, then exact counts and scores.

Words are found and hashed with numpy over Arrow buffers inside tasks. Three rounds look for frequent words,
then word pairs of frequent words, then longer runs of frequent pairs. In each round a task sums up its own
n-grams (a full summary is passed on, not cut, so it adds no error), the sums are dealt by hash, and every hash
partition merges them into one Misra-Gries summary. Its capacity is above its share of all n-grams divided by
the threshold, so that what a summary takes off stays below the threshold: no frequent n-gram is lost. That is
checked, and a round whose hash partitions turn out too uneven is done again with more of them. What may be
frequent goes into a bitmap of fixed size that gates the next round; a gate may let too much through, never too
little. A last pass counts the survivors exactly, and the scores are joins on these counts.

A hot n-gram is one row of each task's sums. Broadcast are only the bitmaps (8 MB each). Tables between rounds
are written to the shared folder.

Defined results: a null text is empty; a null language is ``und``, together with documents labelled so; repeated
rows count as often as they come; empty tables give no rows; other columns are not read. N-grams are told apart
by 64-bit hashes until the last pass, which counts by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm import tokens
from tidegrid.llm.common import release, stage

LONGEST = 5
BITS = 26  # of a position in a gate
SUMMARY = 1 << 20  # counters that a hash partition may hold
FLUSH = 1 << 23  # n-grams that a task sums up at once
TEXT_FLUSH = 1 << 24  # bytes of text whose survivors are counted at once
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_GAPS = _BREAK.copy()
_GAPS[[9, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = np.uint64(0xD6E8FEB86659FD93)

Batches = Iterator[pa.RecordBatch]


# Words and n-grams of a batch


class Run(NamedTuple):
    """The words of some texts: their hashes, whether the next word follows in the same piece, and where they are."""

    words: np.ndarray
    follows: np.ndarray  # one shorter than words
    row: np.ndarray
    starts: np.ndarray  # in raw
    ends: np.ndarray
    raw: np.ndarray


def language_keys(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    keys = [int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest()) for v in coded.dictionary.to_pylist()]
    return np.array(keys, dtype=np.uint64)[coded.indices.to_numpy()] if keys else np.empty(0, dtype=np.uint64)


def runs(batch: pa.RecordBatch) -> Iterator[Run]:
    texts = batch.column("text").cast(pa.large_string())
    if not len(texts):
        return
    keys = language_keys(batch.column("lang"))
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    for p in tokens.pieces(texts, _GAPS):
        if not len(p.words):
            continue
        row = p.first + np.repeat(np.arange(p.rows), np.diff(p.bounds))
        base = offsets[p.first]
        raw = data[base: offsets[p.first + p.rows]]
        starts, ends = p.starts + offsets[row] - base, p.ends + offsets[row] - base
        breaks = np.concatenate([[0], np.cumsum(_BREAK[raw])])
        follows = (row[1:] == row[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
        yield Run(tokens.scramble(p.words ^ keys[row]), follows, row, starts, ends, raw)


def longer(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams that are one word longer than those of ``h``."""
    n = len(words) - len(h) + 1
    return tokens.scramble(h[: len(words) - n] * _STEP + words[n:]) if len(words) > n else np.empty(0, dtype=np.uint64)


def both(flags: np.ndarray) -> np.ndarray:
    return flags[:-1] & flags[1:]


class Gate:
    """A bitmap over the first bits of hashes: false only for hashes that were not put in."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - BITS)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


Picker = Callable[[Run], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def candidates(gates: list, deep: bool) -> Picker:
    """(size, hashes, flags) by size of the n-grams of a run that the gates let through.

    No gate: all words. One: pairs of frequent words. Two: longer runs of frequent pairs, or with ``deep`` and
    a third gate all sizes that it lets through.
    """
    def pick(r: Run) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if not gates:
            yield 1, r.words, np.ones(len(r.words), dtype=bool)
            return
        known = [Gate(g.value) for g in gates]
        flags = known[0](r.words)
        if deep:
            yield 1, r.words, flags & known[2](r.words)
        h, flags = longer(r.words, r.words), r.follows & both(flags)
        if len(gates) == 1:
            yield 2, h, flags
            return
        flags[flags] = known[1](h[flags])
        if deep:
            passed = flags.copy()
            passed[flags] = known[2](h[flags])
            yield 2, h, passed
        for size in range(3, LONGEST + 1):
            if len(flags) < 2:
                return
            h, flags = longer(h, r.words), both(flags)
            if deep:
                flags[flags] = known[2](h[flags])
            yield size, h, flags

    return pick


# Misra-Gries summaries


def summed(h: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and the sums of their counts."""
    if counts is None:
        return np.unique(h, return_counts=True)
    order = np.argsort(h, kind="stable")
    h, counts = h[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, dtype=np.int64)
    return h[first], np.add.reduceat(counts, first) if len(h) else counts


class Summary:
    """Counters of which at most ``capacity`` are kept: true counts lie between a counter and that plus ``off``."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.off = capacity, 0
        self.keys, self.counts = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, off: int = 0) -> None:
        keys, counts = summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        self.off += off
        if len(keys) > self.capacity:
            at = len(keys) - self.capacity - 1
            cut = int(np.partition(counts, at)[at])
            counts = counts - cut
            self.off += cut
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts


def _own_sums(pick: Picker) -> Callable[[Batches], Batches]:
    def flush(held: list[np.ndarray]) -> Batches:
        h, c = summed(np.concatenate(held))
        for at in range(0, len(h), 1 << 19):
            part = slice(at, at + (1 << 19))
            yield pa.RecordBatch.from_pydict({"h": pa.array(h[part].view(np.int64)), "c": pa.array(c[part])})

    def own(batches: Batches) -> Batches:
        held, n = [], 0
        for batch in batches:
            for r in runs(batch):
                for _, h, flags in pick(r):
                    held.append(h[flags])
                    n += len(held[-1])
                if n >= FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return own


def _merged(capacity: int, least: int) -> Callable[[Batches], Batches]:
    def merge(batches: Batches) -> Batches:
        s, keys, counts, n = Summary(capacity), [], [], 0
        for b in batches:
            keys.append(b.column("h").to_numpy().view(np.uint64))
            counts.append(b.column("c").to_numpy())
            n += len(b)
            if n >= max(capacity, 1 << 18):
                s.merge(np.concatenate(keys), np.concatenate(counts))
                keys, counts, n = [], [], 0
        if n:
            s.merge(np.concatenate(keys), np.concatenate(counts))
        may = s.counts + s.off >= least
        yield pa.RecordBatch.from_pydict({"h": pa.array(s.keys[may].view(np.int64)), "off": pa.array(np.full(may.sum(), s.off, dtype=np.int64))})
        if s.off >= least:  # too uneven for the guarantee
            yield pa.RecordBatch.from_pydict({"h": pa.nulls(1, pa.int64()), "off": pa.array([s.off])})

    return merge


def hash_partitions(docs: DataFrame, counters: int, room: int) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counters // room))


def survivors(docs: DataFrame, pick: Picker, mass: int, least: int, room: int = SUMMARY) -> DataFrame:
    """Staged hashes of all n-grams that may be found ``least`` times or more; ``mass`` bounds how many there are.

    ``room`` counters are the most that a hash partition may hold.
    """
    needed = mass // least + 1
    parts = hash_partitions(docs, 2 * needed, room)
    while True:
        sums = docs.mapInArrow(_own_sums(pick), "h bigint, c bigint").repartition(parts, "h")
        out = stage(sums.mapInArrow(_merged(2 * needed // parts + 1, least), "h bigint, off bigint"), "frequent")
        if out.where(F.col("h").isNull()).isEmpty():
            return out
        release(out)
        parts *= 2


def gate(hashes: DataFrame):
    """Broadcast bitmap of the first bits of the hashes: at most ``2**BITS / 8`` bytes come to the driver."""
    at = F.shiftrightunsigned("h", 64 - BITS)
    rows = hashes.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit((1 << 15) - 1).cast("long"))).alias("bits"))
    bits = np.zeros((1 << BITS) // 8, dtype=np.uint8)
    for r in rows.collect():
        bits[r["part"] << 12: (r["part"] + 1) << 12] = np.frombuffer(r["bits"], dtype=np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(bits)


# Exact counts

_FOUND = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
_DEALT = "part int, lang array<string>, size array<int>, phrase array<string>, f array<bigint>"


def _phrases(held: list[tuple[Run, int, np.ndarray, np.ndarray]], langs: pa.Array) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """(hashes, phrases with their counts) of what was held of each size."""
    for size in range(1, LONGEST + 1):
        found = [x for x in held if x[1] == size and len(x[2])]
        if not found:
            continue
        h, first, c = np.unique(np.concatenate([x[3] for x in found]), return_index=True, return_counts=True)
        ends = np.cumsum([len(x[2]) for x in found])
        which = np.searchsorted(ends, first, side="right")
        texts, rows = [], []
        for k, i in zip(which.tolist(), (first - np.concatenate([[0], ends])[which]).tolist()):
            r, _, places, _ = found[k]
            at = int(places[i])
            words = zip(r.starts[at: at + size].tolist(), r.ends[at: at + size].tolist())
            texts.append(b" ".join([r.raw[a:b].tobytes() for a, b in words]).translate(_LOWER).decode())
            rows.append(int(r.row[at]))
        yield h, pa.table([langs.take(pa.array(rows)), pa.array([size] * len(h), pa.int32()), pa.array(texts, pa.string()), pa.array(c)], schema=_FOUND)


def _dealt(h: np.ndarray, found: pa.Table, parts: int) -> Batches:
    """One row for each part, which holds the phrases whose hashes fall to it as arrays."""
    part = (h % np.uint64(parts)).astype(np.int32)
    found = found.take(pa.array(np.argsort(part, kind="stable"))).combine_chunks()
    has, sizes = np.unique(part, return_counts=True)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c) for c in found.columns]
    yield pa.RecordBatch.from_arrays([pa.array(has), *lists], names=["part", *found.schema.names])


def _counted(pick: Picker, parts: int) -> Callable[[Batches], Batches]:
    def count(batches: Batches) -> Batches:
        for batch in batches:
            langs, words = batch.column("lang"), np.zeros(len(batch), dtype=np.int64)
            held, n = [], 0
            for r in runs(batch):
                words += np.bincount(r.row, minlength=len(words))
                for size, h, flags in pick(r):
                    places = np.flatnonzero(flags)
                    held.append((r, size, places, h[places]))
                n += len(r.raw)
                if n >= TEXT_FLUSH:
                    for h, found in _phrases(held, langs):
                        yield from _dealt(h, found, parts)
                    held, n = [], 0
            for h, found in _phrases(held, langs):
                yield from _dealt(h, found, parts)
            if len(batch):
                total = pa.table({"lang": langs, "f": words}).group_by("lang").aggregate([("f", "sum")])
                k = len(total)
                found = pa.table([total["lang"], pa.array([0] * k, pa.int32()), pa.array([""] * k), total["f_sum"]], schema=_FOUND)
                yield from _dealt(language_keys(found["lang"].combine_chunks()), found, parts)

    return count


def _added_up(least: int) -> Callable[[Batches], Batches]:
    def add(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(["lang", "size", "phrase"]).aggregate([("f", "sum")]).rename_columns(_FOUND.names)

    def add_up(batches: Batches) -> Batches:
        held, n = [], 0
        for b in batches:
            held.append(pa.table([b.column(c).flatten() for c in _FOUND.names], schema=_FOUND))
            n += len(held[-1])
            if n > 2 * max(len(held[0]), FLUSH >> 4):
                held, n = [add(held)], 0
        if held:
            found = add(held)
            yield from found.filter(pc.or_(pc.greater_equal(found["f"], least), pc.equal(found["size"], 0))).to_batches()

    return add_up


def frequent(df: DataFrame, least: int = 100, text: str = "text", lang: str = "lang", room: int = SUMMARY) -> DataFrame:
    """Staged exact counts: lang, size, phrase, f of all phrases of 1 to 5 words found ``least`` times or more.

    Rows of size 0 hold the number of word occurrences of each language.
    """
    docs = df.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    mass = docs.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    mass = mass // 2 + 1  # every word is followed by another byte or the end
    words = survivors(docs, candidates([], False), mass, least, room)
    gates = [gate(words)]
    pairs = survivors(docs, candidates(gates, False), mass, least, room)
    gates.append(gate(pairs))
    runs_ = survivors(docs, candidates(gates, False), (LONGEST - 2) * mass, least, room)
    gates.append(gate(words.unionAll(pairs).unionAll(runs_)))
    parts = hash_partitions(docs, 2 * LONGEST * (mass // least + 1), room)
    counts = docs.mapInArrow(_counted(candidates(gates, True), parts), _DEALT).repartition(parts, "part")
    out = stage(counts.mapInArrow(_added_up(least), "lang string, size int, phrase string, f bigint"), "phrase-counts")
    for used in (words, pairs, runs_):
        release(used)
    for g in gates:
        g.unpersist()
    return out


# Scores


def _part(words: str, first: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def collocations(counts: DataFrame, top: int = 2000) -> DataFrame:
    """Each language's ``top`` best phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase scores as its worst cut does, floor(1000 * a * n / (l * r)) in exact decimals. Phrases that lie in
    a longer one which is as frequent are left out.
    """
    total = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    known = counts.where("size > 0")
    phrases = known.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    k = F.col("k")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _part("words", 1, k).alias("left"), _part("words", k + 1, F.col("size") - k).alias("right"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = (
        cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        .join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        .join(total, "lang")
        .withColumns({"over": big("a") * F.lit(1000).cast("decimal(4,0)") * big("n"), "under": big("l") * big("r")})
        .withColumn("score", F.expr("over div under")))
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = phrases.where("size > 2").select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inside = inside.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at")).select(
        "lang", "a", _part("words", F.col("at"), F.col("m")).alias("phrase"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = best.join(covered, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * 100)).select(
        "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
