"""License scan: ordered signature rules behind a keyword gate, with overlapping detections resolved.

A text is read as its lower-case words. The hashed words of a batch of texts are compared at once with the
words that rules need; only texts that hold the rarest word of a rule are looked at further, and only rules
whose words are all there are run. Of the places found, one that lies within a place of a rule of the same or
a smaller rank is suppressed: a grant hides the name inside it, a versioned name the bare one. Places of the
base phrases are never suppressed.

Texts stay where they are: nothing is shuffled, and a task holds a batch of texts and its places.

Defined results: null and empty texts have no words, no labels (empty strings) and score 0; repeated rows give
one result row each; a null id stays null; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import tokens
from tidegrid.llm.license_rules import Rule, rules

SPELLINGS = {"licence": "license", "licences": "licenses"}
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAPS = np.ones(256, dtype=bool)  # every byte above ASCII belongs to a word
_GAPS[48:58] = _GAPS[65:91] = _GAPS[97:123] = _GAPS[128:] = False
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

FOUND = "array<struct<label:string,form:string,weight:double,first:bigint,last:bigint>>"


class Place(NamedTuple):
    first: int  # words from 0, both ends included
    last: int
    rule: int


def _hashes(words: list[str]) -> np.ndarray:
    return np.concatenate([p.words for p in tokens.pieces(pa.array(words), _GAPS)])


class Gate:
    """Which rules can match a text, from the hashes of its words alone."""

    def __init__(self, table: list[Rule]) -> None:
        words = sorted({w for r in table for w in r.needs})
        at = {w: i for i, w in enumerate(words)}
        spelled = words + [other for other, w in SPELLINGS.items() if w in at]
        order = np.argsort(h := _hashes(spelled))
        self.hashes, self.word = h[order], np.array([at[SPELLINGS.get(spelled[o], spelled[o])] for o in order])
        self.starts = np.zeros(len(words), dtype=bool)
        self.by_first: dict[int, list[tuple[int, frozenset[int]]]] = {}
        for k, r in enumerate(table):
            first, *rest = [at[w] for w in r.needs]
            self.starts[first] = True
            self.by_first.setdefault(first, []).append((k, frozenset(rest)))

    def open(self, p: tokens.Piece) -> Iterator[tuple[int, list[int]]]:
        """(row, rules) for the rows of a piece that some rule may match."""
        at = np.searchsorted(self.hashes, p.words)
        at[at == len(self.hashes)] = 0
        hit = np.flatnonzero(self.hashes[at] == p.words)
        row = np.searchsorted(p.bounds, hit, side="right") - 1
        pairs = np.unique(row * len(self.starts) + self.word[at[hit]])
        rows, words = np.divmod(pairs, len(self.starts))
        for i in np.unique(rows[self.starts[words]]):
            has = {int(w) for w in words[np.searchsorted(rows, i): np.searchsorted(rows, i, side="right")]}
            found = sorted(k for w in has for k, rest in self.by_first.get(w, ()) if rest <= has)
            if found:
                yield int(i), found


def suppress(places: list[Place], table: list[Rule]) -> list[Place]:
    """Without places inside one of the same or a smaller rank; of equal ones the first rule stays, and all base ones."""
    kept, ends = [], {}
    for p in sorted(places, key=lambda p: (p.first, -p.last, table[p.rule].rank, p.rule)):
        rank = table[p.rule].rank
        if rank == 0:
            kept.append(p)
        elif all(end < p.last for r, end in ends.items() if r <= rank):
            kept.append(p)
            ends[rank] = p.last
    return kept


def find(text: bytes, table: list[Rule], which: list[int]) -> list[Place]:
    """Places of the given rules in a text (UTF-8), suppressed ones left out."""
    line = b" " + b" ".join(WORD.findall(text.translate(_LOWER))) + b" "
    found = [(m.start(), m.end(), k) for k in which for m in table[k].pattern.finditer(line)]
    if not found:
        return []
    gaps = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32).tolist()
    return suppress([Place(bisect_left(gaps, a) - 1, bisect_left(gaps, b) - 1, k) for a, b, k in found], table)


@cache
def _production() -> tuple[list[Rule], Gate]:
    table = rules()
    return table, Gate(table)


def _scan(table: list[Rule] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("label", pa.string()), ("form", pa.string()), ("weight", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, gate = (table, Gate(table)) if table else _production()
        for batch in batches:
            texts = batch.column("text")
            n_words, found = np.zeros(len(texts), dtype=np.int64), [None] * len(texts)
            for p in tokens.pieces(texts, _GAPS):
                n_words[p.first: p.first + p.rows] = np.diff(p.bounds)
                for i, which in gate.open(p):
                    places = find(texts[p.first + i].as_py().encode(), use, which)
                    found[p.first + i] = [
                        {"label": (r := use[s.rule]).label, "form": r.form, "weight": r.weight, "first": s.first, "last": s.last}
                        for s in places]
            columns = [*batch.columns[:-1], pa.array(n_words), pa.array([f or [] for f in found], type=kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_words", "found"])

    return scan


def scan(df: DataFrame, id: str = "doc_id", text: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """One row per document: ``id``, ``n_words`` and ``found``, its places in order.

    A place has the label and form of its rule, how sure it is, and its first and last word (from 0).
    ``table`` replaces the production rules.
    """
    rows = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_scan(table), f"id {dict(df.dtypes)[id]}, n_words bigint, found {FOUND}")


def summary(scanned: DataFrame) -> DataFrame:
    """Counts, labels and score of each scanned document.

    The score is the chance that some place is right: one minus the product of the doubts of the distinct
    (label, form) pairs found.
    """
    base = F.filter("found", lambda p: p["form"] == "base")
    doubts = F.transform(
        F.array_distinct(F.transform("found", lambda p: F.struct(p["label"], p["form"], p["weight"].alias("weight")))),
        lambda p: F.lit(1.0) - p["weight"])

    def names(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    return scanned.select(
        F.col("id").alias("doc_id"), "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["first"])).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("found")).alias("labels"),
        (F.lit(1.0) - F.aggregate(doubts, F.lit(1.0), lambda a, x: a * x)).alias("score"))


