"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that its code point determines. A letter trigram is the
product of its letters' vectors, the first rotated twice and the second once, so order counts. A text is
the sum of its trigram vectors, a language the sum of its training texts' trigrams, and a text belongs to the
language whose prototype has the largest cosine with it. All letters of every text count; any run of other
characters is one blank.

Sums of vectors are additive, so each task bundles what it reads and only languages x dimensions numbers per
task are shuffled. Prototypes (languages x dimensions) are the only thing that is sent to all tasks.

Defined results: null text or text without letters is ``und`` with score 0; so is every text if nothing was
learned; ties go to the smaller name; a cosine below 0 gives score 0; repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import uniform

DIM = 512
SEED = 20240501
UNKNOWN = "und"
TRAIN_ROWS = 20_000  # expected number of training documents at most; a bounded sample is fitted
LEAST_ROWS = 200  # but so many of each language, or all it has
_BLANK = 32
_KEEP = 40_000  # trigram vectors a worker keeps; others are made again when met
_ALPHABET = 6_000  # letters it keeps; beyond that it starts anew


def letters_of(text: str | None) -> np.ndarray | None:
    """Lower-cased letters with single blanks between and around them; None without letters."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", errors="surrogatepass"), dtype=np.uint32)
    letter = _is_letter(code)
    if not letter.any():
        return None
    code = np.where(letter, code, _BLANK)
    code = np.concatenate([[_BLANK], code, [_BLANK]])
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != _BLANK) | (code[:-1] != _BLANK)
    return code[keep].astype(np.int64)


_letters: dict[int, np.ndarray] = {}


def _is_letter(code: np.ndarray) -> np.ndarray:
    """str.isalpha for code points, looked up in tables of 4096 that are made when first needed."""
    out = np.zeros(len(code), dtype=bool)
    page = code >> 12
    for p in np.unique(page):
        if p not in _letters:
            _letters[p] = np.array([chr(c).isalpha() for c in range(p << 12, (p + 1) << 12)])
        mine = page == p
        out[mine] = _letters[p][code[mine] & 4095]
    return out


def trigrams(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams, packed 21 bits a letter, with counts."""
    return np.unique((code[:-2] << 42) | (code[1:-1] << 21) | code[2:], return_counts=True)


class Vectors:
    """Trigram vectors, made from letter vectors on demand. A worker keeps them from task to task."""

    made: dict[tuple[int, int], Vectors] = {}

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.place: dict[int, int] = {}  # letter -> its row in the three tables
        self.turned = [np.empty((0, dim), dtype=np.float32) for _ in range(3)]  # letters rotated by 0, 1 and 2
        self.keys = np.empty(0, dtype=np.int64)  # sorted
        self.at = np.empty(0, dtype=np.int64)  # row of each key
        self.rows = np.empty((1024, dim), dtype=np.float32)

    @classmethod
    def of(cls, dim: int, seed: int) -> Vectors:
        return cls.made.setdefault((dim, seed), cls(dim, seed))

    def _letter(self, c: int) -> np.ndarray:
        return np.random.default_rng([self.seed, c]).integers(0, 2, self.dim).astype(np.float32) * 2 - 1

    def _letters(self, codes: np.ndarray, turn: int) -> np.ndarray:
        found, back = np.unique(codes, return_inverse=True)
        new = [c for c in found.tolist() if c not in self.place]
        if new and len(self.place) > _ALPHABET:
            self.place, self.turned = {}, [t[:0] for t in self.turned]
            new = found.tolist()
        if new:
            fresh = np.array([self._letter(c) for c in new])
            self.place.update((c, len(self.place)) for c in new)
            self.turned = [np.concatenate([t, np.roll(fresh, k, axis=1)]) for k, t in enumerate(self.turned)]
        return self.turned[turn][np.array([self.place[c] for c in found.tolist()])[back]]

    def _make(self, keys: np.ndarray) -> np.ndarray:
        mask = (1 << 21) - 1
        return self._letters(keys >> 42, 2) * self._letters((keys >> 21) & mask, 1) * self._letters(keys & mask, 0)

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the vectors of sorted distinct ``keys``, times their counts."""
        counts = counts.astype(np.float32)
        near = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = near < len(self.keys)
        known[inside] = self.keys[near[inside]] == keys[inside]
        out = counts[known] @ self.rows[self.at[near[known]]]
        new = keys[~known]
        for lo in range(0, len(new), 4096):  # a text may hold any number of distinct trigrams
            part = new[lo: lo + 4096]
            made = self._make(part)
            out = out + counts[~known][lo: lo + 4096] @ made
            n = len(self.keys)
            if n + len(part) <= _KEEP:
                while n + len(part) > len(self.rows):
                    self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
                self.rows[n: n + len(part)] = made
                where = np.searchsorted(self.keys, part)
                self.keys = np.insert(self.keys, where, part)
                self.at = np.insert(self.at, where, np.arange(n, n + len(part)))
        return out


def _bundle_task(dim: int, seed: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = Vectors.of(dim, seed), {}
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"]):
                code = letters_of(text.as_py())
                if code is not None:
                    sums[lang] = sums.get(lang, 0) + vectors.bundle(*trigrams(code)).astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))],
            names=["lang", "v"])

    return task


def learn(df: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", most_rows: int = TRAIN_ROWS,
          dim: int = DIM, seed: int = SEED) -> dict[str, np.ndarray]:
    """Unit prototypes of the languages in ``df`` (rows with a null language are left out).

    Of larger tables every language has the same quota, of ``most_rows`` together but ``LEAST_ROWS`` at least: all
    documents of a language up to the quota are learned from, of others about as many, chosen by a hash.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    u = uniform(id, F.xxhash64(text), seed=3)
    # One row per language, as the result has.
    sizes = rows.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("_n"), F.min(u).alias("_first")).collect()
    if sum(r["_n"] for r in sizes) > most_rows:
        quota = max(most_rows / len(sizes), LEAST_ROWS)
        shares = df.sparkSession.createDataFrame(
            [(r["_lang"], max(quota / r["_n"], r["_first"])) for r in sizes], "_lang string, _share double")
        rows = rows.join(F.broadcast(shares), F.col(lang) == F.col("_lang")).where(u <= F.col("_share"))
    parts = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(
        _bundle_task(dim, seed), "lang string, v array<double>")
    sums = (
        parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))  # dim entries per language
    )
    out = {}
    for r in sums.collect():
        v = np.array([e["x"] for e in r["v"]])
        if norm := np.linalg.norm(v):
            out[r["lang"]] = (v / norm).astype(np.float32)
    return dict(sorted(out.items()))


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", dim: int = DIM, seed: int = SEED) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row."""
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names], dtype=np.float32).reshape(len(names), dim)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors.of(dim, seed)
        for b in batches:
            best, score = [], []
            for t in b[text]:
                code = letters_of(t.as_py()) if names else None
                if code is None:
                    best.append(UNKNOWN)
                    score.append(0.0)
                    continue
                v = vectors.bundle(*trigrams(code))
                cos = matrix @ v / max(float(np.linalg.norm(v)), 1e-9)
                k = int(np.argmax(cos))
                best.append(names[k])
                score.append(float(min(1.0, max(0.0, cos[k]))))
            cols = [b[c] for c in keep] + [pa.array(best, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score"])

    rows = df.drop("lang_pred", "score")
    keep = rows.columns
    return rows.mapInArrow(task, rows.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def held_out(id: str | Column = "doc_id") -> Column:
    id = F.col(id) if isinstance(id, str) else id
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, **how) -> DataFrame:
    """Predict every row's language from the rows that are not held out; adds held_out, lang_pred, score."""
    return predict(df.withColumn("held_out", held_out()), learn(df.where(~held_out()), **how))
