"""Approximate nearest neighbours from shifted Hilbert curves.

Each of several curves has its own random projection to a few dimensions and its own random shift of the
grid; the Hilbert key of the projected vector orders all rows. A crowded grid cell is ordered by a finer grid of
its own. Every ordering is range-partitioned into blocks of equal shares of a sample. A query visits its own block and the neighbouring ones of each ordering, the
candidates of all orderings are merged, and their exact distances rank them.

The work is queries x curves x window; ``window`` is the share of all keys that a query sees in one
ordering. Vectors without any structure (directions drawn at random) need wide windows for high recall.

Equal vectors are neighbours at distance 0 of whatever else is near: of each vector only its k + 1 smallest
ids can ever be among k nearest, so no others become candidates, and a very common vector is not a hot key.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor
do rows without an id or with another length than most; repeated rows count once; with fewer candidates than
k all are returned; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import stage, uniform
from tidegrid.llm.tokens import scramble

CURVES = 16
AXES = 8  # dimensions of a projection
BITS = 4  # grid steps per axis, as a power of two
BLOCKS = 64  # of an ordering; more where blocks would be too large, fewer for small tables
BLOCK_ROWS = 50_000  # of a block, at most by expectation
WINDOW = 0.08
SAMPLE = 10_000  # vectors that fix grids and block borders, as expected number
CROWDED = 0.25  # of a block in one grid cell: the cell gets a grid of its own
CROWDED_ROWS = 16  # sample rows that such a cell has at least
DEPTH = 16  # grids inside each other at most; each spans one cell of the one around it
_SLACK = 8  # kept besides k until exact distances are known


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert key of each row of grid coordinates (transposed Gray code, axes interleaved)."""
    x = cells.T.astype(np.int64).copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(axes):
            flip = (x[i] & q) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class _Cells:
    """Place of projected vectors among the sample rows of one curve, or of one crowded cell of it.

    A cell that holds more than ``most`` sample rows has a grid of its own over just the range of these rows,
    and so on, so a dense group is ordered by where its vectors lie however small it is.
    """

    def __init__(self, flat: np.ndarray, shift: np.ndarray, bits: int, most: float, depth: int = DEPTH):
        self.shift, self.bits = shift, bits
        self.low = flat.min(0)
        span = flat.max(0) - self.low
        self.span = np.where(span > 0, span, 1.0)
        key = self._keys(flat)
        self.keys, counts = np.unique(key, return_counts=True)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.inner = {}
        for j in np.flatnonzero(counts > most) if depth else ():
            rows = flat[key == self.keys[j]]
            if (rows != rows[0]).any():
                self.inner[int(j)] = _Cells(rows, shift, bits, most, depth - 1)

    def _keys(self, flat: np.ndarray) -> np.ndarray:
        top = 1 << self.bits
        unit = (flat - self.low) / self.span
        return hilbert(np.clip((unit * 0.5 + self.shift) * top, 0, top - 1).astype(np.int64), self.bits)

    def place(self, flat: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """Number of sample rows before each vector; ``tie`` in 0..1 orders the vectors of a cell."""
        key = self._keys(flat)
        at = np.searchsorted(self.keys, key)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == key
        out = self.before[at] + np.where(known, tie * (self.before[np.minimum(at + 1, len(self.keys))] - self.before[at]), 0.0)
        crowded = known & np.isin(at, list(self.inner))
        for j in np.unique(at[crowded]).tolist():
            mine = np.flatnonzero(crowded & (at == j))
            out[mine] = self.before[j] + self.inner[j].place(flat[mine], tie[mine])
        return out


class Curves:
    """Projections, grids and splitters, fixed by a seed and a sample."""

    def __init__(self, sample: np.ndarray, blocks: int, curves: int = CURVES, axes: int = AXES,
                 bits: int = BITS, seed: int = 23):
        rng = np.random.default_rng(seed)
        self.blocks, self.rows = blocks, len(sample)
        dim = sample.shape[1]
        axes = min(axes, dim)
        self.mark = rng.normal(size=dim)
        self.project = [np.linalg.qr(rng.normal(size=(dim, axes)))[0] for _ in range(curves)]
        shift = [rng.random(axes) * 0.5 for _ in range(curves)]
        most = max(self.rows / blocks * CROWDED, CROWDED_ROWS)
        self.cells = [_Cells(sample @ p, s, bits, most) for p, s in zip(self.project, shift)]

    def block(self, c: int, vectors: np.ndarray) -> np.ndarray:
        """By place on the curve, then by a hash of vector and curve: every cell is divisible, equal vectors stay together."""
        mark = (vectors * self.mark).sum(1).view(np.uint64)
        tie = (scramble(scramble(mark) + np.uint64(c)) >> np.uint64(11)) / float(2**53)
        place = self.cells[c].place(vectors @ self.project[c], tie)
        return np.minimum(place * (self.blocks / self.rows), self.blocks - 1).astype(np.int64)


def _matrix(column: pa.Array, dim: int, unit: float) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) / unit


def _place(curves: Curves, dim: int, reach: int, unit: float):
    """Rows (curve, block, candidate, id, v): a candidate in its block, a query in all blocks of its window."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                v = _matrix(b["v"], dim, unit)
                asked = b["query"].to_numpy(zero_copy_only=False).astype(bool)
                offered = b["candidate"].to_numpy(zero_copy_only=False).astype(bool)
                for c in range(len(curves.project)):
                    block = curves.block(c, v)
                    take, where = [np.flatnonzero(offered)], [block[offered]]
                    for d in range(-reach, reach + 1):
                        near = block + d
                        ok = asked & (near >= 0) & (near < curves.blocks)
                        take.append(np.flatnonzero(ok))
                        where.append(near[ok])
                    kind = np.repeat([1] + [0] * (2 * reach + 1), [len(t) for t in take])
                    rows = np.concatenate(take)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), c), pa.int32()), pa.array(np.concatenate(where), pa.int32()),
                         pa.array(kind, pa.int32()), b["id"].take(pa.array(rows)), b["v"].take(pa.array(rows))],
                        names=["curve", "block", "kind", "id", "v"])

    return task


class _Best:
    """The nearest candidates so far of each query of a block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, queries, k
        self.middle = queries.mean(0)  # norms and products lose no digits to a common offset
        self.near_q = queries - self.middle
        self.norm = (self.near_q**2).sum(1)
        self.error = np.zeros(len(ids))
        self.near = np.full((len(ids), k + _SLACK), np.inf)
        self.who = np.full((len(ids), k + _SLACK), -1, dtype=np.int64)
        self.vec = np.zeros((len(ids), k + _SLACK, queries.shape[1]))

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        keep = self.near.shape[1]
        near_v = v - self.middle
        size = (near_v**2).sum(1)
        rounding = 4 * (v.shape[1] + 4) * np.finfo(np.float64).eps
        for lo in range(0, len(self.ids), 256):
            hi = min(lo + 256, len(self.ids))
            d = self.norm[lo:hi, None] + size[None] - 2 * self.near_q[lo:hi] @ near_v.T
            own = self.ids[lo:hi, None] == ids[None]
            d[own] = np.inf
            both = np.concatenate([self.near[lo:hi], d], axis=1)
            pick = np.argpartition(both, keep - 1, axis=1)[:, :keep]
            row = np.arange(hi - lo)[:, None]
            # Where rounding could decide who is kept, the plain sum of squared differences does.
            self.error[lo:hi] = np.maximum(self.error[lo:hi], rounding * (self.norm[lo:hi] + size.max(initial=0)))
            kept = np.sort(both[row, pick], axis=1)
            gap = np.where(np.isfinite(kept[:, -1]), kept[:, -1], np.inf) - kept[:, self.k - 1]
            unsure = np.isfinite(kept[:, -1]) & (gap <= 2 * self.error[lo:hi]) & (both.shape[1] > keep)
            for i in np.flatnonzero(unsure).tolist():
                plain = ((v - self.q[lo + i]) ** 2).sum(1)
                plain[own[i]] = np.inf
                old_ones = ((self.vec[lo + i] - self.q[lo + i]) ** 2).sum(1)
                old_ones[self.who[lo + i] < 0] = np.inf
                both[i] = np.concatenate([old_ones, plain])
                who = np.concatenate([self.who[lo + i], ids])
                pick[i] = np.lexsort((who, both[i]))[:keep]
            old = pick < keep
            new = np.where(old, 0, pick - keep)
            at = np.where(old, pick, 0)
            self.vec[lo:hi] = np.where(old[..., None], self.vec[lo:hi][row, at], v[new])
            self.who[lo:hi] = np.where(old, self.who[lo:hi][row, at], ids[new])
            self.near[lo:hi] = both[row, pick]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        exact = np.sqrt(((self.vec - self.q[:, None]) ** 2).sum(-1))
        exact[~np.isfinite(self.near)] = np.inf  # empty places
        order = np.lexsort((self.who, exact), axis=-1)[:, : self.k]
        row = np.arange(len(self.ids))[:, None]
        ok = np.isfinite(exact[row, order])
        return (np.repeat(self.ids, self.k).reshape(-1, self.k)[:, : order.shape[1]][ok], self.who[row, order][ok], exact[row, order][ok])


def _search(dim: int, k: int, unit: float):
    """Nearest candidates of each query inside sorted (curve, block) runs; queries come first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, best = None, [], None

        def drain() -> Iterator[pa.RecordBatch]:
            if best is not None:
                asker, found, score = best.result()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asker, pa.int64()), pa.array(found, pa.int64()), pa.array(score * unit, pa.float64())],
                    names=["query_id", "vec_id", "score"])

        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                b = whole.slice(start, 4096)
                run = b["curve"].to_numpy().astype(np.int64) << 40 | b["block"].to_numpy().astype(np.int64) << 1 | b["kind"].to_numpy()
                ids, v = b["id"].to_numpy(), _matrix(b["v"], dim, unit)
                edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
                for a, z in zip(edges, edges[1:]):
                    if now != run[a] >> 1:
                        yield from drain()
                        now, asked, best = run[a] >> 1, [], None
                    if not run[a] & 1:
                        asked.append((ids[a:z], v[a:z]))
                    elif asked:
                        if best is None:
                            best = _Best(np.concatenate([x[0] for x in asked]), np.concatenate([x[1] for x in asked]), k)
                        best.add(ids[a:z], v[a:z])
        yield from drain()

    return task


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where((F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (common["d"] if common else 0))


def nearest(df: DataFrame, is_query: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding", window: float = WINDOW,
            **how) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of the rows for which ``is_query`` (over ``id``) holds."""
    rows = usable(df, id, vector)
    first = Window.partitionBy("v").orderBy("id")
    marked = rows.withColumn("query", is_query).withColumn("nth", F.dense_rank().over(first))
    offered = marked.where(F.col("nth") <= k + 1).select("id", "v", F.lit(False).alias("query"), F.lit(True).alias("candidate"))
    asked = rows.where(is_query).select("id", "v", F.lit(True).alias("query"), F.lit(False).alias("candidate")).dropDuplicates(["id"])
    out = "query_id long, vec_id long, score double"
    both = stage(offered.unionByName(asked), "neighbour-rows")
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x).cast("double"))))
    n, top = both.where("candidate").agg(F.count("*"), largest).first()
    # Squares of huge components overflow: a power of two, which rounds nothing, makes them smaller.
    unit = 2.0 ** (int(np.frexp(top)[1]) - 480) if n and top > 2.0**480 else 1.0
    sample = both.where("candidate").where(uniform("id", seed=29) < SAMPLE / max(n, 1)).select("v").toPandas()
    if not len(sample):
        found = df.sparkSession.createDataFrame([], out)
    else:
        vectors = np.array(sample["v"].tolist(), dtype=np.float64) / unit
        # A block holds several times k rows, so few rows are all in one block.
        blocks = int(max(1, min(BLOCKS, n // (4 * k)), np.ceil(n / BLOCK_ROWS)))
        curves = Curves(vectors, blocks, **how)
        reach = max(1, round((window * blocks - 1) / 2))
        dim = vectors.shape[1]
        kind = dict(rows.dtypes)["v"]
        placed = both.mapInArrow(_place(curves, dim, reach, unit), f"curve int, block int, kind int, id long, v {kind}")
        found = placed.repartition("curve", "block").sortWithinPartitions("curve", "block", "kind").mapInArrow(_search(dim, k, unit), out)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
