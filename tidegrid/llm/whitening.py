"""Whitening of embeddings: principal components by contour integration (FEAST), verified by inertia counts.

Spark reads the vectors four times: counts and sums, the centred second moments, the covariance of the whitened
vectors, and the result. Between them only numbers that follow the dimension travel (at most ``d * (d + 1) / 2``
sums per task, added up in a shuffle). The covariance matrix is cut into intervals of the real line that hold a
few eigenvalues each, counted by Sylvester's law of inertia. Every interval is a task of its own: it solves
shifted complex systems at the nodes of a circle around the interval, whose weighted sum projects random vectors
onto the eigenvectors inside, and extracts them by Rayleigh-Ritz until as many have converged as the inertia
says there are.

Defined results: rows whose vector is null or empty, or holds null or non-finite entries, are left out, and so
are rows whose length is not the most common one (of equally common lengths the larger counts). A component is a
direction in which the vectors differ: with fewer such directions than asked for, in double precision (variance
above 1e-10 of the largest), there are fewer components, and none if all vectors are equal. Repeated rows count
as often as they come and give as many results. Entries beyond 2**56 count as 2**56. A deviation beyond 64 bits
is null. A null id stays null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
LARGEST = float(2**56)
NODES = 8  # of the quadrature, on the upper half of a circle
IN_A_SLICE = 8  # eigenvalues wanted in an interval, more only where they can't be told apart
RANK_TOL = 1e-10
_LOW = (1 << 31) - 1

Batches = Iterator[pa.RecordBatch]


# Vectors of a batch


def whole_vectors(column: pa.Array, d: int | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Length of each row's vector (0: unusable), and by length the x-vectors (int64) in row order."""
    column = column.cast(pa.list_(pa.float64()))
    flat = column.flatten().to_numpy(zero_copy_only=False)  # null entries become NaN
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ends = np.cumsum(sizes)
    sizes = np.where(bad[ends] > bad[ends - sizes], 0, sizes)
    if d is not None:
        sizes = np.where(sizes == d, sizes, 0)
    out = {}
    for k in np.unique(sizes[sizes > 0]):
        at = (ends - k)[sizes == k]
        values = flat[at[:, None] + np.arange(k)]
        out[int(k)] = np.floor(SCALE * np.clip(values, -LARGEST, LARGEST)).astype(np.int64) + OFFSET
    return sizes, out


class Fit(NamedTuple):
    """Number of vectors and the exact sum of each dimension."""

    n: int
    sums: list[int]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n``: the whole part is taken off in integers, so nothing is lost far from the origin."""
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum of ``(n * x - S) ** 2`` over the dimensions, exact."""
        apart = x - self.whole
        most = self.n * (int(np.abs(apart).max(initial=0)) + 1)
        if len(self.sums) * most**2 < 2**63:
            return pa.array(((self.n * apart - self.rest) ** 2).sum(axis=1))
        exact = ((self.n * apart.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)
        return pa.array([int(v) if v < 2**63 else None for v in exact], type=pa.int64())


# Passes over the vectors


def _totals(batches: Batches) -> Batches:
    held: dict[int, tuple[int, list[int]]] = {}
    for b in batches:
        for d, x in whole_vectors(b.column("vector"))[1].items():
            n, sums = held.get(d, (0, [0] * d))
            parts = zip((x >> 31).sum(axis=0).tolist(), (x & _LOW).sum(axis=0).tolist())
            held[d] = n + len(x), [s + (high << 31) + low for s, (high, low) in zip(sums, parts)]
    for d, (n, sums) in held.items():
        yield pa.RecordBatch.from_pydict({
            "size": pa.array([d] * d, pa.int32()), "dim": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()),
            "total": pa.array([str(s) for s in sums]).cast(pa.decimal128(38, 0))})


def fit(vectors: DataFrame) -> Fit | None:
    """Count and sums of the vectors of the most common length; None without any."""
    sums = vectors.mapInArrow(_totals, "size int, dim int, n bigint, total decimal(38,0)").groupBy("size", "dim").agg(
        F.sum("n").alias("n"), F.sum("total").cast("string").alias("total"))
    best = (
        sums.groupBy("size").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "total"))).alias("totals"))
        .orderBy(F.desc("n"), F.desc("size")).limit(1).collect())
    return Fit(best[0]["n"], [int(t["total"]) for t in best[0]["totals"]]) if best else None


def _added(vectors: DataFrame, f: Fit, values: Callable[[np.ndarray], np.ndarray], k: int) -> np.ndarray:
    """Sum over all vectors of ``v v'`` for ``v = values(x)`` of length k, added up by Spark cell by cell."""
    upper = np.triu_indices(k)

    def moments(batches: Batches) -> Batches:
        held = np.zeros((k, k))
        for b in batches:
            for x in whole_vectors(b.column("vector"), len(f.sums))[1].values():
                v = values(x)
                held += v.T @ v
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(len(upper[0]), dtype=np.int32)), "value": pa.array(held[upper])})

    cells = vectors.mapInArrow(moments, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros((k, k))
    at = cells["cell"].to_numpy()
    out[upper[0][at], upper[1][at]] = out[upper[1][at], upper[0][at]] = cells["value"].to_numpy()
    return out


# Eigenvectors of a symmetric matrix


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix similar to ``v`` (Householder)."""
    a = v.copy()
    for j in range(len(a) - 2):
        u = a[j + 1:, j].copy()
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        size = np.linalg.norm(u)
        if size:
            u /= size
            block = a[j + 1:, j + 1:]
            p = block @ u
            w = 2 * (p - (u @ p) * u)
            block -= np.outer(u, w) + np.outer(w, u)
            a[j + 1:, j] -= 2 * u * (u @ a[j + 1:, j])
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy()


class Inertia:
    """How many eigenvalues lie above a shift: the positive pivots of the shifted matrix."""

    def __init__(self, v: np.ndarray) -> None:
        self.diagonal, off = tridiagonal(v)
        self.squares = np.concatenate([[0.0], off**2])
        reach = np.abs(off)
        radius = np.concatenate([reach, [0]]) + np.concatenate([[0], reach])
        self.low, self.high = float((self.diagonal - radius).min()), float((self.diagonal + radius).max())
        self.norm = max(abs(self.low), abs(self.high))

    def above(self, shifts: np.ndarray) -> np.ndarray:
        tiny = max(self.norm, 1e-300) * 1e-18
        pivot, count = np.ones(len(shifts)), np.zeros(len(shifts), dtype=np.int64)
        for a, b in zip(self.diagonal, self.squares):
            pivot = a - shifts - b / pivot
            pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
            count += pivot > 0
        return count

    def slices(self, want: int) -> list[tuple[float, float, int]]:
        """Intervals (from, to, eigenvalues inside) that hold at least the ``want`` largest eigenvalues.

        Cuts go through the widest gap that a grid of shifts shows, so clusters stay together.
        """
        margin = self.norm * 1e-12 + 1e-300
        todo, out = [(self.low - margin, self.high + margin, 0)], []
        while todo:
            a, b, higher = todo.pop()
            grid = np.linspace(a, b, 65)
            counts = self.above(grid)
            inside = int(counts[0] - counts[-1])
            if not inside or higher >= want:
                continue
            cut = self._gap(counts)
            if inside <= IN_A_SLICE or cut is None and b - a <= self.norm * 1e-9:
                out.append((a, b, inside))
                continue
            at = float(grid[32] if cut is None else (grid[cut[0]] + grid[cut[1]]) / 2)
            todo += [(a, at, higher + int(self.above(np.array([at]))[0] - counts[-1])), (at, b, higher)]
        return out

    @staticmethod
    def _gap(counts: np.ndarray) -> tuple[int, int] | None:
        """First and last grid point of the widest stretch without eigenvalues that has some on both sides."""
        best, start = None, 0
        for i in range(1, len(counts)):
            if counts[i] != counts[start]:
                start = i
            elif counts[0] > counts[i] > counts[-1] and (best is None or i - start > best[1] - best[0]):
                best = start, i
        return best


def feast(v: np.ndarray, a: float, b: float, inside: int, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``inside`` eigenvalues of ``v`` in (a, b) and their unit vectors, as columns."""
    d, centre, radius = len(v), (a + b) / 2, max((b - a) / 2, norm * 1e-13)
    t, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (t + 1))
    inverse = [np.linalg.inv((centre + radius * z) * np.eye(d) - v) for z in turn]
    size = min(d, inside + max(4, inside // 2))
    while True:
        y = np.random.default_rng(size).standard_normal((d, size))
        for _ in range(20):
            q = np.linalg.qr(sum(w * (z * (r @ y)).real for w, z, r in zip(weights, turn, inverse)))[0]
            e, u = np.linalg.eigh(q.T @ v @ q)
            y = q @ u
            near = np.argsort(np.abs(e - centre))[:inside]
            wrong = np.linalg.norm(v @ y[:, near] - y[:, near] * e[near], axis=0).max()
            if wrong <= 1e-13 * norm and np.abs(e[near] - centre).max() <= radius * (1 + 1e-6) + 1e-13 * norm:
                return e[near], y[:, near]
        if size == d:
            raise ArithmeticError(f"{inside} eigenvalues between {a} and {b} did not converge: residual {wrong}")
        size = min(d, 2 * size)


class Components(NamedTuple):
    values: np.ndarray  # falling
    vectors: np.ndarray  # columns
    trace: float


def components(vectors: DataFrame, covariance: np.ndarray, most: int) -> Components:
    """The ``most`` largest components: one task for each interval, then one Rayleigh-Ritz step over all."""
    spark, inertia = vectors.sparkSession, Inertia(covariance)
    trace = float(np.trace(covariance))
    slices = inertia.slices(min(most, len(covariance))) if trace > 0 else []
    if not slices:
        return Components(np.empty(0), np.empty((len(covariance), 0)), trace)
    norm, shared = inertia.norm, spark.sparkContext.broadcast(covariance)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, b, inside in frame.itertuples(index=False):
                e, y = feast(shared.value, a, b, int(inside), norm)
                yield pd.DataFrame({"value": e, "vector": list(y.T)})

    tasks = spark.createDataFrame(slices, "a double, b double, inside bigint").repartition(len(slices))
    found = sorted(tasks.mapInPandas(solve, "value double, vector array<double>").collect(), key=lambda r: -r["value"])
    shared.unpersist()
    if len(found) != sum(s[2] for s in slices):
        raise ArithmeticError("eigenvalues are missing")
    q = np.linalg.qr(np.array([r["vector"] for r in found]).T)[0]
    e, u = np.linalg.eigh(q.T @ covariance @ q)
    e, y = e[::-1][:most], (q @ u)[:, ::-1][:, :most]
    real = e > RANK_TOL * e[0]
    return Components(e[real], y[:, real], trace)


# The operator


class Whitening(NamedTuple):
    fit: Fit
    parts: Components
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.fit.centred(x) @ (self.parts.vectors / np.sqrt(self.parts.values))


def learn(df: DataFrame, vector: str = "embedding", most: int = 32) -> Whitening | None:
    """Fit on all usable vectors; None if there are none."""
    vectors = df.select(F.col(vector).alias("vector"))
    f = fit(vectors)
    if f is None:
        return None
    parts = components(vectors, _added(vectors, f, f.centred, len(f.sums)) / f.n, most)
    out = Whitening(f, parts, 0.0)
    k = len(parts.values)
    return out._replace(identity_error=float(np.abs(_added(vectors, f, out.project, k) / f.n - np.eye(k)).max(initial=0)))


def whiten(df: DataFrame, model: Whitening | None, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each usable vector and component, numbered from 1 by falling variance."""
    kind = dict(df.dtypes)[id]
    schema = (
        f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    rows = df.select(F.col(id).alias("id"), F.col(vector).alias("vector"))
    if model is None or not len(model.parts.values):
        return df.sparkSession.createDataFrame([], schema)
    k, explained = len(model.parts.values), model.parts.values / model.parts.trace

    def project(batches: Batches) -> Batches:
        for b in batches:
            sizes, found = whole_vectors(b.column("vector"), len(model.fit.sums))
            for x in found.values():
                m = len(x)
                row = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": b.column("id").filter(pa.array(sizes > 0)).take(row),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * k, model.fit.n, dtype=np.int64)),
                    "deviation": model.fit.deviation(x).take(row),
                    "whitened": pa.array(model.project(x).ravel()), "explained": pa.array(np.tile(explained, m)),
                    "identity_error": pa.array(np.full(m * k, model.identity_error))})

    return rows.mapInArrow(project, schema)
