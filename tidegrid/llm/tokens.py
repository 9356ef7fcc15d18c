"""Words and word shingles of Arrow text columns, hashed with numpy.

A word is a run of bytes other than the six ASCII spaces; ``A`` to ``Z`` are lower-cased. Texts are worked
through in pieces of about a megabyte (a longer text is a piece of its own), so memory follows the longest
text and not the batch. All hashes are 64 bits and depend on the words alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

K = 5  # words in a shingle
_PIECE = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_LETTER = np.ones(256, dtype=bool)  # gaps when words are runs of letters; every byte above ASCII is a letter's
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = scramble(np.arange(1, 257, dtype=_U))[_LOWER]
_STEP = scramble(np.arange(1001, 1001 + K, dtype=_U)) | _U(1)
_SHORT = scramble(np.arange(2001, 2001 + K, dtype=_U))


class _Powers:
    """Powers of the base and of its inverse, kept as far as they were needed."""

    up = np.ones(1, dtype=_U)
    down = np.ones(1, dtype=_U)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, _PIECE + (1 << 16))
            inverse = pow(_BASE, -1, 1 << 64)
            cls.up = np.concatenate([[_U(1)], np.full(size - 1, _BASE, dtype=_U)]).cumprod(dtype=_U)
            cls.down = np.concatenate([[_U(1)], np.full(size - 1, inverse, dtype=_U)]).cumprod(dtype=_U)
        return cls.up, cls.down


class Piece(NamedTuple):
    first: int  # row of the batch at which the piece starts
    rows: int
    words: np.ndarray  # hash of each word
    bounds: np.ndarray  # words of row i of the piece: bounds[i]:bounds[i + 1]
    starts: np.ndarray  # byte position of each word in its own text
    ends: np.ndarray


def pieces(column: pa.Array | pa.ChunkedArray, gaps: np.ndarray = _SPACE) -> Iterator[Piece]:
    """The words of each row (runs without ``gaps``), piece by piece; null has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.empty(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PIECE, side="right")) - 1)
        to = min(to, n)
        yield _piece(at, data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at], gaps)
        at = to


def _piece(first: int, raw: np.ndarray, offsets: np.ndarray, gaps: np.ndarray) -> Piece:
    rows, n = len(offsets) - 1, len(raw)
    if not n:
        none = np.empty(0, dtype=np.int64)
        return Piece(first, rows, np.empty(0, dtype=_U), np.zeros(rows + 1, dtype=np.int64), none, none)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    gap = gaps[raw]
    start = ~gap & edge[:n]
    start[1:] |= ~gap[1:] & gap[:-1]
    end = ~gap & edge[1:]
    end[:-1] |= ~gap[:-1] & gap[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _Powers.upto(n + 1)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(_BYTE[raw] * up[:n], dtype=_U, out=sums[1:])
    words = scramble((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
    bounds = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    return Piece(first, rows, words, bounds, starts - offsets[row], ends - offsets[row])


def shingles(p: Piece, whole_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of five words, and the bounds of each row's runs.

    A row with one to four words has its whole sequence as its one run (if ``whole_short``).
    """
    counts = np.diff(p.bounds)
    runs = np.maximum(counts - K + 1, 0)
    if whole_short:
        runs[(counts > 0) & (counts < K)] = 1
    bounds = np.concatenate([[0], np.cumsum(runs)])
    if len(p.words) >= K:
        rolled = p.words[: len(p.words) - K + 1] * _STEP[0]
        for j in range(1, K):
            rolled += p.words[j: len(p.words) - K + 1 + j] * _STEP[j]
        rolled = scramble(rolled)
    else:
        rolled = np.empty(0, dtype=_U)
    row = np.repeat(np.arange(p.rows), runs)
    at = np.arange(bounds[-1]) - bounds[row] + p.bounds[row]
    out = np.empty(bounds[-1], dtype=_U)
    long = counts[row] >= K
    out[long] = rolled[at[long]]
    for i in np.flatnonzero(~long):
        w = p.words[p.bounds[row[i]]: p.bounds[row[i] + 1]]
        out[i] = scramble((w * _STEP[: len(w)]).sum(dtype=_U, keepdims=True) + _SHORT[len(w)])[0]
    return out, bounds


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row."""
    h = hashes.copy()
    for a, b in zip(bounds[:-1], bounds[1:]):
        h[a:b].sort()
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = h[1:] != h[:-1]
    keep[bounds[:-1][bounds[:-1] < len(h)]] = True
    seen = np.concatenate([[0], np.cumsum(keep)])
    return h[keep], seen[bounds]
