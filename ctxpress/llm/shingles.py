"""Word shingles of whole texts as 64-bit hashes, computed over Arrow buffers without a Python object a word.

A byte is mapped to a random 64-bit number; a word's hash is the polynomial of its bytes modulo 2**64, read off
prefix sums and mixed; a shingle's hash mixes those of its words in order. A text with fewer than ``width`` words has
one shingle, all its words; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if not _POWERS or len(_POWERS[0]) < n + 1:
        size = max(1 << 21, n + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.concatenate([[_U(1)], np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, inverse)]
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the index of its text, in order; ``offsets`` bound the texts within the bytes ``raw``."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~_GAP[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    left = np.concatenate([[True], ~solid[:-1]]) | edge[:-1]
    right = np.concatenate([~solid[1:], [True]]) | edge[1:]
    start, stop = np.flatnonzero(solid & left), np.flatnonzero(solid & right) + 1
    power, inverse = _powers(n)
    total = np.concatenate([[_U(0)], np.cumsum(_BYTE[raw] * power[:n])])
    h = (total[stop] - total[start]) * inverse[start]
    return mix(h + (stop - start).astype(np.uint64)), np.searchsorted(offsets, start, side="right") - 1


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each shingle (with repeats) and the index of its text, which ascends."""
    h, text = words(raw, offsets)
    if not len(h):
        return h, text
    step = [_U(pow(_BASE, 2 * k + 3, 1 << 64)) for k in range(width)]
    counts = np.bincount(text, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    full = np.zeros(0, np.int64)
    if len(h) >= width:
        full = np.flatnonzero(text[: len(h) - width + 1] == text[width - 1 :])
    code = np.zeros(len(full), np.uint64)
    for k in range(width):
        code = code + h[full + k] * step[k]
    short = np.flatnonzero((counts > 0) & (counts < width))
    rest = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        has = counts[short] > k
        rest[has] += h[first[short[has]] + k] * step[k]
    code, owner = np.concatenate([mix(code), mix(rest + _U(77))]), np.concatenate([text[full], short])
    if len(short):
        order = np.argsort(owner, kind="stable")
        code, owner = code[order], owner[order]
    return code, owner


def weighted(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) in order with the number of times it occurs there: owner, code, weight."""
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    new = np.concatenate([[True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])]) if len(code) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return owner[at], code[at], np.diff(np.append(at, len(code))).astype(np.float64)


def text_runs(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) for runs of rows of at most ``most`` bytes, or of one longer text."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def weighted_set(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of one text, ascending, and their counts."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    code, owner = shingles(raw, np.array([0, len(raw)]))
    _, code, weight = weighted(code, owner)
    return code, weight
