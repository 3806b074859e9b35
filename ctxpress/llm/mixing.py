"""Logistic mixing of hashed-context bit predictors in numpy, over whole arrays of bits.

A :class:`Mixer` has several predictors. Each looks up, for every bit, a slot with the numbers of zeros and ones that
followed its context; small counts go through a learnt map (so that "seen once" means what it turned out to mean),
large ones are taken as they are. The stretched predictions are combined by weights that a gate picks (how deep the
bit lies, how well one context is known), and the mix is refined by an adaptive map. Weights and map learn while they
code: with ``streams`` each document starts from the trained ones and adapts them block by block to itself alone, so a
document's code length depends on nothing but the document and the trained model.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass, field

import numpy as np

_U = np.uint64
GATES, ROWS, BUCKETS = 32, 4, 33
_SMALL = 64
_LEVEL = np.array([*range(8), *[8] * 4, *[9] * 4, *[10] * 16, *[11] * 33], np.int64)  # of a count of 0 to 64
_TYPICAL = np.array([*range(8), 9.5, 13.5, 22.0, 45.0])
_N = len(_TYPICAL)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slot_bits(n: int, least: int = 14, most: int = 20) -> int:
    """Binary digits of a slot number for about ``n`` contexts: tables grow with the corpus up to 2**most slots."""
    return min(most, max(least, int(n).bit_length()))


def hashed(contexts: list[np.ndarray], node: np.ndarray, bits: int) -> list[np.ndarray]:
    """Slots of (context, node) for each of several contexts, in place of them."""
    spread, out = node.astype(np.uint64) * _U(0x9E3779B97F4A7C15), []
    for c in contexts:
        c ^= spread
        c *= _U(0xD1B54A32D192ED03)
        c >>= _U(64 - bits)
        out.append(c.view(np.int64))
    return out


def _direct(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4)))


def _packed(table: np.ndarray, sightings: np.ndarray) -> np.ndarray:
    """Predictions (of 16 bits' precision) with the sightings in their last two bits: one look-up gives both."""
    return (table.view(np.uint32) | sightings).view(np.float32)


def _unpacked(x: np.ndarray) -> np.ndarray:
    """The sightings in ``x``, which keeps the predictions alone."""
    raw = x.view(np.uint32)
    seen = raw & np.uint32(3)
    raw -= seen
    return seen.astype(np.int64)


@dataclass
class Mixer:
    """``sizes``: slots of each predictor; ``known``: the predictor whose number of sightings gates the weights."""

    sizes: tuple[int, ...]
    known: int
    counts: list[np.ndarray] = field(default_factory=list)
    maps: np.ndarray | None = None
    weights: np.ndarray | None = None
    refine: np.ndarray | None = None
    tables: list[np.ndarray] = field(default_factory=list, repr=False)
    sightings: np.ndarray | None = None
    packed: np.ndarray | None = field(default=None, repr=False)

    def __post_init__(self):
        p = len(self.sizes)
        if not self.counts:
            self.counts = [np.zeros(2 * n, np.int32) for n in self.sizes]
        if self.maps is None:
            one, zero = np.meshgrid(_TYPICAL, _TYPICAL)  # cell: level of zeros, level of ones
            self.maps = np.tile(_direct(zero, one).reshape(-1).astype(np.float32), (p, 1))
        if self.weights is None:
            self.weights = np.concatenate([np.full((p, GATES), 1.2 / p), np.zeros((1, GATES))]).astype(np.float32)
        if self.refine is None:
            self.refine = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, BUCKETS))), (ROWS, 1)).astype(np.float32)

    def learn(self, slots: list[np.ndarray], bit: np.ndarray, times: np.ndarray | int = 1) -> None:
        """Adds each bit to its slots, so many ``times``."""
        times = np.broadcast_to(np.asarray(times, np.int32), bit.shape)
        for own, slot in zip(self.counts, slots, strict=True):
            np.add.at(own, slot * 2 + bit, times)

    def _stretched(self, p: int, n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
        cell = _LEVEL.take(np.minimum(n0, _SMALL)) * _N + _LEVEL.take(np.minimum(n1, _SMALL))
        return np.where(n0 + n1 > _SMALL, _direct(n0, n1), self.maps[p].take(cell)).astype(np.float32)

    @staticmethod
    def _sighted(n: np.ndarray) -> np.ndarray:
        return ((n > 0).astype(np.uint8) + (n > 7) + (n > 63)).astype(np.uint8)

    def seal(self) -> Mixer:
        """Replaces the counts by each slot's stretched prediction: what coding needs."""
        if not self.tables:
            pairs = [c.reshape(-1, 2) for c in self.counts]
            self.tables = [self._stretched(p, c[:, 0], c[:, 1]).astype(np.float16).astype(np.float32) for p, c in enumerate(pairs)]
            self.sightings = self._sighted(pairs[self.known].sum(axis=1))
            self.counts = []
        return self

    def __getstate__(self) -> dict:
        """Small when pickled: what is broadcast is written to the disks of all executors."""
        packed = [(zlib.compress(t.astype(np.float16).tobytes(), 1), len(t)) for t in self.tables]
        return self.__dict__ | {"tables": packed, "packed": None, "counts": [zlib.compress(c.tobytes(), 1) for c in self.counts]}

    def __setstate__(self, state: dict) -> None:
        tables = [np.frombuffer(zlib.decompress(t), np.float16).astype(np.float32) for t, _ in state["tables"]]
        self.__dict__.update(state | {"tables": tables, "counts": [np.frombuffer(zlib.decompress(c), np.int32).copy() for c in state["counts"]]})

    def inputs(self, slots: list[np.ndarray], depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions with a constant, and the gate of each bit; ``depth`` from 0 to 7."""
        x = np.empty((len(slots) + 1, len(depth)), np.float32)
        if self.packed is None:
            self.packed = _packed(self.tables[self.known], self.sightings)
        for p, slot in enumerate(slots):
            np.take(self.packed if p == self.known else self.tables[p], slot, out=x[p], mode="clip")
        x[-1] = 0.3
        return x, depth * 4 + _unpacked(x[self.known])

    def left_out(self) -> LeftOut:
        """What each counted bit finds once what it added itself is taken off, by slot * 2 + bit, after the maps of small
        counts are learnt from all counted bits."""
        tables, sightings = [], None
        for p, n in enumerate(self.counts):
            n = n.reshape(-1, 2)
            n0 = np.stack([np.maximum(n[:, 0] - 1, 0), n[:, 0]], axis=1).reshape(-1)
            n1 = np.stack([n[:, 1], np.maximum(n[:, 1] - 1, 0)], axis=1).reshape(-1)
            cell = _LEVEL.take(np.minimum(n0, _SMALL)) * _N + _LEVEL.take(np.minimum(n1, _SMALL))
            hits, ones = np.bincount(cell, n.reshape(-1), _N * _N), np.bincount(cell[1::2], n[:, 1], _N * _N)
            prior = 1 / (1 + np.exp(-self.maps[p]))
            share = (ones + 4 * prior) / (hits + 4)
            self.maps[p] = np.log(share / (1 - share))
            tables.append(self._stretched(p, n0, n1).astype(np.float16).astype(np.float32))
            if p == self.known:
                sightings = self._sighted(n0 + n1)
        return LeftOut(self.known, tables, sightings, self.weights)

    def move(self, found: Statistics) -> None:
        """One Newton step of the weights, and the refinement, from the statistics of all counted bits."""
        for g in range(GATES):
            self.weights[:, g] += np.linalg.solve(found.curve[g] + np.eye(len(self.weights)), found.slope[g])
        start = 1 / (1 + np.exp(-np.linspace(-8, 8, BUCKETS)))
        self.refine[:] = (found.ones + 4 * start) / (found.hits + 4)

    def fit(self, slots: list[np.ndarray], bit: np.ndarray, depth: np.ndarray, passes: int = 2, block: int = 1024) -> LeftOut:
        """Learns the maps of small counts from all counts, then weights and refinement online over the given bits, which
        are in the counts already: what a bit itself added to its slots is taken off. What it gives holds the weights."""
        left_out = self.left_out()
        x, gate = left_out.inputs(slots, bit, depth)
        row = depth >> 1
        for _ in range(passes):
            cuts = list(range(0, len(bit), block)) + [len(bit)]
            weights, refine = self.weights, self.refine
            self.code(x, bit, gate, row, cuts, weights, refine, rate=0.02, pace=0.02)
        return left_out

    def code(self, x, bit, gate, row, cuts, weights, refine, rate: float, pace: float, last: bool = False) -> np.ndarray:
        """log10 probability of each bit; ``weights`` (inputs, gates) and ``refine`` (rows, buckets) learn in place after
        each block of bits between two ``cuts`` (they may hold many streams, if gate and row count through them), but not
        from the ``last`` block, after which nothing is coded."""
        out, flat = np.empty(len(bit), np.float32), refine.reshape(-1)
        n_gates, n_cells = weights.shape[1], flat.size
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            xs, ys, g = x[:, a:b], bit[a:b], gate[a:b]
            z = weights[0].take(g) * xs[0]
            for i in range(1, len(xs)):
                z += weights[i].take(g) * xs[i]
            np.clip(z, -7.999, 7.999, out=z)
            p = 1 / (1 + np.exp(-z))
            at = (z + np.float32(8)) * np.float32((BUCKETS - 1) / 16)
            lo = at.astype(np.int64)
            part = at - np.floor(at)
            cell = row[a:b] * BUCKETS + lo
            refined = flat.take(cell) * (1 - part) + flat.take(cell + 1) * part
            final = np.clip((p + refined) / 2, 1e-6, 1 - 1e-6)
            np.log(np.abs(final - (1 - ys).astype(np.float32)), out=out[a:b])
            if rate and (b < cuts[-1] or not last):
                miss = ys - p
                scale = rate / np.sqrt(np.maximum(np.bincount(g, minlength=n_gates), 1))
                for i in range(len(xs)):
                    weights[i] += scale * np.bincount(g, miss * xs[i], n_gates)
                near = cell + (part > 0.5)
                hits, ones = np.bincount(near, minlength=n_cells), np.bincount(near, ys, n_cells)
                flat += np.minimum(0.5, pace * hits) * (ones / np.maximum(hits, 1) - flat) * (hits > 0)
        out *= np.float32(1 / np.log(10))
        return out


@dataclass
class Statistics:
    """Sums over bits: slope and curvature of the log likelihood by gate, and zeros and ones by cell of the refinement."""

    slope: np.ndarray
    curve: np.ndarray
    hits: np.ndarray
    ones: np.ndarray

    @staticmethod
    def none(inputs: int) -> Statistics:
        return Statistics(*(np.zeros(s) for s in ((GATES, inputs), (GATES, inputs, inputs), (ROWS, BUCKETS), (ROWS, BUCKETS))))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.slope, self.curve, self.hits, self.ones

    def tobytes(self) -> bytes:
        return b"".join(part.tobytes() for part in self.parts())

    def add(self, data: bytes) -> None:
        """Adds what ``tobytes`` gave."""
        at = 0
        for part in self.parts():
            part += np.frombuffer(data, np.float64, part.size, at).reshape(part.shape)
            at += part.nbytes


@dataclass
class LeftOut:
    """Predictions and sightings by slot * 2 + bit, for bits that are in the counts, and the weights to start from."""

    known: int
    tables: list[np.ndarray]
    sightings: np.ndarray
    weights: np.ndarray
    packed: np.ndarray | None = None

    def __getstate__(self) -> dict:
        packed = [zlib.compress(t.astype(np.float16).tobytes(), 1) for t in self.tables]
        return self.__dict__ | {"tables": packed, "packed": None, "sightings": zlib.compress(self.sightings.tobytes(), 1)}

    def __setstate__(self, state: dict) -> None:
        tables = [np.frombuffer(zlib.decompress(t), np.float16).astype(np.float32) for t in state["tables"]]
        self.__dict__.update(state | {"tables": tables, "sightings": np.frombuffer(zlib.decompress(state["sightings"]), np.uint8)})

    def inputs(self, slots: list[np.ndarray], bit: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Like those of a sealed :class:`Mixer`."""
        x = np.empty((len(slots) + 1, len(depth)), np.float32)
        if self.packed is None:
            self.packed = _packed(self.tables[self.known], self.sightings)
        for p, slot in enumerate(slots):
            at = slot * 2
            at += bit
            np.take(self.packed if p == self.known else self.tables[p], at, out=x[p], mode="clip")
        x[-1] = 0.3
        return x, depth * 4 + _unpacked(x[self.known])

    def gather(self, into: Statistics, slots: list[np.ndarray], bit: np.ndarray, depth: np.ndarray, times: np.ndarray | None = None) -> None:
        """Adds the statistics of the bits, each so many ``times`` (once). The row of the refinement hangs on the depth, so
        on the gate."""
        x, gate = self.inputs(slots, bit, depth)
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        x, y, ends = x.take(order, axis=1), bit.take(order).astype(np.float32), np.cumsum(np.bincount(gate, minlength=GATES))
        n = np.ones(len(y), np.float32) if times is None else times.take(order).astype(np.float32)
        for g, (a, b) in enumerate(zip([0, *ends], ends)):
            if a == b:
                continue
            xs, ys, ns = x[:, a:b], y[a:b], n[a:b]
            z = np.clip(self.weights[:, g] @ xs, -7.999, 7.999)
            p = 1 / (1 + np.exp(-z))
            into.slope[g] += xs @ (ns * (ys - p))
            into.curve[g] += (xs * (ns * p * (1 - p))) @ xs.T
            cell = np.rint((z + 8) * ((BUCKETS - 1) / 16)).astype(np.int64)
            into.hits[g >> 3] += np.bincount(cell, ns, BUCKETS)
            into.ones[g >> 3] += np.bincount(cell, ns * ys, BUCKETS)


def distinct(shared: np.ndarray, length: np.ndarray, times: np.ndarray, start: np.ndarray, deep: int = 64, most: int = 50_000):
    """Of paths in sorted order, each with its ``length``, its first ``shared`` bits as in the path before and so many
    ``times``: (path, place, times) of every bit once, in runs of about ``most`` bits; the place is ``start`` of the path and
    the bit's depth. A bit that several paths run through is one with the sum of their times; from ``deep`` on, which
    ``shared`` does not exceed, each path has its own."""
    new = np.maximum(length - shared, 0)
    ends = np.cumsum(new)
    base = ends - new - shared  # the bit of a path at a depth is at base + depth
    sums, total = np.repeat(times.astype(np.int32), new), np.concatenate([[0], np.cumsum(times)])
    shared = np.append(shared, 0).astype(np.min_scalar_type(deep))
    for d in range(int(shared.max())):  # deeper, no two paths run together
        fresh = shared <= d
        turns = np.flatnonzero(fresh[1:] != fresh[:-1])  # a path that the next ones go with, then the last of these
        sums[base.take(turns[::2]) + d] = total.take(turns[1::2] + 1) - total.take(turns[::2])
    offset, lo = start - base, 0
    while lo < len(new):
        begin = int(ends[lo] - new[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, begin + most)))
        path, end = np.repeat(np.arange(lo, hi), new[lo:hi]), int(ends[hi - 1])
        yield path, np.arange(begin, end) + offset.take(path), sums[begin:end]
        lo = hi


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading binary digits that unsigned 64-bit numbers have in common."""
    x = a ^ b
    return 64 - np.frexp((x & ~(x >> _U(1))).astype(np.float64))[1].astype(np.int64)  # no digit behind the first: no rounding up


class Tree:
    """A Huffman tree over symbols 0 to n - 1: ``start``, ``length`` of each symbol's path in ``nodes`` and ``bits``."""

    def __init__(self, counts: list[int]):
        n = len(counts)
        heap = [(c, k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        up, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.uint8)
        k = n
        while len(heap) > 1:
            (c, i), (d, j) = heapq.heappop(heap), heapq.heappop(heap)
            up[i] = up[j] = k
            side[j] = 1
            heapq.heappush(heap, (c + d, k))
            k += 1
        root, cur, steps = k - 1, np.arange(n), []
        while (alive := cur != root).any() and n > 1:
            steps.append((np.where(alive, up[cur] - n, -1), side[cur]))
            cur = np.where(alive, up[cur], cur)
        self.length = np.sum([s[0] >= 0 for s in steps], axis=0, dtype=np.int64) if steps else np.zeros(n, np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.nodes, self.bits = np.zeros(int(self.length.sum()), np.int32), np.zeros(int(self.length.sum()), np.uint8)
        for k, (node, bit) in enumerate(steps):
            own = np.flatnonzero(node >= 0)
            at = self.start[own] + self.length[own] - 1 - k
            self.nodes[at], self.bits[at] = node[own], bit[own]
        self.n_nodes = max(1, n - 1)
        self.depths = np.minimum(np.arange(len(self.nodes)) - np.repeat(self.start, self.length), 7).astype(np.uint8)
        self.code = np.zeros(n, np.uint64)  # the path's bits from the highest digit on: 64 are enough below 2**44 tokens
        for d in range(len(steps)):
            own = np.flatnonzero(self.length > d)
            self.code[own] |= self.bits[self.start[own] + d].astype(np.uint64) << _U(63 - d)
        self.leaves = np.argsort(self.code, kind="stable")  # symbols by path
        self.rank = np.empty(n, np.int64)
        self.rank[self.leaves] = np.arange(n)


MOST_KEYS = 1 << 22  # tokens whose equal bits are found at a time
DIGITS = {"cls": 6, "before": 17, "place": 6}  # binary digits that a value of each context takes


class WordModel:
    """Codes sequences of symbols (0: escape, 1: end, then words) by a tree whose bits are mixed from four contexts: none,
    the document's class, the word before, and the place in the text."""

    def __init__(self, weights: list[int], bits: int, tree: Tree | None = None):
        self.weights, self.tree, self.bits, self.n = weights, tree or Tree(weights), bits, len(weights)
        self.mixer = Mixer((self.tree.n_nodes, *[1 << bits] * 3), known=2)
        self.pending: list[np.ndarray] = []

    def contexts(self, symbols: np.ndarray, place: np.ndarray, cls: np.ndarray) -> list[np.ndarray]:
        """The hashed contexts of each token; ``place`` counts from 0 in each document."""
        return [self._of(0, cls), self._of(1, self._before(symbols, place)), self._of(2, _log2(place))]

    def _before(self, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.where(place > 0, np.concatenate([[self.n], symbols[:-1]]), self.n)

    @staticmethod
    def _of(k: int, value: np.ndarray) -> np.ndarray:
        return mix(value.astype(np.uint64) + (_U(k + 1) << _U(56)))

    def steps(self, symbols: np.ndarray, contexts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """slots (those without context first), bit, depth of every bit of the tokens in their order; bits of each token."""
        lengths = self.tree.length.take(symbols)
        token = np.repeat(np.arange(len(symbols)), lengths)
        at = (self.tree.start.take(symbols) - (np.cumsum(lengths) - lengths)).take(token)
        at += np.arange(len(at))
        node = self.tree.nodes.take(at)
        slots = [node.astype(np.int64), *hashed([c.take(token) for c in contexts], node, self.bits)]
        return slots, self.tree.bits.take(at), self.tree.depths.take(at).astype(np.int64), lengths

    def key(self, symbols: np.ndarray, **values: np.ndarray) -> np.ndarray:
        """A number for each token of its values of some contexts (see ``DIGITS``, in that order) and its path."""
        key = np.zeros(len(symbols), np.uint64)
        for name, value in values.items():
            key = key << _U(DIGITS[name]) | value.astype(np.uint64)
        return key << _U(17) | self.tree.rank.take(symbols).astype(np.uint64)

    def keys(self, symbols: np.ndarray, place: np.ndarray, cls: np.ndarray) -> np.ndarray:
        return self.key(symbols, cls=cls, before=self._before(symbols, place), place=_log2(place))

    def all_bits(self, keys: list[np.ndarray], names: tuple[str, ...] = ("cls", "before", "place"), most: int = 200_000):
        """slots, bit, depth and times of the bits of the tokens with these ``keys``, made of the contexts ``names``: a bit
        that is the same in several tokens comes once, as far as about ``most`` tokens next to each other go. The list is
        emptied, so that the keys are held once."""
        whole, lo = np.empty(sum(map(len, keys)), np.uint64), 0
        while keys:
            part = keys.pop()
            whole[lo : lo + len(part)] = part
            lo += len(part)
        whole.sort()
        lo = 0
        while lo < len(whole):
            hi = int(np.searchsorted(whole, whole[min(lo + most, len(whole)) - 1], "right"))  # equal tokens stay together
            part = whole[lo:hi]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            yield from self._bits(part.take(first), np.diff(first, append=len(part)), names)
            lo = hi

    def _bits(self, key: np.ndarray, times: np.ndarray, names: tuple[str, ...]):
        own = self.tree.leaves.take((key & _U(0x1FFFF)).astype(np.int64))
        code, key = self.tree.code.take(own), key >> _U(17)
        shared = np.zeros(len(own), np.int64)
        shared[1:] = np.where(key[1:] == key[:-1], _common(code[1:], code[:-1]), 0)
        contexts = []
        for name in names[::-1]:
            contexts.insert(0, self._of(list(DIGITS).index(name), key & _U((1 << DIGITS[name]) - 1)))
            key = key >> _U(DIGITS[name])
        for path, at, sums in distinct(shared, self.tree.length.take(own), times, self.tree.start.take(own)):
            node = self.tree.nodes.take(at)
            slots = [node.astype(np.int64), *hashed([c.take(path) for c in contexts], node, self.bits)]
            yield slots, self.tree.bits.take(at), self.tree.depths.take(at).astype(np.int64), sums

    def tally(self) -> np.ndarray:
        """Room for the numbers of (class, symbol) and (place, symbol)."""
        return np.zeros((2, 64, self.n), np.int32)

    def learn(self, tally: np.ndarray, symbols: np.ndarray, place: np.ndarray, cls: np.ndarray) -> None:
        """Counts the tokens: the words before them by their keys, the other contexts in ``tally`` (see ``settle``)."""
        for own, value in zip(tally, (cls, _log2(place)), strict=True):
            np.add.at(own.reshape(-1), value * self.n + symbols, np.int32(1))
        self.pending.append(self.key(symbols, before=self._before(symbols, place)))
        if sum(map(len, self.pending)) >= MOST_KEYS:
            self._count()

    def _count(self) -> None:
        for slots, bit, _, times in self.all_bits(self.pending, ("before",)) if self.pending else ():
            np.add.at(self.mixer.counts[2], slots[1] * 2 + bit, times)
        self.pending = []

    def settle(self, tally: np.ndarray) -> None:
        """Adds what was tallied to the counts."""
        self._count()
        for k, name, rows in ((0, "cls", tally[0]), (2, "place", tally[1])):
            for value in np.flatnonzero(rows.any(axis=1)):
                row = rows[value].take(self.tree.leaves)
                own = np.flatnonzero(row)
                for slots, bit, _, times in self._bits((value << 17 | own).astype(np.uint64), row.take(own), (name,)):
                    np.add.at(self.mixer.counts[k + 1], slots[1] * 2 + bit, times)
                    if k == 0:
                        np.add.at(self.mixer.counts[0], slots[0] * 2 + bit, times)

    def log10(self, documents: list[tuple[np.ndarray, int]], block: int = 128, most: int = 20_000) -> np.ndarray:
        """log10 probability of each document, given as its symbols and class. Weights and map start anew for each
        document and learn from it after every ``block`` tokens. About ``most`` tokens are coded at a time, so that the
        arrays stay in the processor's cache; the result does not depend on it."""
        out, lo, most = np.zeros(len(documents)), 0, max(block, most // block * block)
        order = sorted(range(len(documents)), key=lambda k: len(documents[k][0]))  # documents of like length take like many blocks
        while lo < len(order):
            hi, size = lo, 0
            while hi < len(order) and (hi == lo or size + len(documents[order[hi]][0]) <= most):
                size, hi = size + len(documents[order[hi]][0]), hi + 1
            out[order[lo:hi]] = self._run([documents[k] for k in order[lo:hi]], block, most)
            lo = hi
        return out

    def _run(self, documents: list[tuple[np.ndarray, int]], block: int, most: int) -> np.ndarray:
        d = len(documents)
        sizes = np.array([len(s) for s, _ in documents])
        symbols, doc = np.concatenate([s for s, _ in documents]), np.repeat(np.arange(d), sizes)
        place = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        contexts = self.contexts(symbols, place, np.repeat([c for _, c in documents], sizes))
        order = np.argsort(place // block, kind="stable")
        weights, refine = np.tile(self.mixer.weights, (1, d)), np.tile(self.mixer.refine, (d, 1))
        out = np.zeros(d)
        for a in range(0, len(order), most):  # one longer document: piece by piece
            own = order[a : a + most]
            slots, bit, depth, lengths = self.steps(symbols.take(own), [c.take(own) for c in contexts])
            x, gate = self.mixer.inputs(slots, depth)
            stream, turn = doc.take(own), place.take(own) // block
            ends = np.cumsum(lengths)
            cuts = [0, *ends[np.flatnonzero(np.diff(turn))].tolist(), len(bit)]
            shift = np.repeat(stream * ROWS, lengths)
            depth >>= 1
            depth += shift
            shift *= GATES // ROWS
            gate += shift
            cost = self.mixer.code(x, bit, gate, depth, cuts, weights, refine, rate=0.01, pace=0.005, last=a + most >= len(order))
            out += np.bincount(stream, np.add.reduceat(cost, ends - lengths, dtype=np.float64), d)  # each symbol has a bit at least
        return out


def _log2(place: np.ndarray) -> np.ndarray:
    """Binary digits of a place, 0 to 63."""
    return np.frexp(place.astype(np.float64))[1].astype(np.int64)


SPELL = 7


class SpellingModel:
    """Codes the bytes of a new word and its closing blank: orders 0 to 4 within the word, its whole beginning, and the
    document's class with order 2."""

    def __init__(self, bits: int):
        self.bits = bits
        self.mixer = Mixer((1 << bits,) * SPELL, known=5)

    def steps(self, words: list[bytes], cls: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """slots, bit, depth and word of every bit, byte by byte."""
        raw, lengths, place, word = self._bytes(words)
        each = np.arange(8 * len(raw))
        return *self._at(raw, place, self._contexts(raw, place, word, cls), each), word.take(each >> 3)

    def all_bits(self, words: list[bytes], cls: np.ndarray):
        """Every distinct bit of the words: slots, bit, depth, times. Words of a class that begin alike share those bits, up
        to 32 bytes."""
        raw, lengths, place, word = self._bytes(words)
        head = np.zeros((len(words), 32), np.uint8)
        near = np.flatnonzero(place < 32)
        head[word.take(near), place.take(near)] = raw.take(near)
        heads = head.view(">u8").astype(np.uint64).T
        order = np.lexsort((*heads[::-1], cls))
        shared, open_ = np.zeros(len(words), np.int64), cls.take(order)[1:] == cls.take(order)[:-1]
        for column in heads:
            same = _common(column.take(order)[1:], column.take(order)[:-1])
            shared[1:] += np.where(open_, same, 0)
            open_ &= same == 64
        begin, contexts = (np.cumsum(lengths) - lengths).take(order) * 8, self._contexts(raw, place, word, cls)
        for _, at, times in distinct(shared, 8 * lengths.take(order), np.ones(len(words), np.int64), begin, deep=256):
            yield *self._at(raw, place, contexts, at), times

    @staticmethod
    def _bytes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes to code, how many a word has, and place and word of each."""
        coded = [w + b" " for w in words]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        raw = np.frombuffer(b"".join(coded), np.uint8)
        place = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return raw, lengths, place, np.repeat(np.arange(len(coded)), lengths)

    @staticmethod
    def _contexts(raw: np.ndarray, place: np.ndarray, word: np.ndarray, cls: np.ndarray) -> np.ndarray:
        ctx, h = np.zeros((SPELL, len(raw)), np.uint64), np.zeros(len(raw), np.uint64)
        for k in range(1, 5):
            before = np.zeros(len(raw), np.uint64)
            before[k:] = raw[:-k].astype(np.uint64) + _U(1)
            before[place < k] = 0
            h = h * _U(257) + before
            ctx[k] = h
        total = np.concatenate([[_U(0)], np.cumsum(mix(raw.astype(np.uint64) + (place.astype(np.uint64) << _U(8))))])
        ctx[5] = total[:-1] - total[np.arange(len(raw)) - place]
        ctx[6] = ctx[2] + (cls.astype(np.uint64)[word] << _U(32))
        return mix(ctx + (np.arange(SPELL, dtype=np.uint64) << _U(56))[:, None])

    def _at(self, raw: np.ndarray, place: np.ndarray, contexts: np.ndarray, each: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """slots, bit, depth of the bits with the numbers ``each``, eight a byte."""
        byte, shift = each >> 3, 7 - (each & 7)
        code = raw.take(byte).astype(np.int64)
        slots = hashed([c.take(byte) for c in contexts], (code | 256) >> (shift + 1), self.bits)  # the bits before, with a leading one
        return slots, (code >> shift & 1).astype(np.uint8), np.minimum(place.take(byte), 7)

    def log10(self, words: list[bytes], cls: np.ndarray, most: int = 20_000) -> np.ndarray:
        """log10 probability of each word's spelling in a document of class ``cls``."""
        out = np.zeros(len(words))
        for lo, hi in runs(words, most * 10):
            slots, bit, depth, word = self.steps(words[lo:hi], cls[lo:hi])
            x, gate = self.mixer.inputs(slots, depth)
            cost = self.mixer.code(x, bit, gate, depth >> 1, [0, len(bit)], self.mixer.weights, self.mixer.refine, rate=0, pace=0)
            out[lo:hi] = np.bincount(word, cost, hi - lo)
        return out


def runs(words: list[bytes], most: int):
    """Bounds of runs of words of about ``most`` bytes."""
    lo = size = 0
    for k, w in enumerate(words):
        size += len(w) + 1
        if size >= most:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(words):
        yield lo, len(words)
