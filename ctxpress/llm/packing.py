"""Operator 9: best-fit packing by a grouping genetic algorithm on islands.

Encoded documents (with an end id) are pieces of at most ``capacity`` tokens; only longer ones are cut. Pieces are
dealt by hash into blocks of about ``block_pieces``, each with the length mix of the corpus, so a block's packing
wastes less than a sequence beyond its lower bound in the usual case and no task holds more than a block. Each block
is solved on several islands. An island evolves a small population of packings: crossover puts whole well-filled
sequences of one parent into the other, drops the sequences that then hold a piece twice and best-fits the displaced
pieces; between epochs the best packing of each island migrates to the next one. A packing that meets the lower
bound cannot be improved and ends its block's search.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxpress.llm.common import id_text, materialize, partitions, read
from ctxpress.llm.encode import encoder, tokenizer_path

CAPACITY = 2048


class _Bins:
    """Open sequences by free room, for best fit in the time of a bit scan."""

    def __init__(self, capacity: int):
        self.capacity, self.content, self.free, self.levels, self.mask = capacity, [], [], [[] for _ in range(capacity + 1)], 0

    def open(self, content: list[int], free: int) -> None:
        self.content.append(content)
        self.free.append(free)
        if not self.levels[free]:
            self.mask |= 1 << free
        self.levels[free].append(len(self.free) - 1)

    def fit(self, item: int, length: int) -> None:
        room = self.mask >> length
        if not room:
            self.open([item], self.capacity - length)
            return
        free = length + (room & -room).bit_length() - 1
        level = self.levels[free]
        k = level.pop()
        if not level:
            self.mask ^= 1 << free
        self.content[k].append(item)
        self.free[k] = left = free - length
        if not self.levels[left]:
            self.mask |= 1 << left
        self.levels[left].append(k)


def best_fit(lengths: list[int], capacity: int = CAPACITY, order: list[int] | None = None) -> list[list[int]]:
    """Best fit in the given order (default: decreasing length); the items of each sequence."""
    bins = _Bins(capacity)
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True) if order is None else order:
        bins.fit(i, lengths[i])
    return bins.content


def lower_bound(lengths: list[int], capacity: int = CAPACITY) -> int:
    """Sequences that no packing undercuts: of all tokens, and of pieces over half a sequence with what cannot join them."""
    best = -(-sum(lengths) // capacity)
    a = np.sort(np.asarray(lengths))
    cum = np.concatenate([[0], np.cumsum(a)])
    for k in {int(x) for x in a[a <= capacity // 2][:: max(1, len(a) // 64)]} | {1}:
        big = np.searchsorted(a, capacity - k, side="right")
        half = np.searchsorted(a, capacity // 2, side="right")
        low = np.searchsorted(a, k, side="left")
        room = (big - half) * capacity - (cum[big] - cum[half])
        best = max(best, len(a) - half + max(0, -(-int(cum[half] - cum[low] - room) // capacity)))
    return int(best)


def _fitness(packing: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then (Falkenauer's) higher mean squared fill."""
    return -len(packing), sum((sum(map(lengths.__getitem__, b)) / capacity) ** 2 for b in packing) / max(1, len(packing))


def crossover(one: list[list[int]], two: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Whole well-filled sequences of ``two`` go into ``one``; what they double is taken out; displaced pieces are best-fitted."""
    fill = [sum(map(lengths.__getitem__, b)) for b in two]
    well = [b for b, f in zip(two, fill, strict=True) if f >= 0.995 * capacity and rng.random() < 0.5]
    taken = {i for b in well for i in b}
    bins, displaced = _Bins(capacity), []
    for b in well:
        bins.open(list(b), capacity - sum(map(lengths.__getitem__, b)))
    for b in one:
        if taken.isdisjoint(b):
            used = sum(map(lengths.__getitem__, b))
            if used < 0.9 * capacity and rng.random() < 0.3:  # mutation: a badly filled sequence is dissolved
                displaced += b
            else:
                bins.open(list(b), capacity - used)
        else:
            displaced += [i for i in b if i not in taken]
    displaced.sort(key=lambda i: (-lengths[i], i))
    for i in displaced:
        bins.fit(i, lengths[i])
    return bins.content


def evolve(lengths: list[int], elites: list[list[list[int]]], seed: int, capacity: int = CAPACITY, population: int = 6, generations: int = 12) -> list[list[int]]:
    """One epoch of one island; ``elites`` are packings to start with. Gives the best packing found."""
    if not lengths:
        return []
    rng, bound = random.Random(seed), lower_bound(lengths, capacity)
    pool = [*elites] or [best_fit(lengths, capacity)]
    fit = lambda p: _fitness(p, lengths, capacity)
    if min(map(len, pool)) <= bound:
        return max(pool, key=fit)
    while len(pool) < population:  # the same rule with slightly disturbed lengths gives other good packings
        noisy = [n * rng.uniform(0.9, 1.1) for n in lengths]
        pool.append(best_fit(lengths, capacity, sorted(range(len(lengths)), key=noisy.__getitem__, reverse=True)))
    ranked = sorted(((fit(p), k, p) for k, p in enumerate(pool)), reverse=True)
    for n in range(generations * population // 2):
        if -ranked[0][0][0] <= bound:
            break
        one = min(rng.sample(range(len(ranked)), 2))
        two = rng.choice([k for k in range(len(ranked)) if k != one])
        child = crossover(ranked[one][2], ranked[two][2], lengths, capacity, rng)
        score = fit(child)
        if score > ranked[-1][0] and all(score != r[0] for r in ranked):
            ranked[-1] = (score, population + n, child)
            ranked.sort(key=lambda r: (r[0], -r[1]), reverse=True)
    return ranked[0][2]


def _labels(packing: list[list[int]], n: int) -> bytes:
    out = np.empty(n, "<i4")
    for k, b in enumerate(packing):
        out[b] = k
    return out.tobytes()


def _packing(labels: bytes) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(np.frombuffer(labels, "<i4").tolist()):
        bins.setdefault(k, []).append(i)
    return list(bins.values())


def encode_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, uid of each piece; of a cut document the first piece may be shorter."""
    path = path or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        encode, end = encoder(path).encode, int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                n, piece, start = len(ids) // 4, 0, 0
                stop = (n - 1) % capacity + 1
                while start < n:
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), uid))
                    piece, start, stop, uid = piece + 1, stop, stop + capacity, uid + 1
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "uid")
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return id_text(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, uid long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = 4096, islands: int = 2, epochs: int = 2) -> DataFrame:
    """``pieces`` (materialised; ``length`` in 1 to ``capacity``, ``uid`` unique) with sequence_id and a gapless offset.

    Equal rows are pieces of their own. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    n_blocks = max(1, -(-pieces.count() // block_pieces))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(n_blocks)))
    n = max(1, min(n_blocks * islands, partitions(spark)))
    blocks = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("uid", "length"))).alias("x")).select("block", F.col("x.length").alias("lengths"))
    blocks = materialize(blocks, "blocks")
    elites = None
    for epoch in range(epochs):
        state = blocks.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
        if elites is None:
            state = state.withColumn("elites", F.lit(None).cast("array<binary>"))
        else:  # an island keeps its own best packing and gets that of the one before it
            moves = elites.select("block", F.explode(F.array("island", (F.col("island") + 1) % islands)).alias("island"), "labels")
            state = state.join(moves.groupBy("block", "island").agg(F.array_sort(F.collect_list("labels")).alias("elites")), ["block", "island"])

        def run(batches, epoch=epoch):
            for batch in batches:
                for r in batch.to_pylist():
                    lengths = r["lengths"]
                    seed = (r["block"] * 31 + r["island"]) * 31 + epoch
                    best = evolve(lengths, [_packing(x) for x in r["elites"] or ()], seed, capacity)
                    yield pa.RecordBatch.from_pylist([{"block": r["block"], "island": r["island"], "bins": len(best), "labels": _labels(best, len(lengths))}], schema=pa.schema([("block", pa.int64()), ("island", pa.int32()), ("bins", pa.int32()), ("labels", pa.binary())]))

        elites = materialize(state.repartition(n).mapInArrow(run, "block long, island int, bins int, labels binary"), f"epoch{epoch}")
    best = elites.groupBy("block").agg(F.min_by("labels", F.struct("bins", "island")).alias("labels"))
    rows = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("uid", "doc_id", "piece", "start", "length", "ids_crc32"))).alias("x")).join(best, "block")

    def place(batches):
        for batch in batches:
            for block, x, labels in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                where, room, out = np.frombuffer(labels, "<i4").tolist(), {}, []
                for r, k in zip(x, where, strict=True):
                    out.append({**r, "sequence_id": (block << 24) + k, "offset": room.get(k, 0)})
                    room[k] = room.get(k, 0) + r["length"]
                yield pa.RecordBatch.from_pylist(out, schema=placed)

    placed = pa.schema([(c, pa.int32() if c == "piece" else pa.int64()) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")])
    return rows.select("block", "x", "labels").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, **how) -> DataFrame:
    """Packs (doc_id, text); a null text is empty and holds only the end id."""
    return pack(materialize(encode_pieces(docs, path, capacity, end_id), "pieces"), capacity, **how)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
