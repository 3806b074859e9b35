"""Operator 7: near-duplicate detection by ProbMinHash over weighted word shingles.

A text is the multiset of its five-word shingles. Each element sends a Poisson process of arrivals (rate: its weight)
to the registers, without replacement; a register keeps the element that arrived first, and a text's elements stop as
soon as they come later than its last register was filled. The share of equal registers estimates the probability
Jaccard similarity J_P, which is the plain Jaccard similarity where all weights are equal.

Copies with equal text are one node from the start. Nodes that agree in a band of registers share a bucket. Of a
bucket every member is first held against one centre only; components are built from the pairs that the exact J_P
confirms. Where a bucket still spans several components, members outside the largest one become centres in growing
rounds until every pair of different components in it is settled. Blocks of centres meet blocks of members where both
texts lie: each text is cut into shingles once a block, a centre is held against all its members by array sums, exact
bounds settle most pairs and J_P the rest, and what a task has linked it does not test again. No candidate is dropped,
and there is no cap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxpress.llm.common import few, materialize, partitions, read, shuffles_removed, temporary, work_dir
from ctxpress.llm.components import connected
from ctxpress.llm.shingles import mix, shingles, text_runs, weighted, weighted_set

REGISTERS = 127  # a prime: start + i * stride runs through all registers
_U = np.uint64


def prob_min_hash(owner: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """(n, m) signatures of n weighted sets given as rows sorted by owner; 0 where a set is empty."""
    first, sign = np.full((n, m), np.inf), np.zeros((n, m), np.uint64)
    flat_first, flat_sign = first.reshape(-1), sign.reshape(-1)
    seed = mix(code + _U(0x632BE59BD9B4E019))
    at, stride = (seed % _U(m)).astype(np.int64), 1 + ((seed >> _U(32)) % _U(m - 1)).astype(np.int64)
    time = np.zeros(len(code))
    for i in range(m):
        seed = mix(seed + _U(0x9E3779B97F4A7C15))
        uniform = ((seed >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)
        time = time - np.log(uniform) / weight * (m / (m - i))
        where = owner * m + at
        np.minimum.at(flat_first, where, time)
        won = flat_first[where] == time
        flat_sign[where[won]] = code[won]
        new = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
        active = owner[new]
        last = first[active].max(axis=1)
        keep = time < np.repeat(last, np.diff(np.append(np.flatnonzero(new), len(owner))))
        if not keep.any():
            break
        owner, code, weight, time, seed = owner[keep], code[keep], weight[keep], time[keep], seed[keep]
        at, stride = at[keep], stride[keep]
        at = (at + stride) % m
    return sign


def band_hashes(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) 64-bit bucket numbers, each of ``rows`` registers and the band's index."""
    out = np.empty((len(sign), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sign), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * _U(0x9E3779B97F4A7C15) + sign[:, b * rows + r])
        out[:, b] = h
    return out


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two weighted sets (codes ascending, weights); 0 if either is empty."""
    (ca, wa), (cb, wb) = a, b
    common, ia, ib = np.intersect1d(ca, cb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    xs, ys = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - xs.sum(), wb.sum() - ys.sum()
    ratio, of = np.unique(xs / ys, return_inverse=True)
    total = np.array([np.maximum(xs, t * ys).sum() for t in ratio]) + only_a + ratio * only_b
    return float((xs / total[of]).sum())


def sketch(docs: DataFrame, bands: int = 25, rows: int = 5) -> DataFrame:
    """doc_id, node (digest of the text), buckets (none for a text without words)."""

    def run(batches):
        import hashlib

        for batch in batches:
            texts = batch.column(1)
            for lo, hi, raw, offsets in text_runs(texts):
                n = hi - lo
                owner, code, weight = weighted(*shingles(raw, offsets))
                hashes = band_hashes(prob_min_hash(owner, code, weight, n), bands, rows).astype(np.int64)
                some = np.bincount(owner, minlength=n) > 0
                view, cut = memoryview(np.ascontiguousarray(raw)), offsets.tolist()
                nodes = [hashlib.md5(view[x:y]).digest() for x, y in zip(cut, cut[1:])]
                ends = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                buckets = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[some].reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(nodes, pa.binary()), buckets], names=["doc_id", "node", "buckets"])

    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return lean.mapInArrow(run, "doc_id long, node binary, buckets array<long>")


def _confirmed(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact J_P is at least ``similarity``."""
    pairs = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    pairs = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches):
        held: tuple[bytes | None, tuple] = (None, ())
        for batch in batches:
            keep = []
            for a, x, y in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if held[0] != a:  # the join leaves the pairs of a centre side by side
                    held = (a, weighted_set(x))
                keep.append(probability_jaccard(held[1], weighted_set(y)) >= similarity)
            found = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield found

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def linked(codes: np.ndarray, weights: np.ndarray, ends: np.ndarray, labels: np.ndarray, centres: list[int], allowed, similarity: float) -> list[tuple[int, int]]:
    """Links (centre, member) that join all sets of a group whose J_P says so, without testing pairs that are joined already.

    Set i has the ``codes`` and ``weights`` from ``ends[i - 1]`` to ``ends[i]`` and none is empty; ``labels`` are the
    components so far (changed in place); ``allowed(c)`` gives the sets that centre c is to be held against. A pair is
    settled by exact bounds first. With p and q, both sets scaled to weight 1, J_P is at most the sum of min(p, q). With
    m, the sum of the lesser weights, W the sizes and R what weights above 1 add to them, J_P is at most
    (m + Ra + Rb) / (Wa + Wb - m), as a common element adds at most its greater weight over Wa + Wb - m.
    """
    starts = np.concatenate([[0], ends[:-1]])
    length, size = ends - starts, np.add.reduceat(weights, starts)
    extra = size - length
    share = weights / np.repeat(size, length)
    names, ids = np.unique(codes, return_inverse=True)
    mine, found = np.zeros(len(names)), []
    for c in centres:
        own = slice(starts[c], ends[c])
        rest = allowed(c)
        rest = rest[labels[rest] != labels[c]]
        if not len(rest):
            continue
        mine[ids[own]] = weights[own]
        cut = np.concatenate([[0], np.cumsum(length[rest])])
        at = np.arange(cut[-1]) + np.repeat(starts[rest] - cut[:-1], length[rest])
        x = mine[ids[at]]
        common = np.add.reduceat(np.minimum(x, weights[at]), cut[:-1])
        alike = np.add.reduceat(np.minimum(x / size[c], share[at]), cut[:-1])
        slack = similarity - 1e-9
        may = (alike >= slack) & (common + extra[c] + extra[rest] >= slack * (size[c] + size[rest] - common))
        for i in np.flatnonzero(may):
            b = rest[i]
            if labels[b] == labels[c]:
                continue
            y, z = x[cut[i] : cut[i + 1]], weights[starts[b] : ends[b]]
            both = y > 0
            ratio, of = np.unique(y[both] / z[both], return_inverse=True)
            outside = size[c] - y.sum()
            total = np.array([np.maximum(y, t * z).sum() for t in ratio]) + outside
            if (y[both] / total[of]).sum() >= similarity:
                found.append((c, b))
                labels[labels == labels[b]] = labels[c]
        mine[ids[own]] = 0
    return found


def _settle(hard: DataFrame, texts: DataFrame, similarity: float, bytes_a_block: int) -> DataFrame:
    """Links (a, b) between the centres and the members of each bucket that lie in different components.

    ``hard``: bucket, node, component, size (bytes of the text), turn (whether it is a centre now), buckets. A bucket's
    centres and members are dealt into blocks of about ``bytes_a_block`` bytes of text each; one pair of blocks is what
    a task holds at once. A pair of nodes is tested only in the first bucket that they share.
    """
    blocks = lambda c: F.ceil(F.coalesce(F.sum(c), F.lit(0)) / bytes_a_block)
    plan = hard.groupBy("bucket").agg(blocks(F.when(F.col("turn"), F.col("size"))).alias("across"), blocks("size").alias("down")).where("across > 0")
    dealt = hard.join(plan, "bucket")
    number = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    across, down = F.col("across"), F.col("down")
    centres = dealt.where("turn").select("bucket", number(across).alias("i"), every(down).alias("j"), F.lit(0).alias("role"), "node", "component", "turn", "buckets")
    members = dealt.select("bucket", every(across).alias("i"), number(down).alias("j"), F.lit(1).alias("role"), "node", "component", "turn", "buckets")
    rows = centres.unionByName(members).join(texts, "node").select("bucket", "i", "j", "role", "node", "component", "turn", "buckets", "text")
    rows = rows.repartition(4 * partitions(hard.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "role")

    def group(part: pa.Table):
        part = part.combine_chunks()
        role, turn = part["role"].to_numpy(), part["turn"].to_numpy()
        n, n_centres = len(role), int((role == 0).sum())
        if n_centres in (0, n):
            return None
        bucket, node = part["bucket"][0].as_py(), part["node"].to_pylist()
        codes, weights, counts = [], [], np.zeros(n, np.int64)
        for lo, hi, raw, offsets in text_runs(part["text"].combine_chunks()):
            owner, code, weight = weighted(*shingles(raw, offsets))
            counts[lo:hi] = np.bincount(owner, minlength=hi - lo)
            codes.append(code)
            weights.append(weight)
        shared = np.array(part["buckets"].to_pylist(), np.int64)
        seen: dict[bytes, int] = {}
        labels = np.array([seen.setdefault(x, len(seen)) for x in part["component"].to_pylist()])
        members = np.arange(n_centres, n)
        order = {x: k for k, x in enumerate(sorted(set(node)))}
        rank = np.array([order[x] for x in node])
        later = np.where(turn, rank, n)[members]

        def allowed(c: int) -> np.ndarray:
            same = shared[members] == shared[c]
            first = shared[c][same.argmax(axis=1)] == bucket
            # two centres meet twice, once in each role
            return members[first & (later > rank[c])]

        found = linked(np.concatenate(codes), np.concatenate(weights), np.cumsum(counts), labels, range(n_centres), allowed, similarity)
        return pa.RecordBatch.from_arrays([pa.array([node[k] for k in side], pa.binary()) for side in (zip(*found) if found else ((), ()))], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            edge = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *edge], [*edge, batch.num_rows]):
                if hi == lo:
                    continue
                now = tuple(keys[:, lo])
                if held and now != key:
                    if (out := group(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                key = now
                held.append(batch.slice(lo, hi - lo))
        if held and (out := group(pa.Table.from_batches(held))) is not None:
            yield out

    return rows.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, bands: int = 25, rows: int = 5, small: int = 500_000, bytes_a_block: int = 1 << 22) -> DataFrame:
    """doc_id, node, class_id for every row of ``docs``: class_id is the least doc_id of the row's group.

    A null text is empty. Equal texts are always one group, empty ones too; texts of fewer than five words match by
    all their words. Groups are the connected components of the confirmed pairs. ``small``: up to so many nodes, the
    list of those that need their text is broadcast (24 bytes a node); beyond, it is a shuffle join. ``bytes_a_block``:
    about so many bytes of text of a bucket meet as many in one step of a task; results do not depend on it.
    Tables of ids are written as few files.
    """
    spark = docs.sparkSession
    at = work_dir(spark)
    rows_ = materialize(sketch(docs, bands, rows), "sketch", at)
    signed = rows_.groupBy("node").agg(F.first("buckets").alias("buckets"))
    dealt = signed.select("node", F.explode("buckets").alias("bucket"))
    centre = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("centre")).where("n > 1").drop("n")
    members = materialize(dealt.join(centre, "bucket"), "members", at, few(spark))
    needed = materialize(members.select("node").distinct(), "needed", at, few(spark))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    needed = F.broadcast(needed) if needed.count() <= small else needed
    texts = docs.select(F.unhex(F.md5(text)).alias("node"), text.alias("text")).join(needed, "node", "left_semi").dropDuplicates(["node"])
    texts = materialize(texts, "texts", at)
    nodes = signed.join(texts.select("node", F.octet_length("text").cast("long").alias("size")), "node")
    nodes = materialize(nodes, "nodes", at, few(spark))
    members_ = members.select("bucket", "node")

    pairs = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = materialize(_confirmed(pairs, texts, similarity).repartition(few(spark)), "links0", at)
    groups = materialize(connected(links, f"{at}/round0"), "groups0", at)
    done: DataFrame | None = None
    for k in range(1, 40):
        most = 256 * 16 ** (k - 1)
        labelled = members_.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        labelled = materialize(labelled, f"labelled{k}", at, few(spark))
        sizes = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
        spans = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.max_by("component", F.struct("n", "component")).alias("largest")).where("parts > 1")
        hard = labelled.join(spans.select("bucket", "largest", "n"), "bucket")
        if done is not None:  # what was a centre before is settled against all of its bucket
            hard = hard.join(done, ["bucket", "node"], "left_anti")
        # of each bucket that spans several components, members outside the largest become centres: all of a bucket of up to ``most``
        turn = F.pmod(F.xxhash64("node", "bucket"), F.lit(1 << 20)) * F.col("n") < F.lit(most << 20)
        outside = F.col("component") != F.col("largest")
        hard = materialize(hard.select("bucket", "node", "component", outside.alias("outside"), (outside & turn).alias("turn")), f"hard{k}", at, few(spark))
        if hard.where("outside").isEmpty():
            break
        centres = hard.where("turn").select("bucket", "node")
        links = materialize(_settle(hard.join(nodes, "node"), texts, similarity, bytes_a_block).repartition(few(spark)), f"links{k}", at)
        done = centres if done is None else done.unionByName(centres)
        if not links.isEmpty():
            edges = links.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
            groups = materialize(connected(edges, f"{at}/round{k}"), f"groups{k}", at)
    named = rows_.select("doc_id", "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named, "named", at, few(spark))
    least = named.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return named.join(least, "component").select("doc_id", "node", "class_id", "component")


def near_dedup_filter(docs: DataFrame, **how) -> DataFrame:
    """One row of each group of ``docs`` (the least doc_id; of equal rows one), with its own columns.

    Only the list of kept rows is left of the groups' tables and shuffles when whole rows are moved. They are dealt once, by
    id and text: a kept text has one kept id, so equal rows that are left meet there too.
    """
    spark = docs.sparkSession
    at = work_dir(spark)
    with temporary(spark), shuffles_removed(spark):
        groups = near_duplicates(docs, **how)
        kept = groups.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("r"))
        kept = materialize(kept.select("r.doc_id", "r.node"), "kept", at, few(spark))
    key = ["__ctx_id", "__ctx_null", "__ctx_node"]  # without nulls, as plain columns: the join and the last step share one exchange
    number = lambda c: (F.coalesce(c, F.lit(0)).alias(key[0]), c.isNull().alias(key[1]))
    node = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    marked = docs.select("*", *number(F.col("doc_id").cast("long")), node.alias(key[2]))
    kept = kept.select(*number(F.col("doc_id")), F.col("node").alias(key[2]))
    return marked.join(kept, key, "left_semi").dropDuplicates(key).drop(*key)


def op7_prob_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
