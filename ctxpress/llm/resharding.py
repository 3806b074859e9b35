"""Operator 5: minimum-cost-flow resharding.

From the bytes of the old shards and the capacities of the new ones a minimum-cost flow (a byte that stays costs 0, one
that moves costs 1) says how many bytes go from each old shard to each new one. Within an old shard documents lie by
descending size (ties: by id), so blocks are runs of that order and the cuts between them fall among small documents.
Running totals are two-level: sums within range partitions, then offsets from one row a partition and shard. A
document finds its block by comparing its own (size, id) with the block starts, at most old x new rows, so the texts
are shuffled once, into the files of their new shard, and nothing is joined to them.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxpress.llm.common import materialize, partitions, read, work_dir

_P = "__ctx_"


def min_cost_flow(old: list[int], new: list[int]) -> list[list[int]]:
    """flow[i][j] bytes from old shard i to new shard j: all of ``old`` placed, at most ``new[j]`` in j, least bytes moved.

    Successive shortest paths (by queue, costs may be negative on the way back) over source, old, new, sink.
    """
    if sum(old) > sum(new):
        raise ValueError("the new shards cannot hold the old ones")
    n, m = len(old), len(new)
    source, sink = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, cap, cost = [], [], []

    def edge(a: int, b: int, c: int, w: int) -> None:
        for x, y, r, v in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            cap.append(r)
            cost.append(v)

    for i, x in enumerate(old):
        edge(source, i, x, 0)
    at = {}
    for i in range(n):
        for j in range(m):
            at[i, j] = len(to)
            edge(i, n + j, old[i], int(i != j))
    for j, x in enumerate(new):
        edge(n + j, sink, x, 0)
    while True:
        dist, via = [float("inf")] * len(graph), [-1] * len(graph)
        dist[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if cap[e] and dist[a] + cost[e] < dist[to[e]]:
                    dist[to[e]], via[to[e]] = dist[a] + cost[e], e
                    queue.append(to[e])
        if via[sink] < 0:
            break
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        most = min(cap[e] for e in path)
        for e in path:
            cap[e] -= most
            cap[e ^ 1] += most
    return [[cap[at[i, j] ^ 1] for j in range(m)] for i in range(n)]


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by a byte at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def size_of(text: str = "text") -> Column:
    """UTF-8 bytes (null: none) plus 8."""
    return F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long") + 8


def hashed_shard(shards: int, id_col: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(5)), F.lit(shards)).cast("int")


def running_bytes(sizes: DataFrame, at: str) -> DataFrame:
    """``sizes`` (old, bytes, size, key) with ``before``: the bytes of the rows before it in its old shard, by size down, then key."""
    spark = sizes.sparkSession

    def local(batches):
        import numpy as np
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            old, n_bytes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            before = np.zeros(len(old), np.int64)
            for k in np.unique(old).tolist():
                own = np.flatnonzero(old == k)
                ends = np.cumsum(n_bytes[own]) + held.get(k, 0)
                before[own] = ends - n_bytes[own]
                held[k] = int(ends[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(old), part, np.int32)), pa.array(before)], names=[*batch.schema.names, "part", "local"])

    ordered = sizes.select("old", "bytes", "size", "key").repartitionByRange(partitions(spark), "old", F.desc("size"), "key").sortWithinPartitions("old", F.desc("size"), "key")
    rows = materialize(ordered.mapInArrow(local, "old int, bytes long, size long, key long, part int, local long"), "running", at)
    # a row for each range partition and old shard in it
    totals = rows.groupBy("old", "part").agg(F.sum("bytes").alias("bytes"))
    offset = F.coalesce(F.sum("bytes").over(Window.partitionBy("old").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("old", "part", offset.alias("offset"))
    return rows.join(F.broadcast(offsets), ["old", "part"]).select("old", "bytes", "size", "key", (F.col("local") + F.col("offset")).alias("before"))


def plan_blocks(sizes: DataFrame, old_shards: int, capacities: list[int] | None, new_shards: int, at: str) -> tuple[list, int]:
    """(old, shard, bytes before, size, key) of the first document of each block, in order (at most old x new rows reach the driver), and all bytes."""
    sizes = materialize(sizes.groupBy("old", "size", "key").agg(F.count(F.lit(1)).alias("n")).select("old", (F.col("size") * F.col("n")).alias("bytes"), "size", "key"), "sizes", at)
    found = {r["old"]: r["b"] for r in sizes.groupBy("old").agg(F.sum("bytes").alias("b")).collect()}
    old = [int(found.get(i, 0)) for i in range(old_shards)]
    flow = min_cost_flow(old, capacities or even(sum(old), new_shards))
    spans = []
    for i, row in enumerate(flow):
        stop = 0
        for j in sorted(range(len(row)), key=lambda j: (j != i, j)):  # what stays comes first
            if row[j]:
                spans.append((i, j, stop, stop + row[j]))
                stop += row[j]
    spark = sizes.sparkSession
    if not spans:
        return [], 0
    middle = F.col("before") + F.col("bytes") / 2
    table = F.broadcast(spark.createDataFrame(spans, "old int, shard int, lo long, hi long"))
    placed = running_bytes(sizes, at).join(table, "old").where((middle >= F.col("lo")) & (middle < F.col("hi")))
    firsts = placed.groupBy("old", "shard").agg(F.min(F.struct("before", "size", "key")).alias("x")).collect()
    return sorted((r["old"], r["shard"], r["x"]["before"], r["x"]["size"], r["x"]["key"]) for r in firsts), sum(old)


def block_shard(blocks: list, old: Column, size: Column, key: Column) -> Column:
    """The new shard of a document from the blocks' first documents."""
    per: dict[int, list] = {}
    for o, shard, before, s, k in blocks:
        per.setdefault(o, []).append((before, s, k, shard))
    out = F.lit(0)
    for o, rows in per.items():
        inner = F.lit(sorted(rows, key=lambda r: r[0])[0][3])
        for _, s, k, shard in sorted(rows, key=lambda r: r[0])[1:]:
            inner = F.when((size < s) | ((size == s) & (key >= F.lit(k))), shard).otherwise(inner)
        out = F.when(old == o, inner).otherwise(out)
    return out.cast("int")


def reshard(docs: DataFrame, out: str, old_shards: int = 16, new_shards: int = 24, old: Column | None = None, capacities: list[int] | None = None, files: int | None = None, bytes_a_task: int = 1 << 26) -> DataFrame:
    """Writes ``docs`` as Parquet under ``out/shard=J/moved=true|false`` and gives the files back as a DataFrame.

    ``old``: a document's old shard (default: by hash of its id); a null id is the least. Equal ids and sizes stay together. An empty table
    writes nothing and gives no rows. Extra columns stay; ``shard`` and ``moved`` are replaced.
    """
    spark = docs.sparkSession
    at = work_dir(spark)
    old = hashed_shard(old_shards) if old is None else old
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    blocks, total = plan_blocks(docs.select(old.alias("old"), size_of().alias("size"), key.alias("key")), old_shards, capacities, new_shards, at)
    shard = block_shard(blocks, F.col(f"{_P}old"), size_of(), key)
    placed = docs.drop("shard", "moved").withColumn(f"{_P}old", old).withColumn("shard", shard).withColumn("moved", F.col("shard") != F.col(f"{_P}old"))
    files = files or max(1, -(-partitions(spark) // new_shards), -(-total // (new_shards * bytes_a_task)))
    # ranges of a hash within each shard: tasks of even size however keys hash, and more of them as the shards grow
    placed.drop(f"{_P}old").repartitionByRange(new_shards * files, "shard", "moved", F.xxhash64(key, size_of())).write.partitionBy("shard", "moved").parquet(out)
    schema = docs.drop("shard", "moved").select("*", F.lit(0).alias("shard"), F.lit(False).alias("moved")).schema
    return spark.read.schema(schema).parquet(out)


def with_slots(layout: DataFrame) -> DataFrame:
    """``layout`` with ``slot``: a row's place in its shard, counted over the shard's files in the order of their names."""
    rows = layout.withColumn(f"{_P}file", F.col("_metadata.file_path")).withColumn(f"{_P}row", F.col("_metadata.row_index"))
    files = rows.groupBy("shard", f"{_P}file").agg((F.max(f"{_P}row") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy(f"{_P}file").rowsBetween(Window.unboundedPreceding, -1))
    base = files.select(f"{_P}file", F.coalesce(before, F.lit(0)).alias(f"{_P}base"))  # a row a file
    return rows.join(F.broadcast(base), f"{_P}file").withColumn("slot", F.col(f"{_P}base") + F.col(f"{_P}row")).drop(f"{_P}file", f"{_P}row", f"{_P}base")


def op5_min_cost_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = reshard(read(spark, sf_dir, "documents").select("doc_id", "text"), f"{work_dir(spark)}/shards")
    return with_slots(layout).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size_of().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "moved",
    )
