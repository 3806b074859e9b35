"""Connected components by alternating large and small stars, wholly in DataFrames.

No edge or label reaches the driver, only a count and a checksum an iteration. Each iteration is written to the
shared folder. A hub with a large share of the edges is pre-aggregated to one minimum a task, and its edges stay
dealt by the skew join. Up to ``few`` distinct edges (counted first) one executor task merges sets instead, which
saves the iterations' many small stages; the result is the same.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxpress.llm.common import few as few_files
from ctxpress.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each neighbour (the larger ones of a node, or the smaller ones and itself) to the least of all."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # edges run from the larger node to the smaller one
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _merge(batches):
    """(node, component) of all edges of the task, by merging sets; the component is the least node."""
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    if kind is not None:
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["node", "component"])


def connected(edges: DataFrame, at: str, most: int = 60, few: int = 500_000) -> DataFrame:
    """node, component (its least node) for every node of ``edges`` (a, b; any order, repeats and loops allowed)."""
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialize(links, "links", at, few_files(edges.sparkSession))
    if links.count() <= few:
        kind = dict(links.dtypes)["a"]
        return links.coalesce(1).mapInArrow(_merge, f"node {kind}, component {kind}")
    before = None
    for k in range(most):
        state = links.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state[0] == 0 or tuple(state) == before:
            break
        before = tuple(state)
        links = materialize(_star(_star(links, True), False), f"links{k}", at, few_files(edges.sparkSession))
    else:
        raise RuntimeError(f"components are not stable after {most} iterations")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = nodes.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    return nodes.unionByName(roots)
