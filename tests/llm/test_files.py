"""Tables without texts are few files, whatever the number of shuffle partitions."""

from __future__ import annotations

from pathlib import Path

import pytest

from ctxpress.llm import near_dedup, token_files
from ctxpress.llm.common import read, work_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture
def dealt_out(spark):
    """Many shuffle partitions that Spark does not merge; gives the Parquet files by table that come below the shared folder."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(shared.rglob("*.parquet"))

    def written() -> dict[str, int]:
        found: dict[str, int] = {}
        for p in set(shared.rglob("*.parquet")) - before:
            if p.is_file():
                found[p.parent.name] = found.get(p.parent.name, 0) + 1
        return found

    yield written
    for k, v in old.items():
        spark.conf.set(k, v)


def test_token_files_manifest_is_one_file(spark, dealt_out):
    docs = read(spark, SF, "documents")
    manifest = token_files.write_token_files(docs, work_dir(spark))
    assert dealt_out()["manifest"] == 1 and manifest.count() > 10
    back = token_files.read_token_files(manifest)
    assert back.rdd.getNumPartitions() < 20
    rows = sorted(back.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))


def test_near_dedup_id_tables_are_few_files(spark, dealt_out):
    near_dedup.near_duplicates(read(spark, SF, "documents")).collect()
    found = dealt_out()
    assert {"members", "needed", "nodes", "links0", "links", "labelled1", "hard1", "named"} <= set(found)
    assert all(n <= 5 for name, n in found.items() if name not in ("sketch", "texts")), found
