"""The stages of the pipeline on a small table with nulls, repeats and empty texts, and over whole tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from ctxpress.llm.common import read, temporary, work_dir

SF = "/root/testdata/sf0.001"


def test_each_stage_keeps_columns_and_takes_hard_rows(spark):
    docs = read(spark, SF, "documents")
    hard = docs.limit(6).withColumn("text", F.element_at(F.array(F.lit(None).cast("string"), F.lit(""), F.lit("a b")), (F.monotonically_increasing_id() % 3 + 1).cast("int")))
    nulls = docs.limit(2).select(*(F.lit(None).cast(t).alias(c) for c, t in docs.dtypes))
    mixed = docs.unionByName(docs.limit(20)).unionByName(hard).unionByName(nulls)
    for source in (mixed, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, source, SF)
            if name != "packing":
                assert out.columns == docs.columns and out.count() <= source.count(), name
            else:
                assert out.count() >= source.count()


def test_run_is_the_stages_in_order(spark):
    docs = read(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    want = {r["doc_id"] for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == want and len(want) > 50
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_temporary_folders_go(spark):
    with temporary(spark):
        path = work_dir(spark)
        spark.range(3).write.parquet(path)
        assert Path(path.removeprefix("file:")).exists()
    assert not Path(path.removeprefix("file:")).exists()
