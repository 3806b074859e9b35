"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Rows that a stage keeps have all columns of ``documents``; the last stage gives the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ctxpress.llm.common import discard, fold, read, temporary, work_dir
from ctxpress.llm.decontaminate import decontaminate
from ctxpress.llm.near_dedup import near_dedup_filter
from ctxpress.llm.packing import pack_documents
from ctxpress.llm.quality import quality_filter
from ctxpress.llm.toxicity import toxicity_filter
from ctxpress.runtime import ensure_importable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go (operator 4)."""
    return quality_filter(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go (operator 6); labels are learnt from the same rows as in its query."""
    return toxicity_filter(docs, read(spark, sf_dir, "labels"), fold(3) != 1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (operator 7)."""
    return near_dedup_filter(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of ``benchmark`` go (operator 10)."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences (operator 9)."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Training a classifier and encoding texts are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole ``documents`` table.

    A stage's own tables, and its input if an earlier stage wrote that, are deleted once its output is written; the last
    output stays, as the result reads it. Of an empty table come no rows. Nulls and repeated rows are dealt with as the
    operators state.
    """
    ensure_importable(spark)
    docs, at, before = read(spark, sf_dir, "documents"), work_dir(spark), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{at}/{k}-{name}"
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
