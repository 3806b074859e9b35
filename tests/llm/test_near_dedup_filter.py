"""What the filter of near duplicates keeps, and what it leaves on disk while whole rows are moved."""

from __future__ import annotations

import time
from pathlib import Path

import pytest

from ctxpress.llm.common import read, shuffles_removed, temporary
from ctxpress.llm.near_dedup import near_dedup_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shuffled(spark):
    """Joins by shuffles, as on tables too large to broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


def _shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for k in range(files.size()) if (n := files.apply(k).getName()).startswith("shuffle_") and n.endswith(".data")}


def _left(spark, before: set[str], seconds: float = 10) -> set[str]:
    """Shuffle files besides ``before``; they are removed in the background."""
    end = time.time() + seconds
    while (left := _shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    return left


def test_only_the_kept_list_is_left_before_whole_rows_are_moved(spark, shuffled):
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file:"))
    tables, files = set(shared.rglob("*.parquet")), _shuffle_files(spark)
    with temporary(spark):
        out = near_dedup_filter(read(spark, SF, "documents"))
        assert {p.parent.name for p in set(shared.rglob("*.parquet")) - tables} == {"kept"}
        assert not _left(spark, files)
        assert out.count() > 50
    assert set(shared.rglob("*.parquet")) <= tables
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(key) == "false"
    spark.conf.set(key, "true")
    with shuffles_removed(spark):
        pass
    assert spark.conf.get(key) == "true"
    spark.conf.unset(key)


def test_whole_rows_are_moved_once(spark, shuffled):
    with temporary(spark):
        plan = near_dedup_filter(read(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2, plan  # the documents and the list of kept rows


@pytest.mark.parametrize("broadcast", [True, False])
def test_one_row_of_each_group_with_null_and_repeated_ids(spark, request, broadcast):
    if not broadcast:
        request.getfixturevalue("shuffled")
    x, y, z = "a b c d e f g", "p q r s t u v", "one two three four five six"
    rows = [(1, x, "m"), (1, x, "m"), (2, x, "n"), (None, y, "o"), (None, y, "o"), (0, y, "q"), (3, None, "r"), (4, "", "s"), (5, z, "t"), (5, z + " seven" * 9, "u"), (0, z + " eight" * 9, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string").repartition(3)
    out = near_dedup_filter(docs)
    assert out.columns == docs.columns
    want = [(1, x, "m"), (None, y, "o"), (3, None, "r"), (5, z, "t"), (5, rows[9][1], "u"), (0, rows[10][1], "v")]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
