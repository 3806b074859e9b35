"""Shared pieces of the corpus operators: working folder, materialisation, Arrow helpers."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the six ASCII blanks; ``bytes.split()`` cuts alike.
WORD_GAP = r"[\x20\x09-\x0D]+"


_scopes: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving every folder that :func:`work_dir` gave out inside: for steps whose result is written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            discard(spark, path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside removes its shuffle files when it ends; else they stay until the driver collects its garbage.

    For steps that are executed once: a second run of the same DataFrame object would make its shuffles anew.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared one the cluster names in ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder serves in local mode (tests); on a cluster that is
    an error, as executors could not see each other's files.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if not base:
        if not conf.get("spark.master", "local").startswith("local") or conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark, "_ctxpress_dir", None) or tempfile.mkdtemp(prefix="ctxpress-")
        spark._ctxpress_dir = base
    path = f"{base.rstrip('/')}/ctxpress-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def few(spark: SparkSession) -> int:
    """Files of a table that holds no texts: an eighth of the shuffle partitions, so that they grow with them."""
    return -(-partitions(spark) // 8)


def materialize(df: DataFrame, name: str = "step", at: str | None = None, files: int | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: cuts the lineage, survives lost executors.

    ``files``: so many at most; the last step of ``df`` then runs in as many tasks, so what is dear there is dealt anew
    before. Each file of a local folder costs its executor two forked processes, as Hadoop sets permissions by ``chmod``.
    """
    spark = df.sparkSession
    df = df if files is None else df.coalesce(files)
    path = f"{at or work_dir(spark)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that :func:`materialize` wrote, once nothing reads it any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def id_text(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (null: empty), so that other columns of the input never clash."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *more,
    )


def fold(mod: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``mod`` (null id: as the text 'null')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % F.lit(mod)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: no rule inlines a lambda's argument, as it does with columns."""
    return F.transform(F.array(value), body)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def giving_back(run):
    """``run(batches)`` of an Arrow function, after which freed memory goes back to the system.

    Python workers live on between tasks beside the executor's JVM; what their allocators keep counts as its memory.
    """

    @functools.wraps(run)
    def task(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
            if trim:
                trim(0)

    return task


def append_columns(df: DataFrame, fields: str, make, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df`` with more columns behind them.

    ``make()`` runs once a task and gives a function from a list of texts (null: empty) to a dict of Arrow arrays
    named as in ``fields`` (a DDL string). The names must be free; callers take the prefix ``__ctx_``.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    extra = StructType.fromDDL(fields)
    at = df.columns.index(text_col)

    def run(batches):
        work = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                found = work([t or "" for t in part.column(at).cast(pa.string()).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, *(found[f.name] for f in extra)], names=[*part.schema.names, *extra.names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *extra.fields]))
