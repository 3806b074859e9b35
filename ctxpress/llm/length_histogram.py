"""Operator 8: exact length histogram.

Texts are encoded where they lie; a task sends one row for each distinct length, so the shuffle holds a histogram
and no documents. Suffix sums over the histogram then answer totals, quantiles and truncated totals exactly for
every context limit. The histogram has at most one row for each length up to that of the longest document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxpress.llm.common import id_text, read
from ctxpress.llm.encode import encoder, tokenizer_path


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """n_tokens, n_docs for each encoded length. A null text is empty and has length 0; repeated rows all count."""
    path = path or tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(path).encode, Counter()
        for batch in batches:
            seen.update(len(encode(t or "")) // 4 for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(seen), pa.int64()), "n_docs": pa.array(list(seen.values()), pa.int64())})

    partial = id_text(docs).select("text").mapInArrow(count, "n_tokens long, n_docs long")
    return partial.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """For each context limit at which an answer changes its slope (each distinct length):

    n_docs of that length, docs_within and tokens_within (no longer than the limit), docs_beyond and tokens_beyond
    (suffix sums), truncated_tokens (every document cut at the limit), quantile (share of documents within). Between
    two limits truncated_tokens grows by docs_beyond a token: see :func:`answer`. An empty table gives no rows.
    """
    # one row a distinct length: as many as the longest document has tokens at most, however many documents there are
    longer = Window.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.col("n_docs") * F.col("n_tokens")
    sums = histogram.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        F.coalesce(F.sum("n_docs").over(longer), F.lit(0)).alias("docs_beyond"),
        F.coalesce(F.sum(tokens).over(longer), F.lit(0)).alias("tokens_beyond"),
    )
    whole = histogram.agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    within = F.col("docs") - F.col("docs_beyond")
    return sums.crossJoin(F.broadcast(whole)).select(  # one row
        "context_limit",
        "n_docs",
        within.alias("docs_within"),
        "docs_beyond",
        (F.col("tokens") - F.col("tokens_beyond")).alias("tokens_within"),
        "tokens_beyond",
        (F.col("tokens") - F.col("tokens_beyond") + F.col("docs_beyond") * F.col("context_limit")).alias("truncated_tokens"),
        (within / F.col("docs")).alias("quantile"),
    )


def answer(limits: DataFrame, context_limit: int) -> dict[str, int]:
    """docs_within, tokens_within and truncated_tokens at any limit, from the last row at or below it and all rows' sums."""
    at = limits.filter(F.col("context_limit") <= context_limit).agg(F.max_by(F.struct("*"), "context_limit").alias("r")).first()["r"]
    if at is None:  # all documents are longer, or there are none
        beyond = limits.agg(F.max(F.col("docs_beyond") + F.col("n_docs"))).first()[0] or 0
        return {"docs_within": 0, "tokens_within": 0, "truncated_tokens": beyond * context_limit}
    more = at["docs_beyond"] * (context_limit - at["context_limit"])
    return {"docs_within": at["docs_within"], "tokens_within": at["tokens_within"], "truncated_tokens": at["truncated_tokens"] + more}


def quantile(limits: DataFrame, q: float) -> int | None:
    """The least length that at least the share ``q`` of the documents does not exceed; None for an empty table."""
    return limits.filter(F.col("quantile") >= q).agg(F.min("context_limit")).first()[0]


def op8_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_table(length_histogram(read(spark, sf_dir, "documents")))
