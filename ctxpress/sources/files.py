"""Readers and writers: whole text files, standard input, JSON datasets; texts, JSON results, CSV and Markdown reports."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATASET = "id string, text string, document string, messages array<struct<role:string,content:string>>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): every file is one text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_stdin(spark: SparkSession, stream=None) -> DataFrame:
    """(path, text) of one row: all of standard input."""
    return spark.createDataFrame([("-", (stream or sys.stdin).read())], "path string, text string")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, category) of JSON arrays or objects: text, else document, else the messages' contents; category: the file's name."""
    rows = spark.read.schema(DATASET).json(path, multiLine=True)
    joined = F.array_join(F.transform("messages", lambda m: m["content"]), " ")
    text = F.coalesce(F.nullif("text", F.lit("")), F.nullif("document", F.lit("")), joined, F.lit(""))
    return rows.select("id", text.alias("text"), F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1).alias("category"))


def result_json() -> Column:
    """A result of ``compress`` as JSON without null fields; the ratio has four places."""
    names = ("compressed_text", "original_tokens", "compressed_tokens", "sentences_total", "sentences_kept", "num_chunks", "target_ratio", "reduction_percent")
    return F.to_json(F.struct(*names, F.bround("actual_ratio", 4).alias("actual_ratio")))


def write_texts(df: DataFrame, path: str, column: str = "compressed_text") -> None:
    """One line a row where texts have no line ends; else use :func:`write_json`."""
    df.select(F.coalesce(F.col(column), F.lit("")).alias("value")).write.text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def markdown_report(df: DataFrame, title: str, most: int = 200) -> str:
    """A table of a small result (at most ``most`` rows, which is said)."""
    rows = df.limit(most + 1).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in rows[:most]]
    return "\n".join([*lines, *([f"\nOnly the first {most} rows are shown."] if len(rows) > most else []), ""])


def summary() -> Column:
    """One line about each compressed row."""
    return F.format_string(
        "%d -> %d tokens (%.1f%% fewer), %d of %d sentences kept", F.col("original_tokens").cast("long"), F.col("compressed_tokens").cast("long"), "reduction_percent",
        F.col("sentences_kept").cast("long"), F.col("sentences_total").cast("long"),
    )
