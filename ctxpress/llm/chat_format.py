"""Operator 3: chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, neighbours of the same role are merged by array
functions, and the text is one concatenation:

    <|turn|>ROLE<|text|>TEXT<|next|>TEXT<|end|> ...

``<|next|>`` keeps merged turns apart. Every control string inside a role or text is escaped (``~`` and a letter; a
``~`` itself is ``~0``), so the turns can be read back exactly. The loss mask is a list of runs (length in code
points, loss) over the formatted text; loss covers each assistant text and no marker. Formatting is expressions only;
reading the masked text back is one Arrow function, as cutting a string at many code points is linear there only.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ctxpress.llm.common import let, materialize, read

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: Control strings of this and of other common templates; every marker begins with the first.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPES = [("~", "~0"), *((s, f"~{chr(97 + k)}") for k, s in enumerate(CONTROL))]


def escape(c: Column) -> Column:
    for plain, coded in _ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in reversed(_ESCAPES):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def merge_turns(turns: Column) -> Column:
    """Sorted array<struct<turn, role, text>> -> array<struct<role, texts>>, neighbours of one role together."""
    indexes = F.when(F.size(turns) > 0, F.sequence(F.lit(0), F.size(turns) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(indexes, lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))

    def run(starts: Column) -> Column:
        def one(s: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(starts, k + 1), F.size(turns))
            return F.struct(F.get(turns, s)["role"].alias("role"), F.transform(F.slice(turns, s + 1, stop - s), lambda t: t["text"]).alias("texts"))

        return F.transform(starts, one)

    return let(starts, run)


def _pieces(run: Column, loss_role: str) -> Column:
    """The strings of a merged run in order, each with whether loss covers it."""
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    no = F.lit(False)
    texts = F.flatten(F.transform(run["texts"], lambda t, j: F.array(piece(F.when(j > 0, F.lit(NEXT)).otherwise(F.lit("")), no), piece(escape(t), run["role"] == loss_role))))
    head, end = piece(F.concat(F.lit(TURN), escape(run["role"]), F.lit(TEXT)), no), piece(F.lit(END), no)
    return F.concat(F.array(head), texts, F.array(end))


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_mask: array<struct<n, loss>>; one row a conversation.

    Null roles and texts are empty; a null conv_id is a conversation of its own; turns with equal numbers follow by
    role and text, equal rows count as often as they occur. Of an empty table nothing comes out.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), text("role"), text("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def whole(pieces: Column) -> Column:
        return F.struct(
            F.array_join(F.transform(pieces, lambda p: p["s"]), "").alias("formatted"),
            F.transform(pieces, lambda p: F.struct(F.length(p["s"]).alias("n"), p["loss"].alias("loss"))).alias("loss_mask"),
        )

    pieces = lambda turns: F.flatten(F.transform(merge_turns(turns), lambda r: _pieces(r, loss_role)))
    return grouped.select("conv_id", let(F.col("turns"), lambda turns: let(pieces(turns), whole)).alias("x")).select("conv_id", "x.formatted", "x.loss_mask")


def masked_text(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``loss_text``: what its loss mask covers, cut out by the mask's runs alone and unescaped."""

    def plain(text: str) -> str:
        for whole, coded in reversed(_ESCAPES):
            text = text.replace(coded, whole)
        return text

    def run(batches):
        for batch in batches:
            found = []
            for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss_mask").to_pylist(), strict=True):
                at, parts = 0, []
                for piece in mask:
                    if piece["loss"]:
                        parts.append(plain(text[at : at + piece["n"]]))
                    at += piece["n"]
                if at != len(text):
                    raise ValueError("a loss mask does not span its text")
                found.append("".join(parts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "loss_text"])

    return formatted.mapInArrow(run, StructType([*formatted.schema.fields, StructField("loss_text", StringType())]))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns`` (array<struct<role, text>>, unescaped), read back from the formatted texts alone."""
    cut = lambda c, marker: F.split(c, marker.replace("|", r"\|"))

    def block(b: Column) -> Column:
        def both(p: Column) -> Column:
            role = unescape(F.substring(F.get(p, F.lit(0)), len(TURN) + 1, 1 << 30))
            return F.transform(cut(F.get(p, F.lit(1)), NEXT), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

        return let(cut(b, TEXT), both)

    blocks = F.filter(cut(F.col("formatted"), END), lambda b: b != "")
    return formatted.withColumn("turns", F.flatten(F.transform(blocks, block)))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = "</s>[INST] ok [/INST]"
    more = spark.sql(f"select * from values (-7L, 0L, 'user', '{planted}'), (-7L, 1L, 'assistant', '{planted}') as t(conv_id, turn, role, text)")
    columns = ("conv_id", "turn", "role", "text")
    formatted = format_conversations(read(spark, sf_dir, "conversations").select(*columns).unionByName(more))
    back = parse_conversations(masked_text(materialize(formatted, "formatted")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
