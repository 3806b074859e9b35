"""Token counts, paragraphs, sentences and their reassembly as columns: no shuffle, usable in streams."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxpress.functions import patterns as P
from ctxpress.functions import rows

_BLANK = r"(?U)[\s\x1c-\x1f]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{_BLANK}+", ""), rf"{_BLANK}+\z", "")


def token_count(text: Column) -> Column:
    """A token for every four characters, half to even, at least one; none for an empty or null text."""
    n = F.length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.rint(n / 4).cast("int")))


def words(text: Column) -> Column:
    return F.filter(F.split(text, rf"{_BLANK}+"), lambda w: w != "")


def paragraphs(text: Column) -> Column:
    """What blank lines part, stripped; blank paragraphs are left out (null text: none)."""
    return F.filter(F.transform(F.split(strip(F.coalesce(text, F.lit(""))), rf"(?U)\n[\s\x1c-\x1f]*\n"), strip), lambda p: p != "")


def _glue(pieces: Column) -> Column:
    """A piece after one that ends in an abbreviation is joined to it by a blank."""
    last_word = lambda s: F.lower(F.regexp_extract(s, r"(?U)([^\s\x1c-\x1f]+)[\s\x1c-\x1f]*\z", 1))

    def step(done: Column, s: Column) -> Column:
        n = F.size(done)
        last = F.get(done, n - 1)
        joined = F.concat(F.slice(done, F.lit(1), n - 1), F.array(F.concat(last, F.lit(" "), s)))
        return F.when((n > 0) & last_word(last).isin(*P.ABBREVIATIONS), joined).otherwise(F.array_append(done, s))

    short = F.exists(pieces, lambda s: s.endswith(".") & last_word(s).isin(*P.ABBREVIATIONS))  # seldom, and else nothing is copied
    return F.when(short, F.aggregate(pieces, F.array().cast("array<string>"), step)).otherwise(pieces)


def sentences(paragraph: Column) -> Column:
    """The sentences of a paragraph: fenced code stays whole, structural lines too, others end at a mark before a capital."""

    def split(p: Column, blocks: Column) -> Column:
        mark = lambda k: F.concat(F.lit("\0BLOCK"), k.cast("string"), F.lit("\0"))
        # the text between the blocks, with a mark for each block
        between = F.split(p, P.CODE_FENCE)
        held = F.array_join(F.transform(between, lambda s, k: F.concat(s, F.when(k < F.size(blocks), mark(k)).otherwise(F.lit("")))), "")
        lines = F.filter(F.transform(F.split(held, "\n"), strip), lambda x: x != "")
        pieces = F.flatten(F.transform(lines, lambda x: F.when(x.rlike(P.PLAIN + P.STRUCTURAL_LINE), F.array(x)).otherwise(F.split(x, P.PLAIN + P.SENTENCE_GAP))))
        glued = let(F.filter(F.transform(pieces, strip), lambda x: x != ""), _glue)
        back = lambda s: F.aggregate(F.sequence(F.lit(0), F.size(blocks) - 1), s, lambda acc, k: F.replace(acc, mark(k), F.get(blocks, k)))
        whole = F.when(F.size(blocks) > 0, F.transform(glued, back)).otherwise(glued)
        return F.filter(F.transform(whole, strip), lambda x: x != "")

    return let(F.coalesce(paragraph, F.lit("")), lambda p: let(F.regexp_extract_all(p, F.lit(f"({P.CODE_FENCE})"), F.lit(1)), lambda b: split(p, b)))


def document_sentences(text: Column) -> Column:
    """array<struct<p int, s string>>: all sentences in order, each with its paragraph's index."""
    return F.flatten(F.transform(paragraphs(text), lambda p, k: F.transform(sentences(p), lambda s: F.struct(k.alias("p"), s.alias("s")))))


def split_sentences(text: Column) -> Column:
    """As :func:`document_sentences`, by an Arrow function: many times faster, but not for use within a lambda."""
    @F.arrow_udf("array<struct<p:int,s:string>>")
    def run(texts: pa.Array) -> pa.Array:
        out, at, numbers = [], [0], []
        for t in texts.to_pylist():
            own, found = rows.document_sentences_of(t)
            numbers += own
            out += found
            at.append(len(out))
        flat = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), pa.array(out, pa.string())], ["p", "s"])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)

    return run(text)


def sentence_count(text: Column) -> Column:
    """Number of sentences of a text; only numbers come back from the Arrow function."""
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([len(rows.document_sentences_of(t)[1]) for t in texts.to_pylist()], pa.int64())

    return run(text)


_LIST_LINE = r"(?Ud)^\s*(#{1,6}\s|[-*+]\s|\d+[.)]\s)"


def reassemble(kept: Column) -> Column:
    """Text of kept sentences (array as of :func:`document_sentences`): paragraphs apart by a blank line, lists line by line."""

    def paragraph(k: Column, x: Column) -> Column:
        own = F.transform(F.filter(x, lambda s: s["p"] == k), lambda s: s["s"])
        lines = (F.size(own) > 1) & F.forall(own, lambda s: s.rlike(_LIST_LINE))
        return F.when(lines, F.array_join(own, "\n")).otherwise(F.array_join(own, " "))

    return let(kept, lambda x: F.array_join(F.transform(F.array_distinct(F.transform(x, lambda s: s["p"])), lambda k: paragraph(k, x)), "\n\n"))
