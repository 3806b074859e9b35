"""Operator 10 (native): benchmark decontamination by size-partitioned MinHash containment search.

A document and a test item are sets of 64-bit hashes of their five-word shingles. Documents are partitioned by the
size of their set (powers of two), and a partition's sketch is a one-permutation MinHash whose number of registers
follows the partition's upper size bound: the top bits of a hash choose the register, the least hash of a register is
its minimum. So a short item inside a long document still meets its own shingles as minima; with a fixed number of
registers the chance would vanish as documents grow. ``registers`` (a power of two, times the size bound) sets how
many of a document's shingles stay minima: at 2 at least 78 %, so an item that shares k shingles is missed with a
probability of at most 0.22**k; items of few shingles take the exact path: for them all shingles of the documents
are probed.

Candidates (a document and an item that share a minimum) are verified exactly, on the shingles' words: containment is
the share of the item's distinct shingles that the document has. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxpress.llm.common import WORD_GAP, let, materialize, read, work_dir

WIDTH = 5


def words(text: Column) -> Column:
    """The words of a text (null: none), in order."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), WORD_GAP), lambda w: w != "")


def _windows(text: Column, of) -> Column:
    """``of(words, i)`` for each first index of a shingle of a text; of fewer than five words, one of all; else none."""

    def windows(w: Column) -> Column:
        n = F.size(w)
        return F.transform(F.when(n >= WIDTH, F.sequence(F.lit(0), n - WIDTH)).when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), lambda i: of(w, i))

    return let(words(text), windows)


def hashed_shingles(text: Column) -> Column:
    return _windows(text, lambda w, i: F.xxhash64(*(F.get(w, i + k) for k in range(WIDTH))))


def word_shingles(text: Column) -> Column:
    return F.array_distinct(_windows(text, lambda w, i: F.array_join(F.slice(w, i + 1, WIDTH), " ")))


def sketch(docs: DataFrame, registers: int = 2) -> DataFrame:
    """doc_id, minima: the MinHash minima of each document with an id, its registers by its size class; none without words."""
    keep = 64 - (registers.bit_length() - 1)

    def minima(h: Column, shift: Column) -> Column:
        register = lambda x: F.call_function("shiftrightunsigned", x, shift)
        # ascending hashes hold a register's hashes side by side, its least one first
        return F.filter(h, lambda x, i: (i == 0) | (register(x) != register(F.get(h, i - 1))))

    size_class = lambda h: F.ceil(F.log2(F.greatest(F.size(h), F.lit(1)))).cast("int")
    found = let(F.sort_array(hashed_shingles(F.col("text"))), lambda h: let(F.lit(keep) - size_class(h), lambda shift: minima(h, shift)))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("minima"))


def contained(docs: DataFrame, items: DataFrame, containment: float = 0.8, registers: int = 2, few: int = 8, small: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_found, containment, for all pairs at ``containment`` or more.

    ``docs``: doc_id, text; ``items``: item_id, text. Null texts and texts without words match nothing, rows without
    an id are not reported, repeated ids give the best match once. Tables up to ``small`` rows (counted first: item
    shingles, candidate ids) are broadcast; larger ones are shuffled.
    """
    spark = docs.sparkSession
    at = work_dir(spark)
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tests = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), hashed_shingles(F.col("text")).alias("h"), word_shingles(F.col("text")).alias("shingles"))
    tests = materialize(tests.distinct(), "tests", at).where(F.size("h") > 0)
    n_few = tests.where(F.size("shingles") < few).limit(1).count()
    probes = tests.select("item_id", F.explode(F.array_distinct("h")).alias("h"), (F.size("shingles") < few).alias("few"))
    probes = F.broadcast(probes) if probes.count() <= small else probes

    minima = sketch(lean, registers).select("doc_id", F.explode("minima").alias("h"))
    found = minima.join(probes.where("not few").drop("few") if n_few else probes.drop("few"), "h").select("doc_id", "item_id")
    if n_few:  # items of few shingles: every shingle of a document is probed
        every = lean.where("doc_id is not null").select("doc_id", F.explode(hashed_shingles(F.col("text"))).alias("h"))
        found = found.unionByName(every.join(probes.where("few").drop("few"), "h").select("doc_id", "item_id"))
    pairs = materialize(found.distinct(), "pairs", at)

    ids = pairs.select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= small else ids
    texts = lean.join(ids, "doc_id", "left_semi").select("doc_id", word_shingles(F.col("text")).alias("d"))
    known = tests.select("item_id", F.col("shingles").alias("t"))
    known = F.broadcast(known) if tests.count() <= small else known
    checked = texts.join(pairs, "doc_id").join(known, "item_id")
    checked = checked.select("doc_id", "item_id", F.size("t").cast("long").alias("n_shingles"), F.size(F.array_intersect("t", "d")).cast("long").alias("n_found"))
    best = checked.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_shingles", "n_found"), F.col("n_found") / F.col("n_shingles")).alias("x"))
    share = F.col("x.n_found") / F.col("x.n_shingles")
    return best.select("doc_id", "item_id", "x.n_shingles", "x.n_found", share.alias("containment")).where(F.col("containment") >= containment)


def decontaminate(docs: DataFrame, items: DataFrame, small: int = 1_000_000, **how) -> DataFrame:
    """The rows of ``docs`` that contain no item, with its own columns; rows without an id stay."""
    hits = materialize(contained(docs.select("doc_id", "text"), items, small=small, **how).select(F.col("doc_id").alias("__ctx_id")).distinct(), "hits")
    hits = F.broadcast(hits) if hits.count() <= small else hits
    return docs.join(hits, F.col("doc_id").cast("long") == F.col("__ctx_id"), "left_anti")


def op10_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text")
    return contained(docs, items)


_WORDS = r"regexp_extract_all({0}.text, '[^\x20\x09-\x0D]+')"
_SHINGLES = (
    "list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) "
    "when len(w) > 0 then [array_to_string(w, ' ')] else [] end)"
)
OP10_SQL = f"""
with d as (select doc_id, unnest({_SHINGLES}) as s from (select doc_id, {_WORDS.format('documents')} as w from documents)),
t0 as (select item_id, {_SHINGLES} as l from (select item_id, {_WORDS.format('benchmark')} as w from benchmark)),
t as (select item_id, len(l) as n, unnest(l) as s from t0),
c as (select d.doc_id, t.item_id, t.n, count(*) as k from d join t on d.s = t.s group by 1, 2, 3)
select doc_id, item_id, n::bigint as n_shingles, k::bigint as n_found, k / n as containment from c where k / n >= 0.8
"""
