"""How close a shortened text is to its original, as columns over word sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxpress.functions import rows
from ctxpress.functions.text import let, words

_P = "__ctx_"


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(F.coalesce(text, F.lit("")))))


def _of_sets(a: Column, b: Column, body) -> Column:
    return let(word_set(a), lambda x: let(word_set(b), lambda y: body(x, y)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; 0 without any."""
    return _of_sets(a, b, lambda x, y: F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0)))


def rouge1(original: Column, shortened: Column) -> Column:
    """F1 of the words the two texts share; 0 without any."""

    def f1(x: Column, y: Column) -> Column:
        return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)), F.lit(0.0))

    return _of_sets(original, shortened, f1)


def overlap(original: Column, shortened: Column) -> Column:
    """Share of the original's words that are left; 0 without any."""
    return _of_sets(original, shortened, lambda x, y: F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(x)), F.lit(0.0)))


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))


def ngrams(words_: Column, n: int) -> Column:
    """All runs of ``n`` items, as strings."""
    last = F.size(words_) - n
    return F.when(last < 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words_, i + 1, n), " ")))


def bleu4(original: Column, shortened: Column) -> Column:
    """Clipped precision of one to four words with a brevity penalty; 0 where one text has no words or the second fewer than four.

    By an Arrow function, as counting n-grams of two long texts is linear there and quadratic in array functions.
    """
    return _of_tokens(original, shortened, _bleu4)


def _of_tokens(original: Column, shortened: Column, of) -> Column:
    """A figure of the tokens (as of :func:`tokens`) of two texts; null counts as empty."""
    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        find = rows.tokens_finder()
        return pa.array([of(find(x or ""), find(y or "")) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return run(original, shortened)


#: From so many words on n-grams are counted as numbers in arrays; a power of four of the number of words must fit them.
_MANY, _MOST_WORDS = 120, 50_000


def _bleu4(ref: list[str], cand: list[str]) -> float:
    import math

    if not ref or len(cand) < 4:
        return 0.0
    total = 0.0
    for n, hits in enumerate(_shared_grams(ref, cand), 1):
        total += math.log((hits + 0.1) / (len(cand) - n + 1 + 0.1))
    penalty = 1.0 if len(cand) > len(ref) else math.exp(1 - len(ref) / len(cand))
    return round(penalty * math.exp(total / 4), 4)


def _shared_grams(ref: list[str], cand: list[str]) -> list[int]:
    """For one to four words: how many n-grams of ``cand``, each as often as it occurs in both at most, ``ref`` has too."""
    number: dict[str, int] = {}
    put = number.setdefault
    a, b = ([put(w, len(number)) for w in x] for x in (ref, cand))
    if len(ref) + len(cand) >= _MANY and len(number) <= _MOST_WORDS:
        return _shared_numbers(np.array(a), np.array(b), len(number))
    out = []
    for n in range(1, 5):
        of_a, of_b = (set(zip(*(x[k:] for k in range(n)))) for x in (a, b))
        if len(of_b) == len(b) - n + 1:  # each once
            out.append(len(of_a & of_b))
            continue
        have: dict = {}
        for g in zip(*(b[k:] for k in range(n))):
            have[g] = have.get(g, 0) + 1
        hits = 0
        for g in zip(*(a[k:] for k in range(n))):
            if left := have.get(g, 0):
                hits, have[g] = hits + 1, left - 1
        out.append(hits)
    return out


def _shared_numbers(a: np.ndarray, b: np.ndarray, base: int) -> list[int]:
    out, x, y = [], a, b
    for n in range(1, 5):
        if n > 1:
            x, y = x[:-1] * base + a[n - 1 :], y[:-1] * base + b[n - 1 :]
        # of a sorted row of both the ends of equal runs; the lower bit tells the side
        both = np.concatenate([x << 1, (y << 1) | 1])
        both.sort()
        gram = both >> 1
        end = np.flatnonzero(np.append(gram[1:] != gram[:-1], True))
        of_b = np.cumsum(both & 1)[end]
        n_b = np.diff(of_b, prepend=0)
        out.append(int(np.minimum(n_b, np.diff(end, prepend=-1) - n_b).sum()))
    return out


def rouge_l(original: Column, shortened: Column) -> Column:
    """F1 of the longest common subsequence of words, by an Arrow function with bit vectors (a word of the machine holds many cells)."""
    return _of_tokens(original, shortened, _rouge_l)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a row of the table is the bits of one integer."""
    where: dict[str, int] = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _rouge_l(ref: list[str], cand: list[str]) -> float:
    if not ref or not cand:
        return 0.0
    rest = iter(ref)
    # a text without some of its sentences is itself such a subsequence, which one walk shows
    k = len(cand) if all([w in rest for w in cand]) else lcs_length(ref, cand)
    return round(2 * k / (len(ref) + len(cand)), 4)


_FIGURES = ("bleu4", "rouge1", "rouge_l", "jaccard", "entity_retention", "instruction_retention")


def quality(df: DataFrame, original: str = "text", shortened: str = "compressed_text") -> DataFrame:
    """``df`` with ``quality``: struct of bleu4, rouge1, rouge_l, jaccard, entity_retention, instruction_retention, reduction_percent.

    All but the last come from one Arrow function, text by text, so each text is read once and its words are not kept as columns.
    """
    from ctxpress.functions.text import token_count
    from ctxpress.operators.validation import HINT, found_finder

    @F.arrow_udf("struct<" + ",".join(f"{k}:double" for k in _FIGURES) + ">")
    def run(originals: pa.Array, others: pa.Array) -> pa.Array:
        find, (find_instructions, find_entities) = rows.tokens_finder(), found_finder()
        share = lambda x, y: len(x & y) / len(x) if x else 1.0
        out: list[tuple] = []
        for x, y, there in zip(originals, others, rows.matches(originals, HINT), strict=True):
            a, b = x.as_py(), y.as_py()
            ref, cand = find(a), find(b)
            u, v = set(a.lower().split()), set(b.lower().split())
            k = len(u & v)
            out.append((
                _bleu4(ref, cand), 2.0 * k / (len(u) + len(v)) if u or v else 0.0, _rouge_l(ref, cand), k / (len(u) + len(v) - k) if u or v else 0.0,
                share(find_entities(a), find_entities(b)), share(find_instructions(a), find_instructions(b)) if there else 1.0,
            ))
        columns = zip(*out) if out else [()] * len(_FIGURES)
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], list(_FIGURES))

    a, b = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (original, shortened))
    n, m = token_count(a), token_count(b)
    reduction = F.when(n > 0, F.bround((1 - m / n) * 100, 1)).otherwise(0.0)
    found = df.withColumn(f"{_P}q", run(a, b))
    return found.withColumn("quality", F.struct(*(F.col(f"{_P}q")[k].alias(k) for k in _FIGURES), reduction.alias("reduction_percent"))).drop(f"{_P}q")


def averages(df: DataFrame, *by: str) -> DataFrame:
    """Mean of every figure of ``quality`` by the given columns, with the number of rows."""
    figures = df.schema["quality"].dataType.names
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"quality.{c}").alias(c) for c in figures))


def totals(df: DataFrame, *by: str, original: str = "original_tokens", compressed: str = "compressed_tokens") -> DataFrame:
    """Tokens before and after, saved tokens and percent, by the given columns and above them (rollup; null: all)."""
    sums = df.rollup(*by).agg(F.sum(original).alias("original_tokens"), F.sum(compressed).alias("compressed_tokens"))
    saved = F.col("original_tokens") - F.col("compressed_tokens")
    return sums.withColumn("tokens_saved", saved).withColumn("saved_percent", F.when(F.col("original_tokens") > 0, F.bround(saved / F.col("original_tokens") * 100, 1)).otherwise(0.0))


def against_baselines(measured: DataFrame, baselines: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """metric, baseline, actual, change_percent, status: ``measured`` (metric, actual) joined with ``baselines`` (metric,
    baseline, higher_is_better); PASS at or beyond the baseline, WARN within ``tolerance`` of it, else FAIL. Both are small."""
    change = F.when(F.col("baseline") != 0, (F.col("actual") - F.col("baseline")) / F.abs("baseline")).otherwise(0.0)
    gain = F.when(F.col("higher_is_better"), change).otherwise(-change)
    status = F.when(gain >= 0, "PASS").when(gain >= -tolerance, "WARN").otherwise("FAIL")
    return measured.join(baselines, "metric").select("metric", "baseline", "actual", F.bround(change * 100, 1).alias("change_percent"), status.alias("status"))
