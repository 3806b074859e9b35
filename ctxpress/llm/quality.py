"""Operator 4: host-level quality rules.

Each document's own figures and rule failures are counted where its text lies. Failures are then aggregated by host
(map-side first, so one host with a third of all rows is a row a task), each host's rate is shrunk towards an
empirical beta prior (method of moments over all hosts, sampling variance taken off), and the verdict goes back to
the documents:

* ``blocked``: the shrunken rate is ``block_rate`` or more; all documents of the host go;
* ``watched``: it is at least the ``watch_quantile`` of the prior, so the host is worse than most, or at least
  ``watch_rate``; documents that fail any rule go;
* ``trusted``: documents that fail two rules or more go.

A document that fails the base rule goes in any case, and a clean one of a host that is not blocked always stays.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxpress.llm.common import append_columns, materialize, read

_P = "__ctx_"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_NOT_UPPER = bytes(b for b in range(256) if b not in _UPPER)
_NOT_ALPHA = bytes(b for b in range(256) if not bytes([b]).isalpha() and b < 128) + bytes(range(128, 256))
#: The counts of a document, then its rules; each rule is 1 where it fails.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
RULES = ("base", "symbols", "dup_lines", "shouting")


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words in ``width``-word windows that occur twice or more in the text, the first occurrence included."""
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    if len(windows) == len(set(windows)):
        return 0
    seen, total, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + width - max(i, end)
            end = i + width
    return total


def counts(text: str) -> tuple[int, ...]:
    """The figures of ``COUNTS`` and ``RULES`` for one text; an empty one has no words and fails the base rule."""
    raw = text.encode("utf-8")
    words = raw.split()
    n = len(words)
    repeated = repeat_words(words)
    n_lines = n_dup = 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line.strip(_BLANKS):
                n_lines += 1
                n_dup += line in seen
                seen.add(line)
    else:
        n_lines = int(n > 0)
    symbols = sum(map(text.count, _SYMBOLS))
    upper, letters = len(raw.translate(None, _NOT_UPPER)), len(raw.translate(None, _NOT_ALPHA))
    return (
        n, len(text) - sum(map(text.count, _BLANKS)), symbols, n_dup, repeated, n_lines,
        int(n < 10 or 100 * repeated > 20 * n), int(10 * symbols > n), int(10 * n_dup > 3 * n_lines), int(n >= 10 and 2 * upper > letters),
    )


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__ctx_`` columns for COUNTS and RULES, in one pass over the texts."""
    names = [f"{_P}{c}" for c in (*COUNTS, *RULES)]

    def make():
        def run(texts):
            rows = list(zip(*map(counts, texts), strict=True)) or [[]] * len(names)
            return {name: pa.array(list(v), pa.int64()) for name, v in zip(names, rows, strict=True)}

        return run

    return append_columns(docs, ", ".join(f"{n} long" for n in names), make)


def host_verdicts(counted: DataFrame, host_col: str = "source", watch_quantile: float = 0.75, watch_rate: float = 0.5, block_rate: float = 0.9) -> DataFrame:
    """host, n_docs, n_failed (any rule), a failure count for each rule, rate (shrunken), verdict; null hosts are one host, ''."""
    failed = F.greatest(*(F.col(f"{_P}{r}") for r in RULES))
    hosts = counted.groupBy(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(failed).alias("n_failed"), *(F.sum(f"{_P}{r}").alias(f"failed_{r}") for r in RULES)
    )
    hosts = materialize(hosts, "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    one = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n_docs")).alias("i"), F.count(F.lit(1)).alias("n")).first()
    mean, strength = beta_prior(one["m"], one["v"], one["i"])
    watch = min(beta_quantile(mean, strength, watch_quantile), watch_rate)
    shrunk = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return hosts.withColumn("rate", shrunk).withColumn("verdict", F.when(F.col("rate") >= block_rate, "blocked").when(F.col("rate") >= watch, "watched").otherwise("trusted"))


def beta_prior(mean: float | None, variance: float | None, mean_inverse_n: float | None) -> tuple[float, float]:
    """Mean and strength (a + b) of the beta prior; without hosts 0.5 and 1, without spread between hosts strength 1000."""
    if mean is None:
        return 0.5, 1.0
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    spread = (variance or 0.0) - mean * (1 - mean) * (mean_inverse_n or 0.0)
    return mean, min(1000.0, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1000.0


def beta_quantile(mean: float, strength: float, q: float) -> float:
    """The ``q`` quantile of the beta distribution of this mean and strength, by sums over a grid of log odds."""
    z = np.linspace(-60, 60, 240_001)
    low, high = -np.logaddexp(0, -z), -np.logaddexp(0, z)  # logs of x and of 1 - x
    density = mean * strength * low + (1 - mean) * strength * high
    mass = np.cumsum(np.exp(density - density.max()))
    return float(np.exp(low[np.searchsorted(mass, q * mass[-1])]))


def judge(docs: DataFrame, host_col: str = "source", broadcast_hosts: int = 20_000, carry: list[str] | None = None, **rates: float) -> DataFrame:
    """``docs`` (or its columns ``carry``, the host among them) with ``__ctx_`` counts, ``__ctx_verdict`` and ``__ctx_kept``. The host table is broadcast only up to
    ``broadcast_hosts`` rows; beyond, it is a shuffle join that Spark splits for a hot host. A null text is empty and fails the base rule;
    null hosts and '' are one host; hosts of equal rate get one verdict; repeated rows count each; of no rows come none."""
    counted = with_counts(docs)
    if carry is not None:
        counted = counted.select(*carry, *(f"{_P}{c}" for c in (*COUNTS, *RULES)))
    counted = materialize(counted, "counted")
    hosts = host_verdicts(counted, host_col, **rates)
    hosts = hosts.select(F.col("host").alias(f"{_P}host"), F.col("verdict").alias(f"{_P}verdict"), F.col("rate").alias(f"{_P}rate"))
    hosts = F.broadcast(hosts) if hosts.count() <= broadcast_hosts else hosts
    joined = counted.withColumn(f"{_P}host", F.coalesce(F.col(host_col).cast("string"), F.lit(""))).join(hosts, f"{_P}host")
    n_failed = sum((F.col(f"{_P}{r}") for r in RULES), F.lit(0))
    allowed = F.when(F.col(f"{_P}verdict") == "blocked", -1).when(F.col(f"{_P}verdict") == "watched", 0).otherwise(1)
    return joined.withColumn(f"{_P}kept", (F.col(f"{_P}base") == 0) & (n_failed <= allowed))


def quality_filter(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are kept, with its own columns."""
    return judge(docs, **how).filter(f"{_P}kept").select(*docs.columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(docs, carry=["doc_id", "source"]).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.col(f"{_P}{c}").alias(c) for c in COUNTS[:5]),
        (F.col(f"{_P}base") == 1).alias("base_failed"),
        F.col(f"{_P}kept").alias("kept"),
        F.col(f"{_P}verdict").alias("host_verdict"),
    )
