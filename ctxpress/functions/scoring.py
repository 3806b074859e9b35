"""Signals of a sentence as columns: instructions, entities, priority, protection, position, length."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxpress.functions import patterns as P
from ctxpress.functions.rows import entities_finder
from ctxpress.functions.text import let, words


def instruction_score(s: Column) -> Column:
    """0.4 a signal, 0.9 at most; code adds 0.4; 1 at most."""
    signals = F.least(P.n_found(s, P.any_of(P.INSTRUCTION)) * 0.4, F.lit(0.9))
    return F.least(F.lit(1.0), signals + F.when(s.rlike(P.PLAIN + P.CODE_SPAN), 0.4).otherwise(0.0))


def entity_count(s: Column) -> Column:
    """Distinct places at which an entity of any kind begins. By an Arrow function: a union of places of many expressions
    takes array functions time that grows with the square of their number."""
    @F.arrow_udf("int")
    def run(texts: pa.Array) -> pa.Array:
        found = entities_finder()(["" if t is None else t for t in texts.to_pylist()])
        return pa.array([None if gone else n for n, gone in zip(found, texts.is_null().to_pylist(), strict=True)], pa.int32())

    return run(s)


def entity_score(s: Column, count: Column | None = None) -> Column:
    """Share of entities among the words (threefold) and their number, each 0.8 at most; 1 at most; 0 without words."""
    n, c = F.size(words(s)), entity_count(s) if count is None else count
    return let(c, lambda c: F.when((n == 0) | (c == 0), 0.0).otherwise(F.least(F.lit(1.0), F.least(3.0 * c / n, F.lit(0.8)) + F.least(0.3 * c, F.lit(0.8)))))


def user_pattern(patterns: tuple[str, ...]) -> str:
    """User expressions (Java dialect), any of which protects a sentence, whatever its case."""
    return "(?Uidu)" + "|".join(f"(?:{p})" for p in patterns)


def priority(s: Column, preserve: tuple[str, ...] = (), entity: Column | None = None) -> Column:
    """4 protected or safety, 3 role or obligation, 2 format, step or entities, 1 prose."""
    entity = F.when(entity_count(s) > 0, 1.0).otherwise(0.0) if entity is None else entity  # any entity is worth 0.3
    top = s.rlike(P.any_of(P.SAFETY))
    top = top | s.rlike(user_pattern(preserve)) if preserve else top
    return F.when(top, 4).when(s.rlike(P.any_of(P.HIGH)), 3).when(s.rlike(P.any_of(P.MEDIUM)) | (entity >= 0.3), 2).otherwise(1)


def must_keep(s: Column, preserve: tuple[str, ...] = ()) -> Column:
    kept = s.rlike(P.PLAIN + P.CODE_SPAN) | s.rlike(P.any_of(P.CRITICAL))
    return kept | s.rlike(user_pattern(preserve)) if preserve else kept


def length_penalty(s: Column, least: int = 4) -> Column:
    return F.when(F.size(words(s)) < least, 0.5).otherwise(0.0)
