"""Checks of a rewritten text against its original, as columns: structure, instructions, entities, similarity, keywords."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxpress.functions import rows
from ctxpress.functions.patterns import any_of
from ctxpress.functions.text import let, strip, token_count

# What counts as an instruction or an entity in a rewrite, and the least values that pass.
INSTRUCTION = (
    r"\bmust\b", r"\bshall\b", r"\bshould\b", r"\bensure\b", r"\bmake sure\b", r"\bneed(?:s)? to\b", r"\brequire[sd]?\b", r"\bnever\b",
    r"\bdo not\b", r"\bdon't\b", r"\bavoid\b", r"\balways\b", r"\bimportant\b", r"\bcritical\b", r"\byou are\b", r"\bact as\b",
    r"\byour role\b", r"\brespond in\b", r"\bformat (?:as|your|the|in)\b", r"\bJSON\b", r"\bYAML\b",
    r"^(?:WARNING|CAUTION|IMPORTANT|NOTE)\s*:", r"^(?:System|Instructions?|Rules?|Guidelines?)\s*:",
)
ENTITY = (
    ("", r"\b[A-Z][a-zA-Z]{2,}\b"),
    ("", r"\b[A-Z]{2,}[0-9]*\b"),
    ("", r"https?://\S+"),
    ("", r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"),
    ("", r"`[^`\n]+`"),
    ("iu", r"\b\w+\.(?:py|js|ts|json|yaml|yml|toml|md|html|css|xml)\b"),
    ("", r"\b[A-Z][A-Z0-9_]{2,}\b"),
    ("", r"\bv?\d+\.\d+(?:\.\d+)?\b"),
)
MIN_SIMILARITY, MIN_INSTRUCTIONS, MIN_ENTITIES, SHORTEST = 0.6, 0.8, 0.7, 0.10


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def instructions(text: Column) -> Column:
    """The distinct instruction words of a text, in lower case."""
    found = _matches(text, "(?Udmiu)" + "|".join(f"(?:{p})" for p in INSTRUCTION))
    return F.array_distinct(F.transform(found, lambda x: F.lower(strip(x))))


def entities(text: Column) -> Column:
    """The distinct names and identifiers of a text."""
    return F.array_distinct(F.flatten(F.array(*(_matches(text, f"(?Ud{flags})" + p) for flags, p in ENTITY))))


def found_finder():
    """Two functions from a text to the set of its instruction words and to that of its names and identifiers: in plain
    Python what :func:`instructions` and :func:`entities` are as columns."""
    import regex

    some_instruction = any_of(INSTRUCTION, "")
    spelt, pair, digit = rows.spelt, re.compile(r"[A-Z][A-Z0-9_]").search, re.compile(r"\d\.\d").search
    suffix = re.compile(ENTITY[5][1].removeprefix(r"\b\w+"), re.I).search
    plain = re.compile(spelt(some_instruction), re.I | re.M).finditer
    own = [re.compile(rows.from_capital(spelt(p)), re.I if flags else 0).findall for flags, p in ENTITY]
    cache: list = []

    def odd() -> list:
        if not cache:
            cache.append(regex.compile(spelt(some_instruction, True), regex.I | regex.M).finditer)
            cache.append([regex.compile(spelt(p, True), regex.I if flags else 0).findall for flags, p in ENTITY])
        return cache

    def find_instructions(text: str) -> set[str]:
        folded = text
        if strange := rows.is_odd(text):
            folded = text.translate(rows.FOLD)
        return {text[m.start() : m.end()].strip().lower() for m in (odd()[0] if strange else plain)(folded)}

    def find_entities(text: str) -> set[str]:
        if rows.is_odd(text):
            return {x for find in odd()[1] for x in find(text)}
        out = set(own[0](text))
        if pair(text):
            out.update(own[1](text), own[6](text))
        for k, there in ((2, "://" in text), (3, "_" in text), (4, "`" in text), (5, "." in text and suffix(text)), (7, digit(text))):
            if there:
                out.update(own[k](text))
        return out

    return find_instructions, find_entities


#: Without this (RE2) a text holds no instruction word.
HINT = rows.hint(INSTRUCTION)


def kept_share(wanted: set[str], text: str) -> float:
    return sum([w in text for w in wanted]) / len(wanted) if wanted else 1.0


def retentions(original: Column, rewrite: Column) -> Column:
    """Struct of instruction_retention and entity_retention: the shares of the original's instruction words (in lower case)
    and names that the rewrite contains. No null texts."""
    @F.arrow_udf("struct<inst:double,ent:double>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        find_instructions, find_entities = found_finder()
        inst, ent = [], []
        for x, y, there in zip(a.to_pylist(), b.to_pylist(), rows.matches(a, HINT), strict=True):
            inst.append(kept_share(find_instructions(x), y.lower()) if there else 1.0)
            ent.append(kept_share(find_entities(x), y))
        return pa.StructArray.from_arrays([pa.array(inst, pa.float64()), pa.array(ent, pa.float64())], ["inst", "ent"])

    return run(original, rewrite)


def retention(wanted: Column, text: Column) -> Column:
    """Share of the strings ``wanted`` that a text contains; 1 if there are none."""
    return let(wanted, lambda w: F.when(F.size(w) == 0, 1.0).otherwise(F.size(F.filter(w, lambda x: text.contains(x))) / F.size(w)))


def tfidf_cosine(a: list[str], b: list[str]) -> float | None:
    """Cosine of two texts' term weights, each other's only corpus, from their terms; null without any term."""
    if not a and not b:
        return None
    one, two = Counter(a), Counter(b)
    both, rare = one.keys() & two.keys(), (math.log(1.5) + 1) ** 2
    dot, norm = sum([one[t] * two[t] for t in both]), 1.0
    for c in (one, two):
        shared = sum([c[t] ** 2 for t in both])
        norm *= math.sqrt(shared + rare * (sum([n * n for n in c.values()]) - shared))
    return max(0.0, min(1.0, dot / norm)) if norm else 0.0


def similarity(original: Column, rewrite: Column) -> Column:
    """Term-weight cosine by an Arrow UDF; of texts without terms the share of the original's words; 0 if one is blank."""
    from pyspark.ml.feature import StopWordsRemover

    from ctxpress.operators.metrics import overlap

    stop = frozenset(StopWordsRemover.loadDefaultStopWords("english"))

    @F.arrow_udf("double")
    def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
        terms = rows.terms_finder(stop)
        return pa.array([None if x is None or y is None else tfidf_cosine(terms([x])[0], terms([y])[0]) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    blank = (strip(original) == "") | (strip(rewrite) == "")
    return F.when(blank, 0.0).otherwise(F.coalesce(cosine(original, rewrite), overlap(original, rewrite)))


def structure_problems(original_tokens: Column, rewrite_tokens: Column, rewrite: Column) -> Column:
    """What is wrong with a rewrite's size: array of strings, empty if nothing is."""
    empty = strip(rewrite) == ""
    longer = F.when(~empty & (rewrite_tokens > original_tokens), F.format_string("Rewrite inflated tokens (%d > %d)", rewrite_tokens, original_tokens))
    short = ~empty & (original_tokens > 0) & (rewrite_tokens < original_tokens * SHORTEST)
    share = F.bround(rewrite_tokens * 100.0 / original_tokens, 0).cast("int")
    tiny = F.when(short, F.format_string("Rewrite is suspiciously short (%d/%d tokens = %d%%)", rewrite_tokens, original_tokens, share))
    return F.array_compact(F.array(F.when(empty, F.lit("Rewrite is empty")), longer, tiny))


def validate(
    original: Column, rewrite: Column, keywords: tuple[str, ...] = (), similarity_of=similarity,
    min_similarity: float = MIN_SIMILARITY, min_instructions: float = MIN_INSTRUCTIONS, min_entities: float = MIN_ENTITIES,
) -> Column:
    """Struct: passed, similarity, instruction_retention, entity_retention, token_reduction, keyword_retention, failures.

    ``similarity_of``: any function of two columns that gives a double. Null texts count as empty.
    """
    a, b = (F.coalesce(c.cast("string"), F.lit("")) for c in (original, rewrite))
    n, m = token_count(a), token_count(b)
    low, kept = F.lower(b), retentions(a, b)
    missing = F.filter(F.array(*map(F.lit, keywords)).cast("array<string>"), lambda k: ~low.contains(F.lower(k)))
    # plain expressions, so that figures nobody reads are not computed
    wrong, ratio = structure_problems(n, m, b), F.when(strip(b) == "", 0.0).otherwise(m / F.greatest(n, F.lit(1)))
    inst, ent, sim = kept["inst"], kept["ent"], similarity_of(a, b)
    share = 1.0 - F.size(missing) / max(1, len(keywords))
    failures = F.concat(wrong, F.array_compact(F.array(
        F.when(inst < min_instructions, F.format_string("Instruction retention too low: %.2f", inst)),
        F.when(ent < min_entities, F.format_string("Entity retention too low: %.2f", ent)),
        F.when(sim < min_similarity, F.format_string("Similarity too low: %.3f", sim)),
        F.when(F.size(missing) > 0, F.concat(F.lit("Missing required keywords: "), F.array_join(missing, ", "))),
    )))
    return F.struct(
        (F.size(failures) == 0).alias("passed"), F.bround(sim, 4).alias("similarity"), inst.alias("instruction_retention"), ent.alias("entity_retention"),
        F.bround(ratio, 4).alias("token_reduction"), F.bround(share, 4).alias("keyword_retention"), failures.alias("failures"),
    )
