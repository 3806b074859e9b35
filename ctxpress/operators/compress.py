"""Extractive compression of a text column, row by row: no shuffle, so it runs alike on one text and on 100 TB.

One Arrow function over the texts splits them, weighs the terms, cuts the chunks, ranks and selects, as that is sequential
within a document (chunks grow sentence by sentence, selection skips what does not fit); no other column goes through
Python. Only with ``preserve``, whose expressions are Java's, are the sentences and their signals made by column expressions,
with the same results but many times slower. Documents of up to ``min_tokens`` tokens or of one sentence pass unchanged;
JSON, YAML, Markdown and XML may take a path of their own (see ``mode``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxpress.functions import rows
from ctxpress.functions import scoring as S
from ctxpress.functions.content import content_profile
from ctxpress.functions.text import document_sentences, token_count, words
from ctxpress.operators.modes import MODES, get_mode, resolve_mode
from ctxpress.operators.structured import SHORTEN, optimize_structured

# Weights of the signals and limits of the two passes.
WEIGHTS = {"centrality": 0.20, "position": 0.10, "entity": 0.40, "instruction": 0.40, "query": 0.35, "length_penalty": 0.20}
TIER_BONUS, FILL_SLACK, TRIM_SLACK, HALF_NUDGE = 0.20, 25, 15, 0.03
CHUNK_TOKENS, CHUNK_SIMILARITY, MIN_TOKENS = 300, 0.10, 40

_P = "__ctx_"
_ORDER = tuple(WEIGHTS)


@dataclass(frozen=True)
class Settings:
    """How to compress. ``weights`` override single signals; ``preserve``: expressions that protect a sentence; ``mode``: a
    mode's name or ``auto`` (by content type, if ``detect_content``); a ratio of 0.5 gives way to the mode's own."""

    target_ratio: float = 0.5
    query: str | None = None
    min_tokens: int = MIN_TOKENS
    chunk_tokens: int = CHUNK_TOKENS
    chunk_similarity: float = CHUNK_SIMILARITY
    weights: tuple[tuple[str, float], ...] = ()
    preserve: tuple[str, ...] = ()
    mode: str | None = None
    detect_content: bool = False

    def __post_init__(self):
        if not 0 < self.target_ratio <= 1:
            raise ValueError("target_ratio must be above 0 and at most 1")
        if unknown := {k for k, _ in self.weights} - WEIGHTS.keys():
            raise ValueError(f"unknown weights: {sorted(unknown)}")
        if self.mode not in (None, "auto"):
            get_mode(self.mode)

    @property
    def resolved(self) -> bool:
        """Whether a mode decides anything."""
        return self.mode is not None or self.detect_content

    def weights_of(self, mode: str) -> list[float]:
        merged = WEIGHTS | MODES[mode].weights | dict(self.weights)
        return [merged[k] for k in _ORDER]


def term_weights(terms: list[list[str]]) -> list[dict[str, float]]:
    """Rows of unit length: term frequency times smoothed inverse frequency among the rows; all alike without any term."""
    rows: list[dict[str, float]] = []
    df: dict[str, int] = {}
    for row in terms:
        own: dict[str, float] = {}
        for t in row:
            own[t] = own.get(t, 0.0) + 1.0
        for t in own:
            df[t] = df.get(t, 0) + 1
        rows.append(own)
    if not df:
        return [{"": 1.0} for _ in rows]
    logs = {n: math.log((1 + len(rows)) / (1 + n)) + 1 for n in set(df.values())}
    idf = {t: logs[n] for t, n in df.items()}
    for own in rows:
        norm = 0.0
        for t in own:
            own[t] = w = own[t] * idf[t]
            norm += w * w
        norm = math.sqrt(norm)
        for t in own:
            own[t] /= norm
    return rows


def chunk_ids(rows: list[dict[str, float]], tokens: list[int], most: int, similarity: float) -> list[int]:
    """Runs of sentences: a new one begins where the text turns away from the run's mean, or the run is full."""
    out, chunk, held, size, total, square = [], 0, 0, 0, {}, 0.0
    for row, n in zip(rows, tokens, strict=True):
        get = total.get
        dot = sum([w * get(t, 0.0) for t, w in row.items()]) if size else 0.0
        if size:
            alike = dot / math.sqrt(square) if row and square > 0 else 0.0  # a row's own length is 1
            if (alike < similarity and (held >= 15 or size >= 2)) or held + n > most:
                chunk, held, size, total, square, dot = chunk + 1, 0, 0, {}, 0.0, 0.0
        out.append(chunk)
        for t, w in row.items():
            total[t] = total.get(t, 0.0) + w
        held, size, square = held + n, size + 1, square + 2 * dot + (1.0 if row else 0.0)
    return out


def centrality(rows: list[dict[str, float]]) -> list[float]:
    """Mean similarity to the others of the chunk over the greatest such mean."""
    if len(rows) <= 1:
        return [1.0] * len(rows)
    total: dict[str, float] = {}
    for row in rows:
        for t, w in row.items():
            total[t] = total.get(t, 0.0) + w
    shared = [sum([w * (total[t] - w) for t, w in row.items()]) for row in rows]
    shared = [x if x > 1e-12 else 0.0 for x in shared]
    top = max(shared)
    return [x / top for x in shared] if top > 0 else shared


def select(chunk: list[int], tokens: list[int], tier: list[int], score: list[float], bonus: list[float], ratio: float, goal: int) -> list[bool]:
    """Mask of kept sentences: by chunk in proportion, then filled up or trimmed to the goal of the whole text."""
    n = len(tokens)
    kept, chunks = [False] * n, {}
    for i, c in enumerate(chunk):
        chunks.setdefault(c, []).append(i)
    for own in chunks.values():
        room, used = max(1, round(sum([tokens[i] for i in own]) * ratio)), 0
        for i in sorted(own, key=lambda i: (-tier[i], -score[i], i)):
            if tier[i] >= 3 or used + tokens[i] <= room or not used:
                kept[i], used = True, used + tokens[i]
    total = sum([t for t, k in zip(tokens, kept, strict=True) if k])
    if total < goal:
        for i in sorted([i for i in range(n) if not kept[i]], key=lambda i: (-tier[i], -(score[i] + bonus[i]), i)):
            if total + tokens[i] <= goal + FILL_SLACK and total < goal + FILL_SLACK:
                kept[i], total = True, total + tokens[i]
    elif total > goal + TRIM_SLACK:
        for i in sorted([i for i in range(n) if kept[i] and tier[i] < 4], key=lambda i: (tier[i], score[i], i)):
            if total - tokens[i] >= goal:
                kept[i], total = False, total - tokens[i]
    return kept


_CHUNK = pa.struct([("text", pa.string()), ("original_tokens", pa.int32()), ("compressed_tokens", pa.int32()), ("sentences_total", pa.int32()), ("sentences_kept", pa.int32())])
_COUNTS = ("sentences_total", "sentences_kept", "num_chunks", "instructions_found", "instructions_kept", "entities_found", "entities_kept")
_OUT = pa.struct([("text", pa.string()), *((c, pa.int32()) for c in _COUNTS), ("chunks", pa.list_(_CHUNK))])
_DDL = (
    "struct<text:string," + ",".join(f"{c}:int" for c in _COUNTS)
    + ",chunks:array<struct<text:string,original_tokens:int,compressed_tokens:int,sentences_total:int,sentences_kept:int>>>"
)
_SIGNALS = ("p", "tokens", "tier", "instruction", "n_words")


def joined(texts: list[str], paragraphs: list[int]) -> str:
    """Sentences as one text: paragraphs apart by a blank line, within one by a blank, or line by line if all are list items."""
    import re

    item, parts = re.compile(r"\s*(?:#{1,6}\s|[-*+]\s|\d+[.)]\s)").match, {}
    for text, p in zip(texts, paragraphs, strict=True):
        parts.setdefault(p, []).append(text)
    return "\n\n".join([("\n" if len(own) > 1 and all(map(item, own)) else " ").join(own) for own in parts.values()])


def _selection(how: Settings, source: Column) -> Column:
    """A struct as of ``_DDL`` for each row; null text and chunks where there are fewer than two sentences. ``source``: texts,
    or with ``preserve`` sentences as of :func:`scored_sentences`; null rows are passed over."""
    stop = frozenset(StopWordsRemover.loadDefaultStopWords("english"))
    per_mode = {m: how.weights_of(m) for m in MODES}
    read = _from_sentences if how.preserve else _from_texts

    @F.arrow_udf(_DDL)
    def run(sources: pa.Array, whole: pa.Array, modes: pa.Array, ratios: pa.Array, _: pa.Array) -> pa.Array:
        terms = rows.terms_finder(stop)
        asked = terms([how.query]) if how.query else []

        def one(texts: list[str], signals: list[list], n: int, mode: str, target: float) -> dict:
            paragraphs, tokens, tier, inst, n_words, count = signals
            ent = [min(1.0, min(3.0 * c / w, 0.8) + min(0.3 * c, 0.8)) if c and w else 0.0 for c, w in zip(count, n_words, strict=True)]
            tier = [max(t, 2) if e >= 0.3 else t for t, e in zip(tier, ent, strict=True)]
            weighted = term_weights([*terms(texts), *asked])
            query = weighted.pop() if asked else {}
            weight = dict(zip(_ORDER, per_mode[mode], strict=True))
            chunk = chunk_ids(weighted, tokens, how.chunk_tokens, how.chunk_similarity)
            cuts = [0, *(i for i in range(1, len(chunk)) if chunk[i] != chunk[i - 1]), len(chunk)]
            spans, middle, place = list(zip(cuts, cuts[1:])), [], [0.4] * len(texts)
            for lo, hi in spans:
                middle += centrality(weighted[lo:hi])
                place[lo] = place[hi - 1] = 1.0
            score = []
            for i, row in enumerate(weighted):
                x = weight["centrality"] * middle[i] + weight["position"] * place[i] + weight["entity"] * ent[i] + weight["instruction"] * inst[i]
                x -= weight["length_penalty"] * 0.5 * (n_words[i] < 4)
                if query:
                    x += weight["query"] * max(0.0, sum([w * query.get(t, 0.0) for t, w in row.items()]))
                score.append(round(x + (tier[i] - 1) * TIER_BONUS, 12))
            ratio = target + (HALF_NUDGE if target == 0.5 else 0)
            bonus = [0.5 * a + 0.5 * b for a, b in zip(inst, ent, strict=True)]
            kept = select(chunk, tokens, tier, score, bonus, ratio, max(1, round(n * ratio)))
            left = [i for i, k in enumerate(kept) if k]
            parts = []
            for lo, hi in spans:
                own = [i for i in range(lo, hi) if kept[i]]
                parts.append({"text": " ".join([texts[i] for i in own]), "original_tokens": sum(tokens[lo:hi]), "compressed_tokens": sum([tokens[i] for i in own]), "sentences_total": hi - lo, "sentences_kept": len(own)})
            return {
                "text": joined([texts[i] for i in left], [paragraphs[i] for i in left]), "sentences_total": len(texts), "sentences_kept": len(left), "num_chunks": len(spans),
                "instructions_found": sum([x > 0 for x in inst]), "instructions_kept": sum([inst[i] > 0 for i in left]),
                "entities_found": sum([x > 0 for x in ent]), "entities_kept": sum([ent[i] > 0 for i in left]), "chunks": parts,
            }

        out = []
        how_each = zip(whole.to_pylist(), modes.to_pylist(), ratios.to_pylist(), strict=True)
        for (texts, signals), (n, mode, ratio) in zip(read(sources), how_each, strict=True):
            out.append(one(texts, signals, n, mode, ratio) if len(texts) > 1 else {"sentences_total": len(texts), "sentences_kept": len(texts), "num_chunks": 0})
        return pa.array(out, _OUT)

    # read twice, a column of sentences is not inlined into the call
    again = F.size(source) if how.preserve else F.lit(0)
    # so marked, its call is neither repeated nor moved into a generator, which could not make it
    return run.asNondeterministic()(source, F.col(f"{_P}tokens"), F.col(f"{_P}mode"), F.col(f"{_P}ratio"), again)


#: Texts that are split at a time, as the signals are looked for in all their sentences at once.
_AT_A_TIME = 256


def _from_texts(texts: pa.Array):
    """The sentences of each text and their signals, in the order of ``_SIGNALS``, and their entities."""
    find, entities = rows.signals_finder(), rows.entities_finder()
    for at in range(0, len(texts), _AT_A_TIME):
        split = [rows.document_sentences_of(t) for t in texts.slice(at, _AT_A_TIME).to_pylist()]
        flat = [s for _, own in split for s in own]
        (instruction, tier), count = find(flat), entities(flat)
        base = 0
        for paragraphs, own in split:
            end = base + len(own)
            yield own, [paragraphs, [rows.token_count_of(s) for s in own], tier[base:end], instruction[base:end], [len(s.split()) for s in own], count[base:end]]
            base = end


def _from_sentences(sentences: pa.Array):
    flat, offsets = sentences.flatten(), sentences.offsets.to_pylist()
    base = offsets[0] if offsets else 0
    texts, columns = flat.field("s").to_pylist(), [flat.field(k).to_pylist() for k in _SIGNALS]
    columns.append(rows.entities_finder()(texts))
    for a, b in zip(offsets, offsets[1:]):
        yield texts[a - base : b - base], [c[a - base : b - base] for c in columns]


def scored_sentences(text, preserve: tuple[str, ...] = ()):
    """array<struct<p, s, tokens, instruction, tier, n_words>> of a text column; the tier without regard to entities."""

    def one(x):
        s = x["s"]
        return F.struct(x["p"].alias("p"), s.alias("s"), token_count(s).alias("tokens"), S.instruction_score(s).alias("instruction"), S.priority(s, preserve, F.lit(0.0)).alias("tier"), F.size(words(s)).alias("n_words"))

    return F.transform(document_sentences(text), one)


_RESULTS = (
    "compressed_text", "original_tokens", "compressed_tokens", "sentences_total", "sentences_kept", "num_chunks", "target_ratio", "actual_ratio", "reduction_percent",
    "mode", "content_type", "content_confidence", "structure_preserved", "instructions_found", "instructions_kept", "entities_found", "entities_kept", "chunk_results",
)


def compress(df: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``df`` with compressed_text, original_tokens, compressed_tokens, sentences_total, sentences_kept, num_chunks, target_ratio,
    actual_ratio and reduction_percent (columns of these names are replaced). Null texts count as empty and stay as they are.

    Further columns: chunk_results (array of struct text, original_tokens, compressed_tokens, sentences_total,
    sentences_kept); with ``mode`` or ``detect_content`` also mode, instructions_found, instructions_kept, entities_found,
    entities_kept (sentences), else null; with ``detect_content`` content_type, content_confidence and structure_preserved
    (whether JSON, YAML, Markdown or XML was shortened as such), else null.
    """
    settings = Settings(**how)
    own = df.drop(*(c for c in _RESULTS if c != text_col))
    text = F.col(text_col).cast("string")
    ready = own.withColumn(f"{_P}tokens", token_count(text))
    if settings.detect_content:
        held = ready.withColumnRenamed("profile", f"{_P}own") if "profile" in ready.columns else ready
        ready = content_profile(held, text_col, brief=True).withColumnRenamed("profile", f"{_P}profile")
        ready = ready.withColumnRenamed(f"{_P}own", "profile") if "profile" in own.columns else ready
    kind = F.col(f"{_P}profile.content_type") if settings.detect_content else None
    mode = resolve_mode("auto" if settings.mode is None and settings.detect_content else settings.mode, kind)
    ratio = F.lit(settings.target_ratio)
    if settings.resolved and settings.target_ratio == 0.5:
        ratio = F.create_map(*(F.lit(x) for m in MODES.values() for x in (m.name, m.target_ratio)))[F.col(f"{_P}mode")]
    ready = ready.withColumn(f"{_P}mode", mode).withColumn(f"{_P}ratio", ratio)
    gate = F.col(f"{_P}tokens") > settings.min_tokens  # short texts are not split at all
    if settings.detect_content:
        keeps = F.create_map(*(F.lit(x) for m in MODES.values() for x in (m.name, m.preserve_structure)))[F.col(f"{_P}mode")]
        path = F.when(gate & keeps & F.col(f"{_P}profile.has_structure") & kind.isin(*SHORTEN), kind)
        ready = ready.withColumn(f"{_P}short", optimize_structured(path, text, F.col(f"{_P}ratio")))
        ready = ready.withColumn(f"{_P}short", F.when(F.col(f"{_P}short") != text, F.col(f"{_P}short")))
        gate &= F.col(f"{_P}short").isNull()
    source = F.when(gate, text)
    if settings.preserve:
        # an Arrow function takes no lambdas, so the sentences must stay a column of their own: what is random is not inlined if read twice
        ready, source = ready.withColumn(f"{_P}s", F.when(gate & (F.rand(0) >= 0), scored_sentences(text, settings.preserve))), F.col(f"{_P}s")
    done = ready.withColumn(f"{_P}x", _selection(settings, source))  # nothing after this reads the sentences

    found = lambda c: F.col(f"{_P}x.{c}")
    none, told = F.lit(None), F.lit(settings.resolved) & found("text").isNotNull()
    short = F.col(f"{_P}short") if settings.detect_content else none.cast("string")
    done = done.withColumn("compressed_text", F.coalesce(short, found("text"), text))
    done = done.withColumn("original_tokens", F.col(f"{_P}tokens")).withColumn("compressed_tokens", token_count(F.col("compressed_text")))
    done = done.withColumns({c: found(c) for c in _COUNTS[:3]} | {c: F.when(told, found(c)) for c in _COUNTS[3:]} | {"chunk_results": found("chunks")})
    done = done.withColumn("target_ratio", F.col(f"{_P}ratio"))
    done = done.withColumn("actual_ratio", F.when(F.col("original_tokens") == 0, 1.0).otherwise(F.col("compressed_tokens") / F.col("original_tokens")))
    done = done.withColumn("reduction_percent", F.bround((1 - F.col("actual_ratio")) * 100, 1))
    done = done.withColumn("mode", F.col(f"{_P}mode") if settings.resolved else none.cast("string"))
    done = done.withColumn("content_type", kind if settings.detect_content else none.cast("string"))
    done = done.withColumn("content_confidence", F.col(f"{_P}profile.confidence") if settings.detect_content else none.cast("double"))
    done = done.withColumn("structure_preserved", short.isNotNull() if settings.detect_content else none.cast("boolean"))
    return done.select(*own.columns, *(c for c in _RESULTS if c != text_col))


def compress_chat(df: DataFrame, roles: tuple[str, ...] = ("user", "assistant"), min_tokens: int = 60, **how) -> DataFrame:
    """Turns of the given roles are compressed, all other turns pass unchanged; the columns are those of :func:`compress`."""
    empty = F.length(F.trim(F.coalesce(F.col("text"), F.lit("")))) == 0
    done = compress(df.withColumn(f"{_P}in", F.when(F.col("role").isin(*roles) & ~empty, F.col("text"))), f"{_P}in", min_tokens=min_tokens, **how)
    return done.withColumn("compressed_text", F.coalesce("compressed_text", "text")).drop(f"{_P}in")
