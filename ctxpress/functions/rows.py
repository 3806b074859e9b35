"""Sentences and their signals in plain Python, for Arrow functions: the rules of the expressions in ``text`` and ``scoring``
at a fraction of their time, as those walk every text many times with Unicode classes.

Java and Python agree on what a word is for the characters of ``_COMMON``; texts with others take expressions that spell
Java's classes out. Instruction signals are looked for by one RE2 pass over all sentences, which misses none; only where it
finds something are the exact expressions used.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc

from ctxpress.functions import patterns as P

#: Java's \s under Unicode rules (Python's has \x1c to \x1f besides), and a character of a word.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = r"\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\u200c\u200d"
#: Characters that are part of a word in both languages, or in neither.
_COMMON = r"\x00-\xb1\xb4-\xb8\xba\xbb\xbf-\u02c1\u0388-\u03ff\u0400-\u0482\u048a-\u052f\u2010-\u2027\u2030-\u203e\u20a0-\u20bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
#: Letters that Java takes for s, k and i whatever the case, and the ``regex`` package does not always.
FOLD = str.maketrans("\u0131\u0130\u017f\u212a", "iisk")
_odd = re.compile(f"[^{_COMMON}]").search


def is_odd(s: str) -> bool:
    """Whether Java and Python may differ on the words of a text."""
    return not s.isascii() and _odd(s) is not None


def spelt(pattern: str, words: bool = False) -> str:
    """A pattern with Java's classes; with ``words`` (for the ``regex`` package) also those of words and their ends."""
    out = pattern.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
    if words:
        out = out.replace(r"[\w", f"[{_WORD}").replace(r"\w", f"[{_WORD}]").replace(r"\b", f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))")
    return out


_paragraphs = re.compile(r"\n\s*\n").split
_fences = re.compile(P.CODE_FENCE)
_structural = re.compile(spelt(P.STRUCTURAL_LINE)).match
#: A gap behind a mark; so written, the search runs from mark to mark.
_gaps = re.compile(spelt(r"[.!?](\s+)" + P.SENTENCE_GAP.partition(r"\s+")[2])).finditer
_mark = re.compile("\0BLOCK([0-9]+)\0")
_ABBREVIATIONS = frozenset(P.ABBREVIATIONS)


def paragraphs_of(text: str) -> list[str]:
    return [p for x in _paragraphs(text.strip()) if (p := x.strip())]


def _pieces(line: str, out: list[str]) -> None:
    at = 0
    if not _structural(line):
        for m in _gaps(line):
            out.append(line[at : m.start(1)])
            at = m.end()
    out.append(line[at:] if at else line)


def _back(s: str, blocks: list[str], nested: bool) -> str:
    if nested:  # a mark may stand in the text or in a block: one after the other
        for k, block in enumerate(blocks):
            s = s.replace(f"\0BLOCK{k}\0", block)
        return s
    return _mark.sub(lambda m: blocks[int(m[1])], s)


def sentences_of(paragraph: str) -> list[str]:
    """As :func:`ctxpress.functions.text.sentences`."""
    blocks = _fences.findall(paragraph) if "```" in paragraph else []
    held = paragraph
    if blocks:
        between = _fences.split(paragraph)
        held = "".join([s + (f"\0BLOCK{k}\0" if k < len(blocks) else "") for k, s in enumerate(between)])
    pieces: list[str] = []
    for x in held.split("\n"):
        if x := x.strip():
            _pieces(x, pieces)
    out: list[str] = []
    open_ = False  # the last sentence ends in an abbreviation
    for s in pieces:
        s = s.strip()
        if not s:
            continue
        if open_:
            parts.append(s)
        else:
            parts = [s]
            out.append(s)
        open_ = s[-1] == "." and s[s.rfind(" ") + 1 :].split()[-1].lower() in _ABBREVIATIONS
        if len(parts) > 1 and not open_:
            out[-1] = " ".join(parts)
    if open_ and len(parts) > 1:
        out[-1] = " ".join(parts)
    if blocks:
        nested = "\0" in paragraph
        out = [x for s in out if (x := (_back(s, blocks, nested) if "\0" in s else s).strip())]
    return out


def document_sentences_of(text: str | None) -> tuple[list[int], list[str]]:
    """All sentences of a text in order, with the index of each one's paragraph."""
    numbers: list[int] = []
    out: list[str] = []
    for k, p in enumerate(paragraphs_of(text) if text else ()):
        own = sentences_of(p)
        out += own
        numbers += [k] * len(own)
    return numbers, out


def token_count_of(s: str) -> int:
    return max(1, round(len(s) / 4)) if s else 0


def hint(*groups: tuple[str, ...], more: str = "") -> str:
    """An RE2 pattern that finds a place wherever one of the patterns does: their words without bounds, or ``more``, which
    stands for all that begin with neither a bound nor a label. The letters that fold to i are those of Java and Python."""
    found: set[str] = set()
    for p in {p for g in groups for p in g}:
        if p.startswith(r"\b"):
            found.add(p.replace(r"\b", ""))
        elif p.startswith("^(?:"):
            found.add(p[1:].replace(r"\s*:", ""))
    body = "|".join(sorted(found)).replace("i", "[i\u0131\u0130]").replace("I", "[I\u0131\u0130]")
    return f"(?i){more}{'|' * bool(more)}{body}"


def matches(texts: list[str] | pa.Array, pattern: str) -> list[bool]:
    """In which texts an RE2 pattern is found."""
    return pc.match_substring_regex(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts, pattern).to_pylist()


_HINT = hint(P.INSTRUCTION, P.SAFETY, P.HIGH, P.MEDIUM, P.CRITICAL, more=r"[-*+`?]|\p{Nd}[.)]")


class _Exact:
    """The signals of one sentence by exact expressions."""

    def __init__(self, words: bool):
        if words:
            import regex as engine
        else:
            engine = re
        self.instruction, self.safety, self.high, self.medium = (
            engine.compile(spelt(P.any_of(p, ""), words), engine.I | engine.M | engine.U) for p in (P.INSTRUCTION, P.SAFETY, P.HIGH, P.MEDIUM)
        )
        self.code, self.fold = re.compile(P.CODE_SPAN).search, words

    def __call__(self, s: str) -> tuple[float, int]:
        if self.fold:
            s = s.translate(FOLD)
        n = len(self.instruction.findall(s))
        score = min(1.0, min(n * 0.4, 0.9) + (0.4 if self.code(s) else 0.0))
        return score, 4 if self.safety.search(s) else 3 if self.high.search(s) else 2 if self.medium.search(s) else 1


@lru_cache(1)
def signals_finder():
    """A function from sentences to their instruction scores and tiers (without regard to entities and protected patterns)."""
    plain, odd = _Exact(False), []

    def exact(s: str) -> tuple[float, int]:
        if not is_odd(s):
            return plain(s)
        if not odd:
            odd.append(_Exact(True))
        return odd[0](s)

    def run(sentences: list[str]) -> tuple[list[float], list[int]]:
        instruction, tier = [0.0] * len(sentences), [1] * len(sentences)
        for i, there in enumerate(matches(sentences, _HINT)):
            if there:
                instruction[i], tier[i] = exact(sentences[i])
        return instruction, tier

    return run


#: ASCII but \0, and letters whose lower case is one letter: where there is nothing else, a word ends where ASCII says so.
_other = re.compile(r"[^\x01-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u02af]").search
_BLANKED = bytes(c if c > 127 or chr(c).isalnum() or c in b"_\0" else 32 for c in range(256))


def terms_finder(stop: frozenset[str]):
    """A function from the sentences of a text to the terms of each: words of two characters or more in lower case, without
    stop words."""
    import regex

    plain, odd = re.compile(r"\w\w+").findall, regex.compile(r"\b\w\w+\b").findall

    def run(sentences: list[str]) -> list[list[str]]:
        whole = "\0".join(sentences)
        if (whole.count("\0") >= len(sentences)) if whole.isascii() else _other(whole.replace("\0", " ")) or whole.count("\0") >= len(sentences):
            low = [s.lower() for s in sentences]
            return [[t for t in (odd if is_odd(s) else plain)(s) if t not in stop] for s in low]
        words = whole.lower().encode().translate(_BLANKED).decode().split("\0")
        return [[t for t in s.split() if len(t) > 1 and t not in stop] for s in words]

    return run


@lru_cache(1)
def tokens_finder():
    """A function from a text to its runs of letters, digits and underscores in lower case, in order (Java's classes)."""
    import regex

    plain, odd = re.compile(r"\w+").findall, regex.compile(f"[{_WORD}]+").findall

    def run(text: str) -> list[str]:
        if "\0" in text or not text.isascii() and _other(text):
            low = text.lower()
            return (odd if is_odd(low) else plain)(low)
        return text.lower().encode().translate(_BLANKED).decode().split()

    return run


#: What a text must hold for an entity of some kinds to begin.
_DIGIT, _PAIR, _CAMEL = re.compile(r"\d").search, re.compile(r"[A-Z][A-Z0-9_]").search, re.compile(r"[a-z][A-Z]").search


def from_capital(p: str) -> str:
    """The same pattern, so written that a search runs from capital to capital."""
    return rf"[A-Z](?<!\w[A-Z]){p[7:]}" if p.startswith((r"\b[A-Z][a", r"\b[A-Z][A")) else p


#: An RE2 pattern without which only single names, with a capital and two more letters, can begin in a text.
_MORE = r"[A-Z][a-zA-Z][^!-~][A-Z]|[a-z][A-Z]|[A-Z][A-Z0-9_]|\p{Nd}|[-@_`/]|\.[^ -@]"


def entity_finder():
    """A function from a text to the number of distinct places at which an entity of any kind begins. Only kinds that can
    begin in a text are looked for."""
    finders = [re.compile(from_capital(p), re.I if "i" in flags else 0).finditer for flags, p in P.ENTITY]
    names, words, acronyms, hyphens, versions, numbers, mail, urls, snake, camel, files, env, code, paths = finders
    suffix = re.compile(P.ENTITY[10][1].removeprefix(r"\b\w+"), re.I).search
    by_mark = (("-", hyphens), ("@", mail), ("://", urls), ("_", snake), ("`", code), ("/", paths))

    def count(s: str) -> int:
        own = [names, words]
        if _PAIR(s):
            own += (acronyms, env)
        if _CAMEL(s):
            own.append(camel)
        if _DIGIT(s):
            own += (versions, numbers)
        if suffix(s):
            own.append(files)
        own += [find for mark, find in by_mark if mark in s]
        return len({m.start() for find in own for m in find(s)})

    return count


def entities_finder():
    """A function from many texts to the count of :func:`entity_finder` for each."""
    count, single = entity_finder(), re.compile(from_capital(P.ENTITY[1][1])).findall

    def run(texts: list[str]) -> list[int]:
        return [count(t) if more else len(single(t)) for t, more in zip(texts, matches(texts, _MORE), strict=True)]

    return run
