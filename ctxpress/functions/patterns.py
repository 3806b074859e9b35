"""Regular expressions and word lists that define the signals; matching follows Unicode rules and ``\\n`` line ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java flags: Unicode classes and case, only \n ends a line.
PLAIN, FOLDED = "(?Ud)", "(?Udium)"

# They define what the results are.
ABBREVIATIONS = (
    "mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "vs.", "etc.", "e.g.", "i.e.", "fig.", "eq.", "al.", "no.", "vol.",
    "approx.", "inc.", "ltd.", "co.", "st.", "a.m.", "p.m.",
)
SENTENCE_GAP = r"""(?<=[.!?])\s+(?=[A-Z0-9"'(\[])"""
STRUCTURAL_LINE = r"^\s*(#{1,6}\s|[-*+]\s|\d+[.)]\s|\x00BLOCK)"
CODE_FENCE = r"(?s)```.*?```"
CODE_SPAN = r"```|`[^`\n]+`"

# Obligation, prohibition, emphasis, role, format, label, tool, limit and question signals.
INSTRUCTION = (
    r"\bmust\b", r"\bshall\b", r"\bshould\b", r"\bensure\b", r"\bmake sure\b", r"\bneed(?:s)? to\b", r"\brequire[sd]?\b", r"\bverify\b",
    r"\bvalidate\b", r"\bconfirm\b", r"\bnever\b", r"\bdo not\b", r"\bdon't\b", r"\bavoid\b", r"\brefrain\b", r"\bprohibit(?:ed)?\b",
    r"\balways\b", r"\bimportant\b", r"\bnote that\b", r"\bremember\b", r"\bcritical\b", r"\bplease\b", r"\byou are\b", r"\bact as\b",
    r"\byour role\b", r"\byou will\b", r"\brespond in\b", r"\bformat (?:as|your|the|in)\b", r"\boutput (?:as|in|should)\b",
    r"\breturn (?:a|the|only)\b", r"\bJSON\b", r"\bYAML\b", r"\bmarkdown\b", r"^(?:WARNING|CAUTION|IMPORTANT|NOTE|ATTENTION)\s*:",
    r"^(?:System|Instructions?|Rules?|Guidelines?|Constraints?)\s*:", r"\buse the (?:tool|function|API)\b", r"\bcall the\b", r"\binvoke\b",
    r"\bat most\b", r"\bno more than\b", r"\bwithin\b", r"\blimit(?:ed)? to\b", r"\bmaximum\b", r"\bminimum\b", r"\?\s*$",
)
# Obligation, steps, labels, roles.
CRITICAL = (
    r"\bmust\b", r"\bnever\b", r"\balways\b", r"\brequired?\b", r"\bensure\b", r"\bdo not\b", r"\bdon't\b", r"\bcritical\b",
    r"^\s*(\d+[.)]|[-*+])\s", r"^(?:WARNING|CAUTION|IMPORTANT)\s*:", r"\byou are\b",
)
# The tiers of priority, from the highest.
SAFETY = (r"^(?:WARNING|CAUTION|IMPORTANT|ATTENTION)\s*:", r"^(?:System|Rules|Guidelines|Guardrails)\s*:", r"\bnever assist with\b", r"\billegal\b", r"\bharmful\b")
HIGH = (
    r"\byou are\b", r"\bact as\b", r"\byour role\b", r"\bnever\b", r"\bdo not\b", r"\bdon't\b", r"\bmust\b", r"\balways\b", r"\bensure\b",
    r"\bmake sure\b", r"\brequire[sd]?\b", r"\brespond in\b", r"\bformat (?:as|your|the|in)\b", r"\bverify\b", r"\bvalidate\b",
)
MEDIUM = (
    r"\brespond in\b", r"\bformat (?:as|your|the|in)\b", r"\bJSON\b", r"\bYAML\b", r"\bmarkdown\b", r"\buse the (?:tool|function|API)\b",
    r"^\s*(\d+[.)]|[-*+])\s",
)
# Fixed values: (flags, pattern) of each entity kind: names, words, acronyms, hyphens, versions, numbers, mail, URLs, snake and camel
#: case, files, environment variables, code spans, API paths.
ENTITY = (
    (PLAIN, r"\b[A-Z][a-zA-Z]+(?:\s[A-Z][a-zA-Z]+)+\b"),
    (PLAIN, r"\b[A-Z][a-zA-Z]{2,}\b"),
    (PLAIN, r"\b[A-Z]{2,}[0-9]*\b"),
    (PLAIN, r"\b[A-Za-z][\w]*-[A-Za-z0-9][\w]*\b"),
    (PLAIN, r"\bv?\d+\.\d+(?:\.\d+)?\b"),
    (PLAIN, r"\b\d[\d,.]*%?\b"),
    (PLAIN, r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
    (PLAIN, r"https?://\S+"),
    (PLAIN, r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"),
    (PLAIN, r"\b[a-z]+[A-Z][a-zA-Z0-9]*\b"),
    ("(?Udiu)", r"\b\w+\.(?:py|js|ts|json|yaml|yml|toml|md|txt|csv|html|css|xml|sql|sh|bat|cfg|ini|env|log)\b"),
    (PLAIN, r"\b[A-Z][A-Z0-9_]{2,}\b"),
    (PLAIN, r"`[^`\n]+`"),
    ("(?Udiu)", r"/[a-z][\w/.-]*"),
)


def any_of(patterns: tuple[str, ...], flags: str = FOLDED) -> str:
    """One expression for all patterns. Those between two word boundaries share them, so that most places fail at once."""
    inner = [p[2:-2] for p in patterns if _bounded(p)]
    rest = [f"(?:{p})" for p in patterns if p[2:-2] not in inner]
    return flags + "|".join([rf"\b(?:{'|'.join(inner)})\b"] * bool(inner) + rest)


def _bounded(p: str) -> bool:
    return p.startswith(r"\b") and p.endswith(r"\b")


def found(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def n_found(text: Column, pattern: str) -> Column:
    """Number of matches that do not overlap."""
    return F.regexp_count(text, F.lit(pattern))
