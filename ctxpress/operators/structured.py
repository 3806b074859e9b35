"""Shortening of JSON, YAML, Markdown and XML that leaves it well-formed; by an Arrow UDF, as parsers are not expressions.

A column function: rows whose kind is null never reach a parser. What does not parse gives null.
"""

from __future__ import annotations

import json
import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: str) -> int:
    """A token for every four characters, half to even, at least one; none for an empty text."""
    return max(1, round(len(text) / 4)) if text else 0


def _kept(n: int, ratio: float) -> int:
    return max(1, round(n * ratio))


def _pruned(node, ratio: float):
    if isinstance(node, dict):
        return {k: _pruned(v, ratio) for k, v in node.items()}
    if isinstance(node, list):
        own = node[: _kept(len(node), ratio)] if len(node) > 3 else node
        return [_pruned(x, ratio) for x in own]
    return node


def shorten_json(text: str, ratio: float) -> str | None:
    """Without blanks; if that is not short enough, long lists keep their first items."""
    try:
        tree = json.loads(text)
    except (ValueError, RecursionError):
        return None
    dense = json.dumps(tree, separators=(",", ":"))
    if tokens(dense) <= ratio * tokens(text):
        return dense
    return json.dumps(_pruned(tree, ratio), separators=(",", ":"))


def strip_comments(text: str) -> str:
    """Lines without comments and blank lines."""
    own = (re.sub(r"\s+#.*$", "", x, flags=re.M) for x in text.splitlines() if not re.match(r"\s*#", x))
    return re.sub(r"\n\s*\n", "\n", "\n".join(x for x in own if x.strip())).strip()


def shorten_yaml(text: str, ratio: float) -> str:
    """Parsed and written anew if that is short enough, else the shorter of that and the text without comments."""
    lean = strip_comments(text)
    try:
        import yaml

        parts = list(yaml.safe_load_all(text))
        if not parts or parts == [None]:
            return lean
        written = yaml.dump_all(parts, default_flow_style=False, sort_keys=False) if len(parts) > 1 else yaml.dump(parts[0], default_flow_style=False, sort_keys=False)
    except Exception:  # no YAML, or no parser: the text itself is all there is
        return lean
    if text and tokens(written) <= ratio * tokens(text):
        return written.strip()
    return lean if tokens(lean) < tokens(written) else written.strip()


def shorten_markdown(text: str, ratio: float) -> str:
    """Fenced code and headings stay; of each section the first lines in proportion."""
    out = []
    for k, part in enumerate(re.split(r"(```[\s\S]*?```)", text)):
        if k % 2:
            out.append(part)
            continue
        blocks, prose = [], []
        for line in [*part.split("\n"), None]:
            if line is None or re.match(r"#{1,6}\s+.*$", line):
                if prose:
                    blocks.append("\n".join(prose[: _kept(len(prose), ratio)]))
                    prose = []
                if line is not None:
                    blocks.append(line)
            elif line.strip():
                prose.append(line)
        out.append("\n".join(blocks))
    done = "".join(out)
    return done if tokens(done) < tokens(text) else text


def shorten_xml(text: str, ratio: float) -> str | None:
    """Without blanks around texts; of many children the first in proportion."""
    try:
        root = ElementTree.fromstring(text)
    except (ElementTree.ParseError, ValueError):
        return None
    queue = [root]
    while queue:
        node = queue.pop()
        node.text, node.tail = (x.strip() if x else x for x in (node.text, node.tail))
        if len(node) > 3:
            del node[_kept(len(node), ratio) :]
        queue.extend(node)
    done = ElementTree.tostring(root, encoding="utf-8").decode("utf-8")
    return done if tokens(done) < tokens(text) else text


SHORTEN = {"json": shorten_json, "yaml": shorten_yaml, "markdown": shorten_markdown, "xml": shorten_xml, "html": shorten_xml}


def optimize_structured(kind: Column, text: Column, ratio: Column) -> Column:
    """``text`` shortened by its content type; null for other types, null texts and what does not parse."""
    @F.pandas_udf("string")
    def run(kinds: pd.Series, texts: pd.Series, ratios: pd.Series) -> pd.Series:
        one = lambda k, t, r: SHORTEN[k](t, r) if k in SHORTEN and t is not None else None
        return pd.Series([one(k, t, r) for k, t, r in zip(kinds, texts, ratios, strict=True)], dtype=object)

    return run(F.when(kind.isin(*SHORTEN), kind), F.when(kind.isin(*SHORTEN), text), ratio.cast("double"))
