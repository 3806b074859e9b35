"""What kind of content a text is: seventeen scores, the best of them, and figures of its structure, as columns.

Every figure a score needs is counted once per text by one Arrow function (no shuffle); the scores are arithmetic over those
figures, written as SQL that Spark and the oracle both understand.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxpress.functions import rows
from ctxpress.functions.text import let, strip, token_count

# Fixed values: (flags, pattern) of each signal; flags: m multi-line, i any case, s dot matches all.
SIGNALS = {
    "json_kv": ("m", r'"[^"]+"\s*:'),
    "yaml_sep": ("m", r"^---\s*$"),
    "yaml_key": ("m", r"^[a-zA-Z_][\w.-]*\s*:"),
    "yaml_indent": ("m", r"^\s{2,}-?\s"),
    "yaml_scalar": ("m", r":\s*[|>][-+]?\s*$"),
    "md_heading": ("m", r"^#{1,6}\s+\S"),
    "md_link": ("", r"\[([^\]]+)\]\(([^)]+)\)"),
    "md_bold": ("", r"(?:\*{1,3}|_{1,3})\S"),
    "md_fence": ("m", r"^```"),
    "md_list": ("m", r"^\s*[-*+]\s+\S"),
    "tag": ("m", r"</?[a-zA-Z][\w-]*(?:\s[^>]*)?>"),
    "html_doctype": ("i", r"<!DOCTYPE\s+html"),
    "html_tag": ("i", r"<(?:html|head|body|div|span|p|a|img|script|style|table|form|input|button)\b"),
    "xml_decl": ("i", r"<\?xml\s"),
    "xml_ns": ("i", r"\bxmlns\s*="),
    "xml_cdata": ("", r"<!\[CDATA\["),
    "py_def": ("m", r"^\s*def\s+\w+\s*\("),
    "py_class": ("m", r"^\s*class\s+\w+"),
    "py_import": ("m", r"^(?:import|from)\s+\w+"),
    "py_decorator": ("m", r"^\s*@\w+"),
    "py_docstring": ("s", r'""".*?"""|\'\'\'.*?\'\'\''),
    "js_function": ("m", r"\bfunction\s+\w+\s*\(|=>\s*[{(]"),
    "js_const": ("m", r"^\s*(?:const|let|var)\s+\w+"),
    "js_export": ("m", r"^\s*(?:export|module\.exports)"),
    "js_require": ("m", r"\brequire\s*\("),
    "js_import": ("m", r"^\s*import\s+.*\s+from\s+"),
    "ts_interface": ("m", r"^\s*(?:export\s+)?interface\s+\w+"),
    "ts_type": ("m", r"^\s*(?:export\s+)?type\s+\w+\s*="),
    "ts_annotation": ("", r":\s*(?:string|number|boolean|any|void|never)\b"),
    "sql_keyword": (
        "i",
        r"\b(?:SELECT|FROM|WHERE|INSERT\s+INTO|UPDATE|DELETE\s+FROM|CREATE\s+TABLE|ALTER\s+TABLE|DROP\s+TABLE|JOIN|LEFT\s+JOIN|"
        r"RIGHT\s+JOIN|INNER\s+JOIN|GROUP\s+BY|ORDER\s+BY|HAVING|UNION|INDEX|PRIMARY\s+KEY)\b",
    ),
    "chat_role": ("mi", r"^\s*(?:User|Assistant|Human|AI|System|Bot)\s*:"),
    "chat_json": ("i", r'"role"\s*:\s*"(?:user|assistant|system)"'),
    "sys_you": ("i", r"\b(?:you are|your role|act as|your task)\b"),
    "sys_label": ("mi", r"^(?:System|Instructions?|Rules?|Guidelines?|Constraints?)\s*:"),
    "sys_imperative": ("i", r"\b(?:must|shall|always|never|do not|don't|ensure|make sure)\b"),
    "rag_marker": ("i", r"(?:^|\n)\s*(?:Document\s*\d+|Context|Source|Passage|Chunk|Reference)\s*:"),
    "rag_separator": ("", r"(?:^|\n)\s*[-=]{3,}\s*(?:$|\n)"),
    "log_time": ("", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"),
    "log_level": ("", r"\b(?:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL|TRACE)\b"),
    "log_bracket": ("", r"\[(?:DEBUG|INFO|WARN|ERROR|FATAL)\]"),
    "config_kv": ("m", r"^[A-Z_][A-Z0-9_]*\s*=\s*\S"),
    "config_section": ("m", r"^\[[\w.-]+\]\s*$"),
    "config_comment": ("m", r"^\s*[#;]"),
    "api_method": ("m", r"\b(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+/"),
    "api_endpoint": ("", r"/(?:api|v\d)/[\w/{}-]+"),
    "api_status": ("", r"\b(?:200|201|400|401|403|404|500)\b"),
    "api_schema": ("i", r"\b(?:request|response)\s+(?:body|schema|payload|parameters)\b"),
    "paper_section": (
        "mi",
        r"^(?:Abstract|Introduction|Background|Related Work|Methods?|Methodology|Results?|Discussion|Conclusion|References|"
        r"Acknowledgments?|Appendix)\s*$",
    ),
    "paper_citation": ("", r"\[(?:\d+(?:,\s*\d+)*)\]|\(\w+(?:\s+et\s+al\.?)?,?\s*\d{4}\)"),
    "doc_note": ("mi", r"^(?:NOTE|WARNING|CAUTION|IMPORTANT|TIP|INFO)\s*:"),
    "doc_code": ("s", r"```\w*\n.*?```"),
}
INSTRUCTION_LINE = r"\b(?:must|shall|should|ensure|never|always|do not|don't|you are|your role|act as|required?|important|respond in|format as|JSON|YAML)\b"
ENTITY_LINE = r"(?:\b[A-Z][a-zA-Z]{2,}\b|https?://\S+|\b\w+\.\w+\b|`[^`\n]+`|\b[a-z]+_[a-z_]+\b|\b[A-Z]{2,}\b)"
MATCH_CAP, THRESHOLD, MOST_SECONDARY = 500, 0.15, 3
STRUCTURED = ("json", "yaml", "xml", "html", "markdown")
LANGUAGES = {"python": "python", "javascript": "javascript", "typescript": "typescript", "sql": "sql"}


def _at_most(signal: str, step: str, most: str) -> str:
    return f"least({signal} * {step}e0, {most}e0)"


def _share(signal: str, of: str, weight: str) -> str:
    return f"least({signal} / greatest({of}, 1e0), 1e0) * {weight}e0"


def _if(condition: str, value: str) -> str:
    return f"case when {condition} then {value}e0 else 0e0 end"


_FIRST = "first_char in ('{', '[')"
_JS = " + ".join([
    _share("js_function", "n_lines * 0.1e0", "0.25"), _share("js_const", "n_lines * 0.1e0", "0.2"), _if("js_export > 0 or js_require > 0", "0.15"),
    _if("js_import > 0", "0.15"), _share("n_curly", "n_lines * 2", "0.1"),
])
_TS = " + ".join([_if("ts_interface > 0", "0.3"), _if("ts_type > 0", "0.2"), _at_most("ts_annotation", "0.05", "0.25")])
# How the signals make up each score. The order decides ties.
SCORES = {
    "json": f"case when {_FIRST} then 0.35e0 + {_if('(first_char = chr(123) and last_char = chr(125)) or (first_char = chr(91) and last_char = chr(93))', '0.25')} else 0e0 end + "
    + _share("json_kv", "n_lines", "0.3") + " + " + _share("(n_curly + n_square)", "n_stripped / 20", "0.1"),
    "yaml": "(" + " + ".join([_if("yaml_sep > 0", "0.2"), _share("yaml_key", "n_lines", "0.35"), _share("yaml_indent", "n_lines", "0.2"), _if("yaml_scalar > 0", "0.1")]) + f") * case when {_FIRST} then 0.3e0 else 1e0 end",
    "markdown": "(" + " + ".join([
        _share("md_heading", "n_lines * 0.15e0", "0.3"), _if("md_fence >= 2", "0.15"), _at_most("md_link", "0.05", "0.15"), _if("md_bold > 0", "0.05"),
        _share("md_list", "n_lines", "0.15"), _if("md_heading > 0 and n_lines > md_heading * 2", "0.1"),
    ]) + ") * case when config_kv >= 3 and md_heading <= 2 then 0.3e0 else 1e0 end",
    "html": "(" + " + ".join([_if("html_doctype > 0", "0.35"), _at_most("html_tag", "0.05", "0.35"), "least(tag / greatest(n_lines, 1e0), 2e0) / 2e0 * 0.2e0"]) + ") * case when xml_decl > 0 then 0.5e0 else 1e0 end",
    "xml": "(" + " + ".join([
        _if("xml_decl > 0", "0.35"), _if("xml_ns > 0", "0.2"), _if("xml_cdata > 0", "0.15"), _share("greatest(tag - html_tag, 0)", "n_lines", "0.25"),
        _if("first_char = '<' and html_doctype = 0", "0.1"),
    ]) + ") * case when html_doctype > 0 then 0.2e0 else 1e0 end",
    "python": " + ".join([
        _share("(py_def + py_class)", "n_lines * 0.1e0", "0.35"), _at_most("py_import", "0.05", "0.2"), _if("py_decorator > 0", "0.1"), _if("py_docstring > 0", "0.1"),
        _share("n_indented", "n_lines", "0.15"),
    ]),
    "javascript": _JS,
    "typescript": f"case when ({_TS}) > 0 then least({_JS}, 1e0) * 0.5e0 + {_TS} else 0e0 end",
    "sql": " + ".join([_share("sql_keyword", "n_lines * 0.3e0", "0.6"), _at_most("n_semicolon", "0.05", "0.15"), _if("n_paren > 2 and sql_keyword > 0", "0.1")]),
    "chat_conversation": " + ".join([
        f"case when chat_role >= 2 then {_at_most('chat_role', '0.1', '0.4')} else 0e0 end", f"case when chat_json >= 2 then {_at_most('chat_json', '0.1', '0.4')} else 0e0 end",
        _if("chat_role >= 2 or chat_json >= 2", "0.2"),
    ]),
    "system_prompt": " + ".join([
        _at_most("sys_you", "0.15", "0.3"), _if("sys_label > 0", "0.2"),
        "case when sys_imperative / greatest(n_lines, 1e0) > 0.3e0 then 0.25e0 when sys_imperative / greatest(n_lines, 1e0) > 0.15e0 then 0.15e0 else 0e0 end",
        _if("n_lines between 5 and 300", "0.05"),
    ]),
    "rag_context": " + ".join([f"case when rag_marker >= 2 then {_at_most('rag_marker', '0.1', '0.35')} when rag_marker = 1 then 0.1e0 else 0e0 end", _if("rag_separator >= 2", "0.2"), _if("n_paragraphs >= 3", "0.15")]),
    "log_file": " + ".join(["case when log_time / greatest(n_lines, 1e0) > 0.3e0 then 0.35e0 when log_time > 0 then 0.15e0 else 0e0 end", _share("log_level", "n_lines", "0.3"), _at_most("log_bracket", "0.03", "0.15")]),
    "config_file": " + ".join([
        _share("config_kv", "n_lines", "0.35"), _at_most("config_section", "0.1", "0.25"), _share("config_comment", "n_lines", "0.15"), _if("config_comment > 0 and config_kv >= 2", "0.1"),
        _if("n_lines <= 100 and config_kv >= 3", "0.1"),
    ]),
    "api_documentation": " + ".join([_at_most("api_method", "0.1", "0.3"), _at_most("api_endpoint", "0.05", "0.2"), _if("api_status >= 2", "0.15"), _if("api_schema > 0", "0.15")]),
    "research_paper": " + ".join([
        "case when paper_section >= 3 then 0.35e0 when paper_section >= 1 then 0.15e0 else 0e0 end",
        "case when paper_citation >= 3 then 0.3e0 when paper_citation > 0 then 0.1e0 else 0e0 end", _if("n_words > 2000", "0.1"),
    ]),
    "technical_documentation": " + ".join([_if("md_heading >= 2", "0.15"), _at_most("doc_note", "0.1", "0.25"), _if("doc_code > 0 and md_heading > 0", "0.2"), _if("n_paragraphs >= 5 and md_heading >= 2", "0.15")]),
}
TYPES = (*SCORES, "general_text")
_P = "__ctx_"


def lines_of(text: Column) -> Column:
    """The lines that are not blank."""
    return F.filter(F.split(text, "\n"), lambda x: strip(x) != "")


_COUNTS = ("n_lines", "n_stripped", "n_curly", "n_square", "n_semicolon", "n_paren", "n_indented", "n_paragraphs", "n_words")


def figures(texts: pa.Array) -> dict[str, np.ndarray]:
    """Everything the scores read of texts that are not null, by name.

    A signal is only counted in texts that hold what it needs: RE2 looks for a group of signals, then for each of the group
    where it found any, and misses none.
    """
    own = texts.to_pylist()
    strange = [rows.is_odd(t) for t in own]
    found = {name: np.zeros(len(own)) for name in SIGNALS}
    for group, hint in _GROUPS:
        some = [i for i, there in enumerate(rows.matches(texts, hint)) if there]
        those = texts.take(pa.array(some, pa.int64()))
        for name in group if some else ():
            count, column = _counter(*SIGNALS[name]), found[name]
            for i, there in zip(some, rows.matches(those, _HINTS[name]), strict=True):
                if there:
                    column[i] = min(count(own[i], strange[i]), MATCH_CAP)
    counts = [_count(t) for t in own]
    found |= {k: np.array([c[j] for c in counts], float) for j, k in enumerate(_COUNTS)}
    ends = [c[-1] for c in counts]
    return found | {"first_char": np.array([x[:1] for x in ends], "U1"), "last_char": np.array([x[-1:] for x in ends], "U1")}


_RANKED = "struct<name:string,best:double,others:array<string>,n_stripped:int>"


def _ranked(text: Column) -> Column:
    """Struct of the best type, its score, up to three further types above the threshold and the text's length without blanks."""
    @F.arrow_udf(_RANKED)
    def run(texts: pa.Array) -> pa.Array:
        own = figures(texts)
        scores = np.array([np.minimum(np.broadcast_to(f(own), len(texts)), 1.0) for f in _scorers()])
        order = np.argsort(-scores, axis=0, kind="stable")
        names, n, best = np.array(list(SCORES), object), own["n_stripped"], scores.max(axis=0)
        general = (n == 0) | (best < THRESHOLD)
        next_ = order[1 : 1 + MOST_SECONDARY]
        above = (np.take_along_axis(scores, next_, axis=0) >= THRESHOLD) & (n > 0)
        others = [list(names[next_[above[:, i], i]]) for i in range(len(texts))] if above.any() else [[]] * len(texts)
        return pa.StructArray.from_arrays(
            [pa.array(np.where(general, "general_text", names[order[0]]), pa.string()), pa.array(best, pa.float64()), pa.array(others, pa.list_(pa.string())), pa.array(n.astype(np.int32))],
            ["name", "best", "others", "n_stripped"],
        )

    return run(text)


@lru_cache(1)
def _scorers() -> list:
    """``SCORES`` as functions of figures."""
    return [eval(f"lambda f: {_Arrays(e).source}", {"np": np}) for e in SCORES.values()]  # noqa: S307 (our own expressions)


class _Arrays:
    """An expression of ``SCORES`` as source over NumPy arrays in a mapping ``f``."""

    def __init__(self, expression: str):
        self.rest = re.findall(r"'[^']*'|[\d.]+(?:e0)?|[a-z_]\w*|[<>]=|[-+*/(),=<>]", expression)
        self.source = self.either()
        assert not self.rest

    def take(self, *wanted: str) -> str | None:
        return self.rest.pop(0) if self.rest and self.rest[0] in wanted else None

    def chain(self, below, ops: dict[str, str]) -> str:
        out = below()
        while op := self.take(*ops):
            out = f"({out} {ops[op]} {below()})"
        return out

    def either(self) -> str:
        return self.chain(self.both, {"or": "|"})

    def both(self) -> str:
        return self.chain(self.compared, {"and": "&"})

    def compared(self) -> str:
        out = self.sum()
        if op := self.take("=", "<", ">", "<=", ">="):
            return f"({out} {'==' if op == '=' else op} {self.sum()})"
        if self.take("in"):
            return f"np.isin({out}, [{self.arguments()}])"
        if self.take("between"):
            low = self.sum()
            self.rest.pop(0)
            return f"(({out} >= {low}) & ({out} <= {self.sum()}))"
        return out

    def sum(self) -> str:
        return self.chain(self.product, {"+": "+", "-": "-"})

    def product(self) -> str:
        return self.chain(self.atom, {"*": "*", "/": "/"})

    def arguments(self) -> str:
        out, _ = [], self.rest.pop(0)
        while not self.take(")"):
            out.append(self.either())
            self.take(",")
        return ", ".join(out)

    def atom(self) -> str:
        token = self.rest.pop(0)
        if token == "(":
            out = self.either()
            self.rest.pop(0)
            return out
        if token == "case":
            parts = []
            while self.take("when"):
                condition, _ = self.either(), self.rest.pop(0)
                parts.append((condition, self.either()))
            self.rest.pop(0)
            out, _ = self.either(), self.rest.pop(0)
            for condition, value in reversed(parts):
                out = f"np.where({condition}, {value}, {out})"
            return out
        if self.rest[:1] == ["("]:
            name = {"least": "np.minimum", "greatest": "np.maximum", "chr": "chr"}[token]
            return f"{name}({self.arguments()})"
        return f"f[{token!r}]" if token[0].isalpha() else token


def _count(t: str) -> tuple:
    """The figures ``_COUNTS`` of a text, then the text without blanks around it."""
    s, lines, n = t.strip(), t.split("\n"), t.count
    return (
        sum([x != "" and not x.isspace() for x in lines]), len(s), n("{") + n("}"), n("[") + n("]"), n(";"), n("(") + n(")"),
        sum([x.startswith("    ") for x in lines]) if "    " in t else 0, sum([x != "" and not x.isspace() for x in t.split("\n\n")]), len(t.split()), s,
    )


@lru_cache(None)
def _counter(flags: str, pattern: str):
    """A function from a text, and whether Java and Python may differ on its words, to the number of matches."""
    def compiled(engine, words: bool):
        how = sum(getattr(engine, f.upper()) for f in flags)
        return engine.compile(rows.spelt(pattern, words), how).finditer

    plain, odd = compiled(re, False), []

    def count(t: str, strange: bool) -> int:
        if not strange:
            return sum(1 for _ in plain(t))
        if not odd:
            import regex

            odd.append(compiled(regex, True))
        return sum(1 for _ in odd[0](t.translate(rows.FOLD) if "i" in flags else t))

    return count


def _hint(flags: str, pattern: str) -> str:
    """An RE2 pattern that is found in every text in which the given one is: no bounds, and wider classes."""
    wide = r"0-9A-Za-z_\x{80}-\x{10FFFF}"
    out = pattern.replace(r"\b", "").replace(r"[\w.-]", f"[{wide}.-]").replace(r"[\w-]", f"[{wide}-]").replace(r"[\w/{}-]", rf"[{wide}/{{}}-]").replace(r"\w", f"[{wide}]")
    out = out.replace(r"\s", r"[\t-\r \x{80}-\x{10FFFF}]").replace(r"\S", r"[^\t-\r ]").replace(r"\d", r"\p{Nd}")
    if "i" in flags:
        out = re.sub(r"(?<![\\{\w])[iI](?![:)])|(?<=[a-zA-Z])[iI]", lambda m: f"[{m[0]}\u0131\u0130]", out)
    return (f"(?{flags})" if flags else "") + out


_HINTS = {name: _hint(*pattern) for name, pattern in SIGNALS.items()}
_GROUPS = [(own, "|".join(f"(?:{_HINTS[k]})" for k in own)) for at in range(0, len(SIGNALS), 6) for own in [list(SIGNALS)[at : at + 6]]]


def _bracket_depth(marks: Column, opens) -> Column:
    """Greatest depth of nested marks; a mark that closes nothing is passed over."""
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(x: Column, mark: Column) -> Column:
        d = F.when(opens(mark), x["d"] + 1).otherwise(F.greatest(x["d"] - 1, F.lit(0)))
        return let(d, lambda d: F.struct(d.alias("d"), F.greatest(x["m"], d).alias("m")))

    return F.aggregate(marks, start, step, lambda x: x["m"])


def json_depth(text: Column) -> Column:
    return _bracket_depth(F.regexp_extract_all(text, F.lit(r"([{}\[\]])")), lambda m: m.isin("{", "["))


def xml_depth(text: Column) -> Column:
    return _bracket_depth(F.regexp_extract_all(text, F.lit(r"<(/?)[a-zA-Z]")), lambda m: m == "")


def yaml_depth(text: Column) -> Column:
    """Levels of two blanks in the deepest line that is no comment."""
    own = F.filter(F.split(text, "\n"), lambda x: (strip(x) != "") & ~strip(x).startswith("#"))
    indent = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+", ""))
    return F.floor(F.coalesce(F.array_max(F.transform(own, indent)), F.lit(0)) / 2).cast("int")


def heading_depth(text: Column) -> Column:
    levels = F.transform(F.regexp_extract_all(text, F.lit(r"(?Udm)^(#{1,6})\s+\S")), F.length)
    return F.coalesce(F.array_max(levels), F.lit(0))


def line_share(text: Column, pattern: str, flags: str = "") -> Column:
    """Share of the lines that are not blank in which the pattern is found, to four places."""
    own = lines_of(text)
    hits = F.size(F.filter(own, lambda x: x.rlike(f"(?Ud{flags}{'u' if 'i' in flags else ''})" + pattern)))
    return F.bround(hits / F.greatest(F.size(own), F.lit(1)), 4)


def content_profile(df: DataFrame, text_col: str = "text", brief: bool = False) -> DataFrame:
    """``df`` with ``profile``: struct of content_type, confidence, secondary_types, has_structure, estimated_tokens, language_hint,
    structure_depth, instruction_density, entity_density. A null or blank text is general text with confidence 1.

    ``brief``: content_type, confidence and has_structure only, which need no further walk over the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = F.col(f"{_P}r")
    named = df.select("*", _ranked(text).alias(f"{_P}r"))
    kind, best, others, blank = found["name"], found["best"], found["others"], found["n_stripped"] == 0
    told = {
        "content_type": kind,
        "confidence": F.when(blank, 1.0).otherwise(F.bround(F.when(best < THRESHOLD, 1.0 - best).otherwise(best), 4)),
        "secondary_types": others,
        "has_structure": kind.isin(*STRUCTURED) | F.arrays_overlap(others, F.array(*map(F.lit, STRUCTURED))),
    }
    if brief:
        del told["secondary_types"]
    else:
        hints = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
        depth = F.when(kind == "json", json_depth(text)).when(kind == "yaml", yaml_depth(text)).when(kind == "markdown", heading_depth(text)).when(kind.isin("xml", "html"), xml_depth(text)).otherwise(0)
        told |= {
            "estimated_tokens": F.when(blank, 0).otherwise(token_count(text)), "language_hint": hints[kind], "structure_depth": depth,
            "instruction_density": line_share(text, INSTRUCTION_LINE, "i"), "entity_density": line_share(text, ENTITY_LINE),
        }
    profile = F.struct(*(c.alias(k) for k, c in told.items()))
    return named.withColumn("profile", profile).drop(f"{_P}r")
