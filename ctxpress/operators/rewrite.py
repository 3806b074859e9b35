"""Rewriting by a provider that the user gives, checked before it is taken; hybrid: first extractive, then rewritten."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxpress.operators import validation

_P = "__ctx_"


class Provider:
    """Something that rewrites a text. Subclasses override ``rewrite``; instances are pickled to the workers."""

    name = "provider"

    def is_available(self) -> bool:
        return True

    def rewrite(self, text: str, target_ratio: float, system_prompt: str, user_prompt: str) -> str:
        raise NotImplementedError


class CallableProvider(Provider):
    """A function of a text and a ratio as provider."""

    def __init__(self, function: Callable[[str, float], str], name: str = "callable"):
        if not callable(function):
            raise TypeError("a provider needs a function")
        self.function, self.name = function, name

    def rewrite(self, text: str, target_ratio: float, system_prompt: str, user_prompt: str) -> str:
        return self.function(text, target_ratio)


@dataclass(frozen=True)
class Template:
    name: str
    system_prompt: str
    user_prompt: str = "Shorten the text below to about {target_percent}% fewer tokens.{constraints}\n\n{text}"
    version: str = "1"


_KEEP = "Keep every instruction, name, number and identifier. Answer with the shortened text only."
BUILT_IN = {
    t.name: t
    for t in (
        Template("general", f"You shorten texts without losing meaning. {_KEEP}"),
        Template("rag_context", f"You shorten retrieved passages; facts and their sources stay. {_KEEP}"),
        Template("chat_history", f"You shorten conversations; who said what and all decisions stay. {_KEEP}"),
        Template("system_prompt", f"You shorten system prompts; every rule stays in force. {_KEEP}"),
        Template("documentation", f"You shorten documentation; headings, warnings and code stay. {_KEEP}"),
        Template("code_context", f"You shorten explanations around code; code stays as it is. {_KEEP}"),
    )
}
TEMPLATE_OF = {
    "chat_conversation": "chat_history", "system_prompt": "system_prompt", "rag_context": "rag_context", "markdown": "documentation",
    "api_documentation": "documentation", "technical_documentation": "documentation", "python": "code_context", "javascript": "code_context",
    "typescript": "code_context", "sql": "code_context",
}


@dataclass
class Templates:
    """Templates by name: the user's own come before the built-in ones."""

    own: dict[str, Template] = field(default_factory=dict)

    def register(self, template: Template) -> None:
        self.own[template.name] = template

    def list_templates(self) -> list[str]:
        return sorted({*BUILT_IN, *self.own})

    def resolve(self, name: str | None = None, content_type: str | None = None) -> Template:
        if name is not None:
            if name not in self.own and name not in BUILT_IN:
                raise ValueError(f"unknown template {name!r}; one of {', '.join(self.list_templates())}")
            return self.own.get(name) or BUILT_IN[name]
        return BUILT_IN[TEMPLATE_OF.get(content_type or "", "general")]


def user_prompt(template: Template, text: Column, target_ratio: float, constraints: tuple[str, ...] = ()) -> Column:
    """The prompt of a text: ``{text}``, ``{target_ratio}``, ``{target_percent}`` and ``{constraints}`` filled in."""
    more = "\n" + "\n".join(f"- {c}" for c in constraints) if constraints else ""
    plain = template.user_prompt.replace("{target_ratio}", str(target_ratio)).replace("{target_percent}", str(round((1 - target_ratio) * 100))).replace("{constraints}", more)
    return F.replace(F.lit(plain), F.lit("{text}"), text)


def rewrite(
    df: DataFrame, provider: Provider, target_ratio: float = 0.5, text_col: str = "text", template: str | None = None, templates: Templates | None = None,
    constraints: tuple[str, ...] = (), keywords: tuple[str, ...] = (), **limits,
) -> DataFrame:
    """``df`` with rewritten_text, accepted, fallback_used, validation (struct) and error_message.

    The provider runs in an Arrow UDF. Where it is not available, fails, gives no string or its text does not pass, the
    input text is the result. Null texts stay null and are not sent.
    """
    chosen = (templates or Templates()).resolve(template)
    system = chosen.system_prompt

    @F.pandas_udf("struct<text:string,error:string>")
    def call(texts: pd.Series, prompts: pd.Series) -> pd.DataFrame:
        rows = []
        for text, prompt in zip(texts, prompts, strict=True):
            if text is None:
                rows.append((None, None))
                continue
            try:
                if not provider.is_available():
                    raise RuntimeError(f"provider {provider.name} is not available")
                found = provider.rewrite(text, target_ratio, system, prompt)
                rows.append((found, None) if isinstance(found, str) else (None, f"provider gave {type(found).__name__}, not a string"))
            except Exception as e:  # whatever a user's provider raises: the text falls back
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "error"])

    text = F.col(text_col).cast("string")
    results = ("rewritten_text", "accepted", "fallback_used", "validation", "error_message")
    own = df.drop(*(c for c in results if c != text_col))
    sent = own.withColumn(f"{_P}call", call(text, user_prompt(chosen, text, target_ratio, constraints)))
    answer = F.col(f"{_P}call.text")
    checked = sent.withColumn("validation", F.when(answer.isNotNull(), validation.validate(text, answer, keywords, **limits)))
    taken = F.coalesce(F.col("validation.passed"), F.lit(False))
    checked = checked.withColumn("accepted", taken).withColumn("fallback_used", ~F.col("accepted"))
    checked = checked.withColumn("rewritten_text", F.when(F.col("accepted"), answer).otherwise(text)).withColumn("error_message", F.col(f"{_P}call.error"))
    return checked.drop(f"{_P}call")


def hybrid(df: DataFrame, provider: Provider, target_ratio: float = 0.5, text_col: str = "text", extractive: dict | None = None, **how) -> DataFrame:
    """Extractive compression, then a rewrite of its result by the same ratio, checked against that result."""
    from ctxpress.operators.compress import compress

    return rewrite(compress(df, text_col, target_ratio=target_ratio, **(extractive or {})), provider, target_ratio, "compressed_text", **how)
