"""Modes: named settings of ratio, signal weights and whether structure is kept; chosen by name or by content type."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mode:
    name: str
    target_ratio: float
    weights: dict[str, float] = field(default_factory=dict)
    preserve_structure: bool = True


# Ratio and weights of each mode, and the mode of each content type.
_ALL = (
    Mode("balanced", 0.5),
    Mode("quality", 0.7, {"instruction": 0.55, "entity": 0.55, "centrality": 0.15}),
    Mode("aggressive", 0.3, {"centrality": 0.30, "position": 0.15, "entity": 0.30, "instruction": 0.30}),
    Mode("rag", 0.4, {"query": 0.50, "entity": 0.45, "centrality": 0.25, "instruction": 0.30}, False),
    Mode("chat", 0.5, {"instruction": 0.50, "position": 0.15}, False),
    Mode("system", 0.8, {"instruction": 0.60, "entity": 0.50, "centrality": 0.10, "position": 0.05}, False),
    Mode("code", 0.6, {"entity": 0.55, "instruction": 0.25, "centrality": 0.15, "position": 0.10}),
    Mode("documentation", 0.5, {"instruction": 0.50, "entity": 0.50, "position": 0.10, "centrality": 0.15}),
)
BY_TYPE = {
    "general_text": "balanced", "chat_conversation": "chat", "system_prompt": "system", "rag_context": "rag", "markdown": "documentation",
    "python": "code", "javascript": "code", "typescript": "code", "sql": "code", "json": "balanced", "yaml": "balanced", "xml": "balanced",
    "html": "balanced", "config_file": "quality", "api_documentation": "documentation", "research_paper": "quality",
    "technical_documentation": "documentation", "log_file": "aggressive",
}
MODES = {m.name: m for m in _ALL}


def list_modes() -> list[str]:
    return sorted(MODES)


def get_mode(name: str) -> Mode:
    if name not in MODES:
        raise ValueError(f"unknown mode {name!r}; one of {', '.join(list_modes())}")
    return MODES[name]


def modes(spark: SparkSession) -> DataFrame:
    """The modes as a table of eight rows."""
    rows = [(m.name, m.target_ratio, m.weights, m.preserve_structure) for m in _ALL]
    return spark.createDataFrame(rows, "mode string, target_ratio double, weights map<string,double>, preserve_structure boolean")


def mode_of(content_type: Column) -> Column:
    """The mode of a content type; of an unknown one ``balanced``."""
    table = F.create_map(*(F.lit(x) for pair in BY_TYPE.items() for x in pair))
    return F.coalesce(table[content_type], F.lit("balanced"))


def resolve_mode(name: str | None, content_type: Column | None = None) -> Column:
    """The mode's name as a column: none given: balanced; ``auto``: by content type where there is one."""
    if name == "auto" and content_type is not None:
        return mode_of(content_type)
    return F.lit("balanced" if name in (None, "auto") else get_mode(name).name)
