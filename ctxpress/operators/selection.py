"""Selection within a chunk by dynamic programming: the best sum of scores that fits a budget; greedy for large tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DP_LIMIT = 50_000  # Fixed value: cells of the table beyond which the greedy rule serves.


def greedy(weights: list[int], scores: list[float], budget: int) -> set[int]:
    """Best score first (ties in order), whatever fits."""
    taken, used = set(), 0
    for i in sorted(range(len(weights)), key=lambda i: -scores[i]):
        if used + weights[i] <= budget:
            taken.add(i)
            used += weights[i]
    return taken


def knapsack(weights: list[int], scores: list[float], budget: int) -> set[int]:
    """Items of the greatest sum of scores within ``budget``; an item must add something to be taken."""
    own = [i for i, w in enumerate(weights) if w <= budget] if budget > 0 else []
    if len(own) * budget > DP_LIMIT:
        return greedy(weights, scores, budget)
    best, taken = np.zeros(budget + 1), np.zeros((len(own), budget + 1), bool)
    for k, i in enumerate(own):
        w = weights[i]
        more = best[: budget + 1 - w] + scores[i]
        better = more > best[w:]
        taken[k, w:] = better
        best[w:] = np.where(better, more, best[w:])
    out, left = set(), budget
    for k in range(len(own) - 1, -1, -1):
        if taken[k, left]:
            out.add(own[k])
            left -= weights[own[k]]
    return out


def choose(weights: list[int], scores: list[float], must: list[bool], ratio: float) -> set[int]:
    """Those that must stay, then the best of the others; if they alone exceed the budget, the best of them; at least one."""
    goal = max(1, round(sum(weights) * ratio))
    forced = [i for i, m in enumerate(must) if m]
    used = sum(weights[i] for i in forced)
    if used > goal:
        taken, used = set(), 0
        for i in sorted(forced, key=lambda i: -scores[i]):
            if not taken or used + weights[i] <= goal:
                taken.add(i)
                used += weights[i]
    else:
        rest = [i for i, m in enumerate(must) if not m]
        taken = {*forced, *(rest[k] for k in knapsack([weights[i] for i in rest], [scores[i] for i in rest], goal - used))}
    return taken or ({max(range(len(scores)), key=lambda i: (scores[i], -i))} if scores else set())


def knapsack_select(items: Column, ratio: float = 0.5) -> Column:
    """Kept positions (ascending) of array<struct<tokens int, score double, must_keep boolean>>; null array: null."""
    @F.pandas_udf("array<int>")
    def run(rows: pd.Series) -> pd.Series:
        pick = lambda x: sorted(choose([r["tokens"] for r in x], [r["score"] for r in x], [r["must_keep"] for r in x], ratio))
        return pd.Series([None if x is None else pick(x) for x in rows], dtype=object)

    return run(items)
