"""Ordered folds: greedy, order-dependent rules run per key over Arrow batches; a group is one document, query or session."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship


def per_group(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """fold(rows in order) for each key gives rows of the schema (which starts with the keys)."""
    ship(df.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values(order, kind="stable").itertuples(index=False))
        return pd.DataFrame([(*key, *out) for out in fold(rows)], columns=names)

    return df.groupBy(*keys).applyInPandas(run, schema)


def tie_bands(rows: list, gap: float) -> list[list]:
    """Rows by falling score; a band holds what lies within the gap of its first row; newest first within a band."""
    bands: list[list] = []
    for r in rows:
        if bands and bands[-1][0].score - r.score <= gap + 1e-9:
            bands[-1].append(r)
        else:
            bands.append([r])
    return [sorted(b, key=lambda r: (r.at is not None and r.at == r.at, r.at if r.at == r.at and r.at is not None else 0), reverse=True) for b in bands]


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def near_duplicate_pointers(texts: list[str], threshold: float = 0.8, chars: int = 300) -> list[int | None]:
    """For each text the first earlier kept text it repeats (word Jaccard over the threshold on its first characters), else None: kept."""
    kept: list[tuple[int, set]] = []
    out: list[int | None] = []
    for i, t in enumerate(texts):
        words = set(t[:chars].split())
        hit = next((j for j, w in kept if words and jaccard(words, w) > threshold), None)
        out.append(hit)
        if hit is None:
            kept.append((i, words))
    return out


def repeat_streak(messages: list[tuple[str, str]], window: int = 6, threshold: float = 0.8) -> int:
    """How many user messages running, from the one before the last backwards, resemble the last user message; of (role, text) only the last few messages count."""
    said = [set(t.lower().split()) for role, t in messages[-window:] if role == "user"]
    n = 0
    for w in reversed(said[:-1]):
        if jaccard(said[-1], w) < threshold:
            break
        n += 1
    return n


def knapsack(items: list[tuple[int, int, float, bool]], budget: int) -> list[bool]:
    """(cost, priority, relevance, mandatory) in original order: mandatory first, whatever they cost, then by falling priority and relevance, skipping what does not fit."""
    if budget <= 0:
        return [False] * len(items)
    chosen, left = [must for *_, must in items], budget - sum(c for c, *_, must in items if must)
    for i in sorted((i for i, x in enumerate(items) if not x[3]), key=lambda i: (-items[i][1], -items[i][2], i)):
        if items[i][0] <= left:
            chosen[i], left = True, left - items[i][0]
    return chosen


def select_history(items: list[tuple[int, float]], k: int, budget: int, always: int = 4, least: float = 0.3) -> list[bool]:
    """(cost, similarity) oldest first: the last few always, then the most similar that fit; a history no longer than the last few stays whole."""
    n = len(items)
    if n <= always:
        return [True] * n
    chosen = [i >= n - min(always, k) for i in range(n)]
    left = budget - sum(c for (c, _), x in zip(items, chosen) if x)
    for i in sorted((i for i in range(n) if not chosen[i] and items[i][1] >= least), key=lambda i: (-items[i][1], i)):
        if sum(chosen) < k and items[i][0] <= left:
            chosen[i], left = True, left - items[i][0]
    return chosen


def ttl_counts(times: list[float], ttl: float) -> list[int]:
    """Running count since the first hit of a life; a hit after the life's end starts another."""
    out, start, n = [], None, 0
    for t in times:
        if start is None or t - start >= ttl:
            start, n = t, 0
        n += 1
        out.append(n)
    return out
