"""Scalar maths on columns and arrays, all JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero norm or unequal lengths."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def minmax(value: str, keys: list[str]) -> Column:
    """Min-max within a result list; a constant list gives 1."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi == lo, F.lit(1.0)).otherwise((F.col(value) - lo) / (hi - lo))


def cost_cents(model: Column, n_in: Column, n_out: Column, prices: list[tuple[str, int, int]]) -> Column:
    """Whole cents by the first price whose name prefix fits; no price, no cost."""
    return reduce(lambda rest, p: F.when(model.startswith(p[0]), F.floor((n_in * p[1] + n_out * p[2]) / 1_000_000)).otherwise(rest), reversed(prices), F.lit(0)).cast("long")


def dynamic_threshold(freq: Column) -> Column:
    """0.3, and 0.1 more for frequent queries or 0.05 less for rare ones, within 0.1 and 0.6."""
    return F.round(clamp(F.when(freq >= 10, F.lit(0.3) + 0.1).otherwise(F.lit(0.3) - 0.05), 0.1, 0.6), 4)


def decay(age_days: Column, half_life: float) -> Column:
    """Half-life decay; ages below 0 count as 0; no half-life, no weight."""
    return F.round(F.exp(-0.6931471805599453 * F.greatest(age_days, F.lit(0.0)) / half_life), 4) if half_life > 0 else F.lit(0.0)


def dcg(rels: Column) -> Column:
    """Discounted gain of an array of relevances in rank order."""
    return F.aggregate(F.transform(rels, lambda r, i: r.cast("double") / F.log2((i + 2).cast("double"))), F.lit(0.0), lambda s, x: s + x)


def recall_at(ranked: Column, relevant: Column, k: int) -> Column:
    hits = F.size(F.filter(F.slice(ranked, 1, k), lambda d: F.array_contains(relevant, d)))
    n = F.size(F.array_distinct(relevant))
    return F.when(n == 0, F.lit(0.0)).otherwise(hits / n)


def reciprocal_rank(ranked: Column, relevant: Column) -> Column:
    at = F.array_min(F.filter(F.transform(ranked, lambda d, i: F.when(F.array_contains(relevant, d), i + 1)), lambda x: x.isNotNull()))
    return F.coalesce(1.0 / at, F.lit(0.0))


def ndcg_at(ranked: Column, relevant: Column, k: int) -> Column:
    gain = dcg(F.transform(F.slice(ranked, 1, k), lambda d: F.array_contains(relevant, d).cast("int")))
    best = dcg(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.size(F.array_distinct(relevant))))), lambda x: F.lit(1)))
    return F.when(F.size(relevant) == 0, F.lit(0.0)).otherwise(gain / best)


def average_precision(ranked: Column, relevant: Column) -> Column:
    """Mean over the relevant items of the precision at each hit."""
    state = F.aggregate(
        ranked,
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("hits"), F.lit(0.0).alias("sum")),
        lambda s, d: F.struct((s["i"] + 1).alias("i"), (s["hits"] + F.array_contains(relevant, d).cast("int")).alias("hits"),
                              (s["sum"] + F.when(F.array_contains(relevant, d), (s["hits"] + 1).cast("double") / (s["i"] + 1)).otherwise(0.0)).alias("sum")),
    )
    n = F.size(F.array_distinct(relevant))
    return F.when(n == 0, F.lit(0.0)).otherwise(state["sum"] / n)


def supported(answer: Column, contexts: Column, empty: float) -> Column:
    """Share of an answer's sentences of whose tokens more than half are in the contexts: faithfulness of an answer, recall of an expected one.  empty: the score of an answer without sentences."""
    from .text import mixed_tokens, strip

    known = mixed_tokens(F.array_join(contexts, "\n"))
    parts = F.filter(F.transform(F.split(answer, "。"), strip), lambda s: s != "")
    held = F.filter(parts, lambda s: F.size(F.array_intersect(mixed_tokens(s), known)) > F.size(mixed_tokens(s)) * 0.5)
    return F.when(F.size(parts) == 0, F.lit(empty)).otherwise(F.size(held) / F.size(parts))


def graded_precision(expected: Column, contexts: Column, k: int = 5) -> Column:
    """nDCG over the first k contexts with the share of the expected answer's tokens that each holds as its grade; 1 where nothing is expected, 0 without contexts or grades."""
    from .text import mixed_tokens

    wanted = mixed_tokens(expected)
    rel = F.transform(contexts, lambda c: F.least(F.size(F.array_intersect(wanted, mixed_tokens(c))) / F.greatest(F.size(wanted), F.lit(1)), F.lit(1.0)))
    gain = lambda a: F.aggregate(F.transform(F.slice(a, 1, k), lambda x, i: x / F.log2(i + 2)), F.lit(0.0), lambda s, x: s + x)
    best = gain(F.sort_array(rel, asc=False))
    return F.when(F.size(contexts) == 0, 0.0).when(F.coalesce(expected, F.lit("")) == "", 1.0).when(best == 0, 0.0).otherwise(gain(rel) / best)
