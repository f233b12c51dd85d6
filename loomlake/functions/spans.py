"""Spans with offsets, and the verification of amounts, dates and legal terms of an answer against its sources; built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import DATE, LEGAL

# An amount is a number and one of these units, whatever its case.
AMOUNT = r"(?i)(\d[\d,]*(?:\.\d+)?)\s*(元|万元|亿元|美元|欧元|人民币|港币|日元|英镑|USD|EUR|CNY|RMB|JPY|GBP|HKD)"
#: Relative deviations of an unverified amount from the nearest one in the sources: below the first low, up to the second medium, above it high.
LOW, MEDIUM = 0.01, 0.10
SPAN = "struct<type:string,value:string,start:int,end:int>"


def spans(c: Column, pattern: str, kind: str) -> Column:
    """(type, value, start, end) of every match: the text between the matches gives their offsets (in code points, end past the last).  The pattern must not match the empty text."""
    found, between = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
    length = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + F.length(x))

    def span(value: Column, i: Column) -> Column:
        start = length(between, i + 1) + length(found, i)
        return F.struct(F.lit(kind).alias("type"), value.alias("value"), start.alias("start"), (start + F.length(value)).alias("end"))

    return F.transform(found, span)


def high_risk_spans(c: Column) -> Column:
    """Amounts, dates and legal terms of a text, by type and place; of each term the places that do not overlap."""
    none = F.array().cast(f"array<{SPAN}>")
    terms = [F.when(c.contains(t), spans(c, t, "legal_term")).otherwise(none) for t in LEGAL]
    return F.sort_array(F.concat(spans(c, AMOUNT, "amount"), spans(c, DATE, "date"), *terms))


def amounts(c: Column) -> Column:
    """(value, unit) of every amount in a text; units are compared as they stand, in lower case."""
    number, unit = (F.regexp_extract_all(c, F.lit(AMOUNT), F.lit(g)) for g in (1, 2))
    return F.zip_with(number, unit, lambda n, u: F.struct(F.replace(n, F.lit(","), F.lit("")).cast("double").alias("value"), F.lower(u).alias("unit")))


def verified_spans(items: Column, sources: Column) -> Column:
    """items with verified, level and deviation against the texts of an array.

    A legal term is verified where a source has it; an amount or date where one has it but for blanks and commas, an
    amount also by value and unit.  An unverified amount is high where no source has its unit.  Without sources nothing
    is verified and no level is given.
    """
    texts = F.filter(sources, lambda s: s.isNotNull() & (s != ""))
    bare = lambda x: F.replace(F.replace(x, F.lit(" "), F.lit("")), F.lit(","), F.lit(""))
    known = F.flatten(F.transform(texts, amounts))

    def judge(x: Column) -> Column:
        own = F.element_at(amounts(x["value"]), 1)
        money = x["type"] == "amount"
        same = F.transform(F.filter(known, lambda k: k["unit"] == own["unit"]), lambda k: k["value"])
        plain = F.exists(texts, lambda s: F.when(x["type"] == "legal_term", F.contains(s, x["value"])).otherwise(F.contains(bare(s), bare(x["value"]))))
        ok = plain | (money & F.exists(same, lambda v: v == own["value"]))
        off = F.array_min(F.transform(F.filter(same, lambda v: v > 0), lambda v: F.abs(own["value"] - v) / v))
        deviation = F.when(F.size(same) > 0, F.coalesce(off, F.lit(1.0)))
        level = F.when(~money | (deviation < LOW), "low").when(deviation <= MEDIUM, "medium").otherwise("high")
        judged = ~ok & (F.size(texts) > 0)
        return F.struct(x["type"].alias("type"), x["value"].alias("value"), x["start"].alias("start"), x["end"].alias("end"), ok.alias("verified"), F.when(judged, level).alias("level"), F.when(judged & money, deviation).alias("deviation"))

    return F.transform(items, judge)


def risk_action(judged: Column) -> Column:
    """What to do with an answer: block with any high span, confirm with any medium one, warn with anything else unverified, else pass."""
    some = lambda level: F.exists(judged, lambda x: F.coalesce(x["level"] == level, F.lit(False)))
    return F.when(some("high"), "block").when(some("medium"), "confirm").when(F.exists(judged, lambda x: ~x["verified"]), "warn").otherwise("pass")


def any_contains(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])
