"""Dictionary matching: all terms of a table in the texts of another, by automata over the terms.

The terms go to the tasks as Aho-Corasick automata of at most MOST terms each, one pass a text and automaton, so
work grows with texts and matches, not with texts times terms, and what is broadcast is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

#: Terms of one automaton, at most.
MOST = 500_000
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
HITS = "array<struct<start:int,end:int,term:string>>"


def _automaton(terms: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    a.make_automaton()
    return a


def _found(a, text: str) -> list[tuple[int, int, str]]:
    """Places of all terms, those within a longer ASCII word left out; end is past the last character."""
    out = []
    for last, t in a.iter(text):
        start, end = last - len(t) + 1, last + 1
        if (t[0] not in _WORD or start == 0 or text[start - 1] not in _WORD) and (t[-1] not in _WORD or end == len(text) or text[end] not in _WORD):
            out.append((start, end, t))
    return sorted(out)


def _finder(sent):
    @F.pandas_udf(HITS)
    def find(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = _automaton(sent.value)  # once a task
        for s in it:
            yield s.map(lambda t: [{"start": x, "end": y, "term": w} for x, y, w in _found(a, t)] if t else [])

    return find


def longest(hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """From the left, at each place the longest match, and on after its end."""
    out, end = [], 0
    for start, stop, t in sorted(hits, key=lambda h: (h[0], -h[1])):
        if start >= end:
            out.append((start, stop, t))
            end = stop
    return out


def term_matches(texts: DataFrame, terms: DataFrame, overlaps: bool = True, text: str = "text", term: str = "term") -> DataFrame:
    """texts with `hits`: places (start, end, term) of the terms in the lower-cased text, all or the longest from the left.

    A term of ASCII letters and digits at an end must end a word there; other scripts match anywhere.  Case does not
    matter; null and empty terms match nothing, null texts have no hits.
    """
    spark = texts.sparkSession
    ship(spark)
    distinct = cut(terms.select(F.lower(term).alias("term")).where("term <> ''").distinct(), "terms")
    parts = max(1, -(-distinct.count() // MOST))
    out = texts.withColumn("hits", F.array().cast(HITS))
    for p in range(parts):
        own = [r.term for r in distinct.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == p).collect()]  # at most about MOST
        if not own:
            continue
        sent = spark.sparkContext.broadcast(sorted(own))

        out = out.withColumn("hits", F.concat("hits", _finder(sent)(F.lower(F.col(text)))))
    if not overlaps:

        @F.pandas_udf(HITS)
        def pick(s: pd.Series) -> pd.Series:
            return s.map(lambda hits: [{"start": x, "end": y, "term": w} for x, y, w in longest([(h["start"], h["end"], h["term"]) for h in hits])])

        out = out.withColumn("hits", pick("hits"))
    return out


def entities_of(texts: DataFrame, synonyms: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, entity): the entities of synonyms (term, entity) that a text names."""
    hit = term_matches(texts.select(key, text), synonyms, text=text).select(key, F.explode("hits.term").alias("term"))
    return hit.distinct().join(synonyms.select(F.lower("term").alias("term"), "entity").distinct(), "term").select(key, "entity").distinct()


def expanded(texts: DataFrame, synonyms: DataFrame, key: str, text: str = "text") -> DataFrame:
    """texts (key, text) with all synonyms of the entities they name behind the text, in order; what a full-text search asks for."""
    more = entities_of(texts, synonyms, key, text).join(synonyms.distinct(), "entity").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("__more"))
    return texts.join(more, key, "left").select(key, said(F.col(text), F.col("__more")).alias(text))


def said(text: Column, more: Column) -> Column:
    return F.when(more.isNotNull(), F.concat(text, F.lit(" "), more)).otherwise(text)


def registered(entities: DataFrame) -> DataFrame:
    """(term, entity, type): the synonym index of registered entities (canonical, type, display, synonyms, at).

    Of registrations of one canonical name the latest counts; its name, display name and synonyms, in lower case, stand
    for it, and a term that several name stands for the entity that was registered last (then the greater name).
    """
    last = entities.groupBy("canonical").agg(F.max_by(F.struct("type", "display", "synonyms", "at"), "at").alias("e")).select("canonical", "e.*")
    names = F.concat(F.array("canonical", "display"), F.coalesce("synonyms", F.array().cast("array<string>")))
    each = last.select("canonical", "type", "at", F.explode(F.array_distinct(F.transform(names, F.lower))).alias("term")).where("term <> ''")
    return each.groupBy("term").agg(F.max(F.struct("at", "canonical", "type")).alias("e")).select("term", F.col("e.canonical").alias("entity"), "e.type")
