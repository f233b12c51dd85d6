"""Document type to parser, with a fallback for types that none knows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARSERS: dict[str, Callable[[Column], Column]] = {
    "md": lambda c: c,
    "txt": lambda c: c,
    "html": lambda c: F.regexp_replace(c, "<[^>]+>", ""),
}


def register(doc_type: str, parser: Callable[[Column], Column]) -> None:
    PARSERS[doc_type] = parser


def parse(df: DataFrame, text: str = "text", doc_type: str = "doc_type") -> DataFrame:
    """df with `parsed`: one expression over all registered types; an unknown type gives empty text."""
    out = F.lit("")
    for kind, parser in PARSERS.items():
        out = F.when(F.col(doc_type) == kind, parser(F.col(text))).otherwise(out)
    return df.withColumn("parsed", out)
