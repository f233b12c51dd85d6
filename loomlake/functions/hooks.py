"""Extension points: embedders, rerankers and language models plug in as batch functions over Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

HOOKS: dict[str, Callable[[list[str]], list]] = {}


def register(name: str, f: Callable[[list[str]], list]) -> None:
    """Name a batch function, as deployments name their providers."""
    HOOKS[name] = f


def _apply(df: DataFrame, text: str, f: Callable[[list[str]], list], out: str, kind: str, cast: Callable) -> DataFrame:
    ship(df.sparkSession)

    @F.pandas_udf(kind)
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series([cast(x) for x in f(s.fillna("").tolist())])

    return df.withColumn(out, run(text))


def rerank(df: DataFrame, text: str, f: Callable[[list[str]], list]) -> DataFrame:
    """df with `score` by a function of batches of texts."""
    return _apply(df, text, f, "score", "long", int)


def embed(df: DataFrame, text: str, f: Callable[[list[str]], list]) -> DataFrame:
    """df with `embedding` by a function of batches of texts."""
    return _apply(df, text, f, "embedding", "array<double>", list)


def complete(df: DataFrame, prompt: str, f: Callable[[list[str]], list]) -> DataFrame:
    """df with `reply` by a function of batches of prompts."""
    return _apply(df, prompt, f, "reply", "string", str)
