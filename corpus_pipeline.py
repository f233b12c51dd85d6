"""Corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomlake.llm import bpe, exact_dedup, mixing, quality, simhash
from loomlake.llm.common import cut, documents

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality.stage),
    ("exact_dedup", exact_dedup.stage),
    ("simhash", simhash.near_stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

#: A trained classifier and a tokenizer file are beyond SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
