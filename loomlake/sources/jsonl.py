"""JSON-lines sources: tolerant line parsing, evaluation cases, conversion to training samples; and the versioned JSONL sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSONL files; blank, malformed and non-object lines are left out."""
    return parse_lines(spark.read.text(path), "value", schema).drop("value")


def parse_lines(df: DataFrame, line: str, schema: str) -> DataFrame:
    """df with the fields of its JSON lines; lines that are no JSON object leave."""
    ok = F.col(line).rlike(r"^\s*\{") & F.try_parse_json(line).isNotNull()
    return df.where(ok).withColumn("__j", F.from_json(line, schema)).select("*", "__j.*").drop("__j")


def load_eval_cases(df: DataFrame, line: str) -> DataFrame:
    """Evaluation cases: lines without JSON (comments too) or without a query leave; fields are text; the type defaults; a fingerprint of 12 hex digits."""
    c = parse_lines(df, line, "query string, case_id string, case_type string").where("coalesce(query, '') <> ''")
    kind = F.coalesce("case_type", F.lit("normal"))
    return c.select("case_id", "query", kind.alias("case_type"), F.substring(F.sha1(F.concat_ws("\x1f", "query", "case_id", kind)), 1, 12).alias("fingerprint"))


def to_sft(conversations: DataFrame) -> DataFrame:
    """First non-empty user and assistant texts of each conversation; conversations without both leave."""
    first = lambda role: F.min_by("text", F.when((F.col("role") == role) & (F.trim("text") != ""), F.col("turn")))
    got = conversations.groupBy("conv_id").agg(first("user").alias("question"), first("assistant").alias("answer"))
    return got.where("question is not null and answer is not null")


def write_jsonl(df: DataFrame, base: str, tenant: str | None, version: str, kind: str) -> str:
    """<base>/<tenant or default>/<version>/<kind> as JSON lines; returns the folder."""
    path = f"{base}/{tenant or 'default'}/{version}/{kind}"
    df.write.mode("overwrite").json(path)
    return path
