"""Registration of queries with their SQL, and the knowledge-base tables derived from the test tables.

A derived table is a base table and a list of expressions that mean the same in Spark SQL and in
DuckDB, so one text serves both sides.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: "Now" for every rule that looks back in time.
AS_OF = "2024-01-31 00:00:00"
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name: (base table, filter or None, expressions)
VIEWS: dict[str, tuple[str, str | None, list[str]]] = {
    "docs": ("documents", None, [
        "doc_id", "source AS kb_id", "lang AS category", "substr(text, 1, 60) AS title", "text AS content", "n_chars", "doc_id % 50 AS owner_id", "doc_id % 3 AS tenant_id",
        "CASE doc_id % 5 WHEN 0 THEN 'draft' WHEN 4 THEN 'archived' ELSE 'published' END AS status",
        "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CASE doc_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' ELSE 'secret' END END AS classification",
        "CASE WHEN doc_id % 23 = 0 THEN DATE '2024-01-05' END AS deleted_at", "doc_id % 20 AS series_id", "'/' || source || '/' || CAST(doc_id % 10 AS STRING) AS path", "doc_id % 30 AS parent_id", "doc_id % 4 AS depth",
        "CASE WHEN doc_id % 6 = 0 THEN doc_id % 100 END AS version_of", "(doc_id * 7919) % 1000 AS view_count", "DATE '2024-01-31' + CAST(-(doc_id * 37 % 400) AS INT) AS updated_on",
        "CASE WHEN doc_id % 7 = 0 THEN DATE '2024-01-31' + CAST(doc_id % 61 - 30 AS INT) END AS effective_from", "CASE WHEN doc_id % 9 = 0 THEN DATE '2024-01-31' + CAST(doc_id % 47 - 20 AS INT) END AS effective_to",
        "CASE doc_id % 11 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'parsed' END AS parse_status", "CASE WHEN doc_id % 8 < 3 THEN 'wiki' END AS ext_source", "CASE WHEN doc_id % 8 < 2 THEN doc_id + 1000 END AS ext_id",
        "CASE WHEN doc_id % 16 < 9 THEN DATE '2024-01-31' + CAST(-(doc_id % 13) AS INT) END AS last_checked", "CASE WHEN doc_id % 3 = 0 THEN '/files/' || CAST(doc_id AS STRING) END AS file_path"]),
    "searches": ("events", None, ["event_id", "event_type || ':' || regexp_extract(props, '([0-9]+)', 1) AS query", "event_type = 'click' AS clicked", "event_id % 200 AS clicked_doc_id", "user_id", "ts AS created_at", "value"]),
    "behaviors": ("events", "event_type <> 'error'", ["event_id", "user_id", "CAST(floor(value * 100) AS BIGINT) % 200 AS doc_id", "event_type AS action_type", "CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 4 ELSE 6 END AS half_weight", "ts AS acted_at"]),
    "usage": ("orders", None, ["o_orderkey AS id", "o_orderpriority AS model", "o_custkey AS user_id", "o_orderkey % 5000 AS input_tokens", "o_orderkey % 900 AS output_tokens", "CAST(floor(o_totalprice) AS BIGINT) AS cost_cents",
        "CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 4000 END AS duration_ms", "o_orderstatus <> 'P' AS success", "o_orderdate AS created_at", "CASE o_orderkey % 3 WHEN 0 THEN 'chat' WHEN 1 THEN 'search' ELSE 'embed' END AS request_type"]),
    "messages": ("conversations", None, ["conv_id", "turn", "role", "text AS content", "conv_id * 1000 + turn AS msg_id", "CASE WHEN role = 'assistant' THEN CASE (conv_id + turn) % 6 WHEN 0 THEN 5 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 4 END END AS rating", "conv_id % 7 AS owner_id"]),
    "questions": ("orders", None, ["o_orderkey AS id", "o_custkey AS author_id", "'Question ' || CAST(o_orderkey AS STRING) AS title", "CASE WHEN o_orderkey % 4 <> 0 THEN 'about ' || o_orderpriority END AS content", "CASE WHEN o_orderkey % 29 = 0 THEN o_orderdate END AS deleted_at", "o_orderdate AS created_at"]),
    "answers": ("lineitem", None, ["l_orderkey * 10 + l_linenumber AS id", "l_orderkey AS question_id", "l_suppkey AS author_id", "'Answer ' || CAST(l_partkey AS STRING) AS content", "l_linenumber = 1 AS is_accepted", "l_partkey % 12 AS vote_count", "l_linenumber % 2 = 0 AS is_ai_generated", "CASE WHEN l_partkey % 31 = 0 THEN l_shipdate END AS deleted_at", "l_shipdate AS created_at"]),
    "users": ("customer", None, ["c_custkey AS user_id", "c_name AS name", "c_nationkey AS dept_id", "CASE c_nationkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' ELSE 'secret' END AS clearance", "c_custkey % 3 AS tenant_id", "c_custkey % 9 <> 0 AS is_active"]),
    "feedback": ("labels", None, ["doc_id AS id", "CASE WHEN quality = 1 AND toxic = 0 AND doc_id % 3 <> 0 THEN 'praise' WHEN toxic = 1 THEN 'complaint' WHEN quality = 0 THEN 'bug' ELSE 'suggestion' END AS type", "CASE doc_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' WHEN 2 THEN 'closed' ELSE 'processing' END AS status", "CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'normal' ELSE 'low' END AS priority", "CASE WHEN doc_id % 2 = 0 THEN doc_id END AS doc_id", "doc_id % 40 AS message_id"]),
    "spans": ("events", None, ["event_id", "user_id AS trace_id", "event_type AS name", "ts AS started_at", "CAST(floor(value * 10) AS BIGINT) AS latency_ms", "event_type = 'error' AS is_error", "event_id % 11 = 0 AS is_root", "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS tokens"]),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one data folder, base or derived, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        base, where, exprs = VIEWS[name]
        df = getattr(self, base)
        return (df.where(where) if where else df).selectExpr(*exprs)


def _with_views(sql: str) -> str:
    """The SQL with the derived tables it names in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    ctes = ", ".join(f"{v} AS (SELECT {', '.join(VIEWS[v][2])} FROM {VIEWS[v][0]}" + (f" WHERE {VIEWS[v][1]}" if VIEWS[v][1] else "") + ")" for v in used)
    body = sql.strip()
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body):
        return f"WITH {m[1] or ''}{ctes}, {body[m.end():]}"
    return f"WITH {ctes} {body}"


def query(name: str, sql: str | None = None):
    """Register f(tables) under a name, with the SQL that gives the same rows."""

    def wrap(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, sf_dir))

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = _with_views(sql)
        return f

    return wrap


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def load() -> None:
    for m in ("relational", "aggregates", "text", "retrieval", "learning", "streams"):
        importlib.import_module(f"{__package__}.{m}")


load()
