"""Queries: windows, sessions, counters and event folds, in batch form; tests run the same functions as streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..streaming import state, windows
from .registry import Tables, query


@query("stm_tumbling_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS v100 FROM events GROUP BY 1, 2")
def _(t: Tables):
    return windows.tumbling(t.events, "1 hour")


@query("stm_sliding_window", "SELECT start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM (SELECT event_type, time_bucket(INTERVAL 30 MINUTES, ts) - to_minutes(CAST(30 * i AS INT)) AS start FROM events, range(2) r(i)) GROUP BY 1")
def _(t: Tables):
    return windows.sliding(t.events, "1 hour", "30 minutes")


@query("stm_session_window", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOURS > ts THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def _(t: Tables):
    return windows.sessions(t.events, "6 hours")


@query("stm02_trailing_window", "SELECT event_id, count(*) OVER w AS n, count(*) FILTER (WHERE event_type = 'error') OVER w AS errors FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)")
def _(t: Tables):
    e = t.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-6 * 3600 * 1_000_000, 0)
    return e.select("event_id", F.count("*").over(w).alias("n"), F.count_if(F.col("event_type") == "error").over(w).alias("errors"))


@query("stm03_ttl_counter", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, us AS start, 1 AS n FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.us - r.start >= 86400000000 THEN e.us ELSE r.start END, CASE WHEN e.us - r.start >= 86400000000 THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, n FROM r""")
def _(t: Tables):
    e = t.events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return state.running_lives(e, "user_id", ["at", "event_id"], "at", 86_400_000_000, ["user_id", "event_id"])


@query("stm05_running_counters", "SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY 1, 2")
def _(t: Tables):
    return windows.counters(t.events, ["user_id", "event_type"])


@query("stm06_event_tail", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) WHERE seq > 40 AND seq <= 50")
def _(t: Tables):
    e = t.events.withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.where("seq > 40 and seq <= 50").select("user_id", "event_id")


@query("stm08_webhook_idempotency", "SELECT props AS key, count(*) - 1 AS repeats FROM events GROUP BY props")
def _(t: Tables):
    first = windows.first_seen(t.events.select("ts", "props"), "props", "1 hour").select(F.col("props").alias("key"), F.lit(-1).alias("d"))
    return t.events.select(F.col("props").alias("key"), F.lit(1).alias("d")).unionByName(first).groupBy("key").agg(F.sum("d").alias("repeats"))


@query("stm10_rolling_ttl", "SELECT user_id, max(ts) + INTERVAL 7 DAYS < TIMESTAMP '2024-01-31' AS expired FROM events GROUP BY user_id")
def _(t: Tables):
    last = F.max("ts")
    return t.events.groupBy("user_id").agg((last + F.expr("interval 7 days") < F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).alias("expired"))


@query("stm10b_rolling_lives", "SELECT user_id, min(ts) AS start, count(*) AS n, max(ts) + INTERVAL 6 HOURS AS until, max(ts) + INTERVAL 6 HOURS <= TIMESTAMP '2024-01-31' AS expired FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOURS > ts THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def _(t: Tables):
    # every touch prolongs a life; what ended before now has expired
    s = windows.sessions(t.events, "6 hours", until=True)
    return s.withColumn("expired", F.col("until") <= F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))


@query("mp02_state_fold", "SELECT user_id, event_type AS field, CASE WHEN event_type IN ('click', 'view') THEN string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) ELSE CAST(max(event_id) AS VARCHAR) END AS value FROM events GROUP BY user_id, event_type")
def _(t: Tables):
    log = t.events.select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("field"), F.col("event_id").cast("string").alias("value"), F.col("event_type").isin("click", "view").alias("is_list"))
    return state.fold_events(log, "user_id")


@query("udf08_builder_registry", "SELECT 'sft' AS builder, count(*) AS n FROM (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'user') > 0 AND count(*) FILTER (WHERE role = 'assistant') > 0) UNION ALL SELECT 'answers', count(*) FROM answers WHERE is_accepted")
def _(t: Tables):
    from .learning import pairs

    builders = {"sft": pairs, "answers": lambda x: x.answers.where("is_accepted")}
    out = [f(t).agg(F.count("*").alias("n")).select(F.lit(k).alias("builder"), "n") for k, f in builders.items()]
    return out[0].unionByName(out[1])


@query("udf03_reranker_hook", "SELECT item_id, length(text) % 7 AS score FROM benchmark")
def _(t: Tables):
    from ..functions.hooks import rerank

    return rerank(t.benchmark.select("item_id", "text"), "text", lambda texts: [len(x) % 7 for x in texts]).select("item_id", "score")


@query("udf05_permission_hook", "SELECT doc_id FROM docs WHERE kb_id IN ('src1', 'src2')")
def _(t: Tables):
    hook = lambda df: R.accessible(df, ["src1", "src2"])
    return hook(t.docs).select("doc_id")


@query("udf01_embedder_hook", "SELECT item_id, CAST(length(text) AS DOUBLE) AS first_component FROM benchmark")
def _(t: Tables):
    from ..functions.hooks import embed

    return embed(t.benchmark, "text", lambda texts: [[float(len(x)), 1.0] for x in texts]).select("item_id", F.col("embedding")[0].alias("first_component"))


@query("udf04_model_hook", "SELECT item_id, '[' || substr(text, 1, 10) || ']' AS reply FROM benchmark")
def _(t: Tables):
    from ..functions.hooks import complete

    return complete(t.benchmark, "text", lambda texts: [f"[{x[:10]}]" for x in texts]).select("item_id", "reply")


@query("udf11_entity_registration", """WITH e AS (SELECT 'N' || n_nationkey AS canonical, 'nation' AS type, n_name AS display, ['Land ' || n_nationkey % 7, ''] AS synonyms, n_nationkey AS seq FROM nation UNION ALL SELECT 'S' || s_suppkey % 50, 'supplier', s_name, ['Land ' || s_suppkey % 9, upper(s_name)], 100 + s_suppkey FROM supplier),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY seq DESC) AS k FROM e) WHERE k = 1), t AS (SELECT DISTINCT canonical, type, seq, lower(unnest(list_concat([canonical, display], synonyms))) AS term FROM l)
SELECT term, canonical AS entity, type FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY seq DESC, canonical DESC) AS k FROM t WHERE term <> '') WHERE k = 1""")
def _(t: Tables):
    from ..operators.dictionary import registered

    one = t.nation.selectExpr("'N' || n_nationkey AS canonical", "'nation' AS type", "n_name AS display", "array('Land ' || n_nationkey % 7, '') AS synonyms", "CAST(n_nationkey AS BIGINT) AS at")
    two = t.supplier.selectExpr("'S' || s_suppkey % 50", "'supplier'", "s_name", "array('Land ' || s_suppkey % 9, upper(s_name))", "CAST(100 + s_suppkey AS BIGINT)")
    return registered(one.union(two))


@query("udf07_document_adapter", "SELECT CAST(item_id AS VARCHAR) AS doc_id, text AS content, '1' AS revision FROM benchmark")
def _(t: Tables):
    from ..sources.adapter import TableAdapter, read

    path = f"{t.sf_dir}/benchmark.parquet"
    return read(t.spark, "loomlake_items", lambda: TableAdapter(path, "item_id", "text", "text")).select("doc_id", "content", "revision")


@query("snk14_dead_letters", "SELECT count(*) FILTER (WHERE value >= 5) AS passed, count(*) FILTER (WHERE value < 5) AS failed FROM events")
def _(t: Tables):
    from ..operators.store import dead_letters

    ok, bad = dead_letters(t.events, F.col("value") >= 5, F.lit("low value"))
    return ok.agg(F.count("*").alias("passed")).crossJoin(F.broadcast(bad.agg(F.count("*").alias("failed"))))  # one row each
