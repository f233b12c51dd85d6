"""Queries: analytics, reports, evaluation roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational as R
from .registry import Tables, query
from .relational import gaps

SINCE = "TIMESTAMP '2024-01-10'"


def since(c: str):
    return F.col(c) >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")


def at(s: str):
    return F.lit(s).cast("timestamp_ntz")


@query("agg01_hot_words", f"SELECT query, count(*) AS n FROM searches WHERE created_at >= {SINCE} GROUP BY query ORDER BY n DESC, query LIMIT 20")
def _(t: Tables):
    return t.searches.where(since("created_at")).groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(20)


@query("agg02_zero_click", f"SELECT query, count(*) AS n FROM searches WHERE created_at >= {SINCE} AND NOT clicked GROUP BY query ORDER BY n DESC, query LIMIT 20")
def _(t: Tables):
    return t.searches.where(since("created_at") & ~F.col("clicked")).groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(20)


@query("agg03_popular_documents", "SELECT doc_id, title, view_count FROM docs WHERE status = 'published' ORDER BY view_count DESC, doc_id LIMIT 10")
def _(t: Tables):
    return t.docs.where("status = 'published'").select("doc_id", "title", "view_count").orderBy(F.desc("view_count"), "doc_id").limit(10)


@query("agg04_coverage", f"SELECT (SELECT count(DISTINCT category) FROM docs) AS categories, (SELECT count(DISTINCT query) FROM searches WHERE created_at >= {SINCE}) AS queries")
def _(t: Tables):
    a = t.docs.agg(F.countDistinct("category").alias("categories"))
    return a.crossJoin(F.broadcast(t.searches.where(since("created_at")).agg(F.countDistinct("query").alias("queries"))))


@query("agg05_freshness", "SELECT count(*) AS total, count(*) FILTER (WHERE age > 180) AS expired, count(*) FILTER (WHERE age BETWEEN 151 AND 180) AS expiring, round(CASE WHEN count(*) = 0 THEN 1.0 ELSE 1 - count(*) FILTER (WHERE age > 180) * 1.0 / count(*) END, 4) AS freshness FROM (SELECT DATE '2024-01-31' - updated_on AS age FROM docs WHERE deleted_at IS NULL)")
def _(t: Tables):
    age = F.datediff(F.lit("2024-01-31").cast("date"), "updated_on")
    n = F.count("*")
    return R.scan(t.docs).select(age.alias("age")).agg(n.alias("total"), F.count_if(F.col("age") > 180).alias("expired"), F.count_if(F.col("age").between(151, 180)).alias("expiring"), F.round(F.when(n == 0, 1.0).otherwise(1 - F.count_if(F.col("age") > 180) / n), 4).alias("freshness"))


CONTRIB = "SELECT user_id, CAST(sum(d) AS BIGINT) AS docs_n, CAST(sum(a) AS BIGINT) AS answers_n, CAST(sum(acc) AS BIGINT) AS accepted_n, CAST(sum(c) AS BIGINT) AS comments_n, CAST(sum(d) * 4 + sum(a) * 2 + sum(acc) + sum(c) * 3 AS BIGINT) AS score10 FROM (SELECT owner_id AS user_id, count(*) AS d, 0 AS a, 0 AS acc, 0 AS c FROM docs GROUP BY 1 UNION ALL SELECT author_id, 0, count(*), count(*) FILTER (WHERE is_accepted), 0 FROM answers GROUP BY 1 UNION ALL SELECT user_id, 0, 0, 0, count(*) FROM behaviors GROUP BY 1) GROUP BY user_id"


def contributors(t: Tables):
    n = F.count("*").alias("n")
    parts = {"docs_n": t.docs.groupBy(F.col("owner_id").alias("user_id")).agg(n), "answers_n": t.answers.groupBy(F.col("author_id").alias("user_id")).agg(n), "accepted_n": t.answers.where("is_accepted").groupBy(F.col("author_id").alias("user_id")).agg(n), "comments_n": t.behaviors.groupBy("user_id").agg(n)}
    return R.outer_sum(parts, "user_id").withColumn("score10", F.expr("docs_n * 4 + answers_n * 2 + accepted_n + comments_n * 3"))


@query("agg06_top_contributors", CONTRIB + " ORDER BY score10 DESC, user_id LIMIT 10")
def _(t: Tables):
    return contributors(t).orderBy(F.desc("score10"), "user_id").limit(10)


@query("agg07_expert_finder", "SELECT u.user_id, u.name, e.score100 FROM (SELECT user_id, CAST(sum(s) AS BIGINT) AS score100 FROM (SELECT owner_id AS user_id, 40 * count(*) AS s FROM docs WHERE contains(lower(title), 'and') GROUP BY 1 UNION ALL SELECT author_id, 20 * count(*) + 10 * count(*) FILTER (WHERE is_accepted) FROM answers WHERE contains(content, '1') GROUP BY 1 UNION ALL SELECT user_id, 15 * count(*) FROM behaviors WHERE action_type = 'click' GROUP BY 1) GROUP BY 1 ORDER BY score100 DESC, user_id LIMIT 20) e JOIN users u ON u.user_id = e.user_id ORDER BY score100 DESC, u.user_id LIMIT 10")
def _(t: Tables):
    n = F.count("*")
    d = t.docs.where(F.lower("title").contains("and")).groupBy(F.col("owner_id").alias("user_id")).agg((n * 40).alias("n"))
    a = t.answers.where(F.col("content").contains("1")).groupBy(F.col("author_id").alias("user_id")).agg((n * 20 + F.count_if("is_accepted") * 10).alias("n"))
    c = t.behaviors.where("action_type = 'click'").groupBy("user_id").agg((n * 15).alias("n"))
    e = R.outer_sum({"d": d, "a": a, "c": c}, "user_id").select("user_id", F.expr("d + a + c").alias("score100")).orderBy(F.desc("score100"), "user_id").limit(20)
    return t.users.select("user_id", "name").join(F.broadcast(e), "user_id").orderBy(F.desc("score100"), "user_id").limit(10)  # e has 20 rows


@query("agg08_user_expertise", "SELECT owner_id, coalesce(category, 'other') AS category, count(*) AS n FROM (SELECT owner_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE category END AS category, row_number() OVER (PARTITION BY owner_id ORDER BY updated_on DESC, doc_id) AS k FROM docs) WHERE k <= 50 GROUP BY 1, 2")
def _(t: Tables):
    d = R.latest_by(t.docs.select("owner_id", "doc_id", "updated_on", "category"), ["owner_id"], [F.desc("updated_on"), F.asc("doc_id")], 50)
    return d.groupBy("owner_id", F.coalesce(F.when(F.col("doc_id") % 6 != 0, F.col("category")), F.lit("other")).alias("category")).agg(F.count("*").alias("n"))


@query("agg09_usage_summary", "SELECT count(*) AS requests, count(DISTINCT user_id) AS users, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, CAST(sum(cost_cents) AS BIGINT) AS cents, round(avg(duration_ms), 4) AS avg_ms FROM usage WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '1998-01-01'")
def _(t: Tables):
    u = t.usage.where((F.col("created_at") >= at("1996-01-01 00:00:00")) & (F.col("created_at") < at("1998-01-01 00:00:00")))
    return u.agg(F.count("*").alias("requests"), F.countDistinct("user_id").alias("users"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("cost_cents").alias("cents"), F.round(F.avg("duration_ms"), 4).alias("avg_ms"))


@query("agg10_kb_health", "SELECT kb_id, count(*) AS n, CAST(round(100.0 * (count(*) - count(*) FILTER (WHERE parse_status IN ('failed', 'partial'))) / count(*)) AS INT) AS health FROM docs GROUP BY kb_id")
def _(t: Tables):
    n = F.count("*")
    return t.docs.groupBy("kb_id").agg(n.alias("n"), F.round(100.0 * (n - F.count_if(F.col("parse_status").isin("failed", "partial"))) / n).cast("int").alias("health"))


@query("agg11_usage_time_series", "SELECT grain, bucket, count(*) AS n, CAST(sum(cost_cents) AS BIGINT) AS cents FROM (SELECT cost_cents, unnest([{'grain': 'day', 'bucket': date_trunc('day', created_at)}, {'grain': 'week', 'bucket': date_trunc('week', created_at)}, {'grain': 'month', 'bucket': date_trunc('month', created_at)}], recursive := true) FROM usage) GROUP BY 1, 2".replace("date_trunc('day', created_at)", "CAST(date_trunc('day', created_at) AS DATE)").replace("date_trunc('week', created_at)", "CAST(date_trunc('week', created_at) AS DATE)").replace("date_trunc('month', created_at)", "CAST(date_trunc('month', created_at) AS DATE)"))
def _(t: Tables):
    grains = F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), F.date_trunc(g, "created_at").cast("date").alias("bucket")) for g in ("day", "week", "month")]))
    return t.usage.select("cost_cents", grains.alias("g")).groupBy("g.grain", "g.bucket").agg(F.count("*").alias("n"), F.sum("cost_cents").alias("cents"))


@query("agg12_cost_breakdown", "SELECT model, request_type, count(*) AS n, CAST(sum(cost_cents) AS BIGINT) AS cents FROM usage GROUP BY GROUPING SETS ((model), (request_type), ())")
def _(t: Tables):
    u = t.usage
    return u.groupingSets([[u.model], [u.request_type], []], u.model, u.request_type).agg(F.count("*").alias("n"), F.sum("cost_cents").alias("cents"))


@query("agg13_status_pivot", "SELECT kb_id, count(*) AS total, count(*) FILTER (WHERE status = 'draft') AS draft, count(*) FILTER (WHERE status = 'published') AS published, count(*) FILTER (WHERE status = 'archived') AS archived FROM docs GROUP BY kb_id")
def _(t: Tables):
    return t.docs.groupBy("kb_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("draft", "published", "archived")])


@query("agg14_observability", "SELECT model, CAST(created_at AS DATE) AS day, count(*) AS n, round(100.0 * count(*) FILTER (WHERE success) / count(*), 4) AS success_pct FROM usage GROUP BY GROUPING SETS ((), (model), (CAST(created_at AS DATE)))")
def _(t: Tables):
    u = t.usage.withColumn("day", F.to_date("created_at"))
    n = F.count("*")
    return u.groupingSets([[], [u.model], [u.day]], u.model, u.day).agg(n.alias("n"), F.round(100.0 * F.count_if("success") / n, 4).alias("success_pct"))


@query("agg15_tenant_usage", "SELECT u.tenant_id, u.users_n, d.chars + 512000 * d.files AS bytes FROM (SELECT tenant_id, count(*) AS users_n FROM users WHERE is_active GROUP BY 1) u JOIN (SELECT tenant_id, CAST(coalesce(sum(length(content)), 0) AS BIGINT) AS chars, count(file_path) AS files FROM docs GROUP BY 1) d ON u.tenant_id = d.tenant_id")
def _(t: Tables):
    u = t.users.where("is_active").groupBy("tenant_id").agg(F.count("*").alias("users_n"))
    d = t.docs.groupBy("tenant_id").agg(F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"), F.count("file_path").alias("files"))
    return u.join(d, "tenant_id").select("tenant_id", "users_n", F.expr("chars + 512000 * files").alias("bytes"))


@query("agg16_site_stats", "SELECT (SELECT count(*) FROM docs) AS docs_n, (SELECT count(DISTINCT kb_id) FROM docs) AS kbs, (SELECT count(DISTINCT conv_id) FROM conversations) AS convs, (SELECT count(DISTINCT user_id) FROM events) AS active_users")
def _(t: Tables):
    parts = [t.docs.agg(F.count("*").alias("docs_n"), F.countDistinct("kb_id").alias("kbs")), t.conversations.agg(F.countDistinct("conv_id").alias("convs")), t.events.agg(F.countDistinct("user_id").alias("active_users"))]
    return parts[0].crossJoin(F.broadcast(parts[1])).crossJoin(F.broadcast(parts[2]))  # one row each


@query("agg17_feedback_distribution", "SELECT type, status, priority, count(*) AS n FROM feedback GROUP BY GROUPING SETS ((type), (status), (priority), ())")
def _(t: Tables):
    f = t.feedback
    return f.groupingSets([[f.type], [f.status], [f.priority], []], f.type, f.status, f.priority).agg(F.count("*").alias("n"))


@query("agg18_improvement_rules", "SELECT type, count(*) AS n FROM (SELECT * FROM feedback ORDER BY id LIMIT 1000) GROUP BY type HAVING count(*) >= CASE type WHEN 'bug' THEN 3 WHEN 'suggestion' THEN 3 WHEN 'complaint' THEN 2 ELSE 5 END")
def _(t: Tables):
    g = t.feedback.orderBy("id").limit(1000).groupBy("type").agg(F.count("*").alias("n"))
    return g.where(F.col("n") >= F.when(F.col("type").isin("bug", "suggestion"), 3).when(F.col("type") == "complaint", 2).otherwise(5))


@query("agg19_compounding_stats", "SELECT p_brand, p_type, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS reused FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
def _(t: Tables):
    p = t.part
    return p.groupingSets([[p.p_brand], [p.p_type], []], p.p_brand, p.p_type).agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("reused"))


@query("agg20_retrieval_quality", "SELECT query, round(coalesce(avg(v), 0.0), 6) AS mean_score, coalesce(avg(v), 0.0) >= 0.5 AS passed FROM (SELECT query, CASE WHEN value >= 10 THEN value / 100 END AS v FROM searches) GROUP BY query")
def _(t: Tables):
    m = F.coalesce(F.avg(F.when(F.col("value") >= 10, F.col("value") / 100)), F.lit(0.0))
    return t.searches.groupBy("query").agg(F.round(m, 6).alias("mean_score"), (m >= 0.5).alias("passed"))


@query("agg21_test_platform_stats", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(100.0 * count(*) FILTER (WHERE l_tax < 0.04) / count(*), 2) AS pass_rate FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def _(t: Tables):
    l = t.lineitem
    n = F.count("*")
    return l.groupingSets([[l.l_returnflag], [l.l_linestatus], []], l.l_returnflag, l.l_linestatus).agg(n.alias("n"), F.round(100.0 * F.count_if(F.col("l_tax") < 0.04) / n, 2).alias("pass_rate"))


@query("agg22_next_case_number", "SELECT 'TC-' || lpad(CAST(CAST(substr(max(case_no), 4) AS BIGINT) + 1 AS VARCHAR), 7, '0') AS next_no FROM (SELECT 'TC-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS case_no FROM orders)")
def _(t: Tables):
    last = t.orders.select(F.concat(F.lit("TC-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).alias("c")).agg(F.max("c").alias("c"))
    return last.select(F.concat(F.lit("TC-"), F.lpad((F.substring("c", 4, 20).cast("long") + 1).cast("string"), 7, "0")).alias("next_no"))


@query("agg23_document_quality", "SELECT d.doc_id, round(0.4 * (CASE WHEN length(title) > 0 THEN 1 ELSE 0 END + CASE WHEN length(content) > 200 THEN 1 ELSE 0 END + CASE WHEN classification IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN file_path IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN ext_source IS NOT NULL THEN 1 ELSE 0 END) / 5.0 + 0.3 * CASE WHEN coalesce(praise + bad, 0) = 0 THEN 0.5 ELSE praise * 1.0 / (praise + bad) END + 0.3 * CASE WHEN coalesce(n, 0) = 0 THEN 0.5 ELSE done * 1.0 / n END, 6) AS score FROM docs d LEFT JOIN (SELECT id AS doc_id, count(*) AS n, count(*) FILTER (WHERE type = 'praise') AS praise, count(*) FILTER (WHERE type IN ('bug', 'complaint')) AS bad, count(*) FILTER (WHERE status IN ('resolved', 'closed')) AS done FROM feedback GROUP BY 1) f ON f.doc_id = d.doc_id")
def _(t: Tables):
    f = t.feedback.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n"), F.count_if(F.col("type") == "praise").alias("praise"), F.count_if(F.col("type").isin("bug", "complaint")).alias("bad"), F.count_if(F.col("status").isin("resolved", "closed")).alias("done"))
    flag = lambda c: F.when(c, 1).otherwise(0)
    d = t.docs.select("doc_id", (flag(F.length("title") > 0) + flag(F.length("content") > 200) + flag(F.col("classification").isNotNull()) + flag(F.col("file_path").isNotNull()) + flag(F.col("ext_source").isNotNull())).alias("full"))
    liked = F.when(F.coalesce(F.col("praise") + F.col("bad"), F.lit(0)) == 0, 0.5).otherwise(F.col("praise") / (F.col("praise") + F.col("bad")))
    done = F.when(F.coalesce("n", F.lit(0)) == 0, 0.5).otherwise(F.col("done") / F.col("n"))
    return d.join(f, "doc_id", "left").select("doc_id", F.round(0.4 * F.col("full") / 5.0 + 0.3 * liked + 0.3 * done, 6).alias("score"))


@query("agg24_knowledge_gaps", "SELECT topic, search_count FROM (SELECT trim(query) AS topic, count(*) AS search_count FROM searches WHERE NOT clicked GROUP BY 1) WHERE search_count >= 5")
def _(t: Tables):
    return gaps(t).where("search_count >= 5").select("topic", "search_count")


@query("agg25_misjudgment_rate", "SELECT type, round(count(*) FILTER (WHERE status = 'closed') * 1.0 / nullif(count(*) FILTER (WHERE status IN ('closed', 'resolved')), 0), 6) AS rate FROM feedback GROUP BY type")
def _(t: Tables):
    done = F.count_if(F.col("status").isin("closed", "resolved"))
    return t.feedback.groupBy("type").agg(F.round(F.when(done != 0, F.count_if(F.col("status") == "closed") / done), 6).alias("rate"))


@query("agg26_red_team", "SELECT type, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM (SELECT type, round(sum(w * v) / sum(w) * 100, 4) AS score FROM (SELECT type, CASE priority WHEN 'high' THEN 10 WHEN 'normal' THEN 4 ELSE 1 END AS w, CASE status WHEN 'resolved' THEN 1.0 WHEN 'closed' THEN 0.5 ELSE 0.0 END AS v FROM feedback) GROUP BY type)")
def _(t: Tables):
    w = F.when(F.col("priority") == "high", 10).when(F.col("priority") == "normal", 4).otherwise(1)
    v = F.when(F.col("status") == "resolved", 1.0).when(F.col("status") == "closed", 0.5).otherwise(0.0)
    s = t.feedback.groupBy("type").agg(F.round(F.sum(w * v) / F.sum(w) * 100, 4).alias("score"))
    c = F.col("score")
    return s.withColumn("grade", F.when(c >= 90, "A").when(c >= 80, "B").when(c >= 60, "C").when(c >= 40, "D").otherwise("F"))


@query("agg27_weighted_mean", "SELECT round(sum(m * n) / sum(n), 6) AS mean FROM (SELECT o_orderpriority, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1)")
def _(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"), F.count("*").alias("n")).agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("mean"))


@query("agg28_rollup_of_json_metrics", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(*) AS n FROM events GROUP BY event_type")
def _(t: Tables):
    return t.events.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"), F.count("*").alias("n"))


@query("agg29_run_aggregate", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.99) AS p99, count(*) FILTER (WHERE value >= 50) AS passed FROM events GROUP BY event_type")
def _(t: Tables):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.expr("percentile_disc(0.99) within group (order by value)").alias("p99"), F.count_if(F.col("value") >= 50).alias("passed"))


@query("agg30_span_cost", "SELECT trace_id, max(latency_ms) - min(latency_ms) AS spread, CAST(coalesce(sum(tokens) FILTER (WHERE is_root), sum(tokens)) AS BIGINT) AS tokens FROM spans GROUP BY trace_id")
def _(t: Tables):
    return t.spans.groupBy("trace_id").agg((F.max("latency_ms") - F.min("latency_ms")).alias("spread"), F.coalesce(F.sum(F.when(F.col("is_root"), F.col("tokens"))), F.sum("tokens")).alias("tokens"))


@query("agg31_multi_turn_metrics", "SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS turns, count(DISTINCT content) AS distinct_texts, round(avg(length(content)), 4) AS mean_len FROM messages GROUP BY conv_id")
def _(t: Tables):
    return t.messages.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("turns"), F.countDistinct("content").alias("distinct_texts"), F.round(F.avg(F.length("content")), 4).alias("mean_len"))


@query("agg32_tool_selection", "SELECT user_id, round(hits * 1.0 / greatest(n, 1), 6) AS precision, round(hits / 2.0, 6) AS recall, round(CASE WHEN hits = 0 THEN 0 ELSE 2.0 * hits / (n + 2) END, 6) AS f1 FROM (SELECT user_id, count(DISTINCT event_type) AS n, count(DISTINCT CASE WHEN event_type IN ('click', 'purchase') THEN event_type END) AS hits FROM events WHERE value >= 60 GROUP BY 1)")
def _(t: Tables):
    used = t.events.where("value >= 60").groupBy("user_id").agg(F.collect_set("event_type").alias("u"))
    n, hits = F.size("u"), F.size(F.array_intersect("u", F.array(F.lit("click"), F.lit("purchase"))))
    return used.select("user_id", F.round(hits / F.greatest(n, F.lit(1)), 6).alias("precision"), F.round(hits / 2.0, 6).alias("recall"), F.round(F.when(hits == 0, 0.0).otherwise(2.0 * hits / (n + 2)), 6).alias("f1"))


@query("agg33_context_metrics", "SELECT user_id, len(list_intersect(got, want)) AS hits, round(len(list_intersect(got, want)) * 1.0 / len(want), 6) AS recall, round(len(list_intersect(got, want)) * 1.0 / len(got), 6) AS precision FROM (SELECT user_id, list(DISTINCT doc_id) AS got FROM behaviors GROUP BY 1), (SELECT list(DISTINCT doc_id) AS want FROM docs WHERE depth = 1)")
def _(t: Tables):
    g = R.set_overlap(t.behaviors.select("user_id", "doc_id"), t.docs.where("depth = 1").select("doc_id"), "user_id", "doc_id")
    return g.select("user_id", "hits", F.round(F.col("hits") / F.col("wanted"), 6).alias("recall"), F.round(F.col("hits") / F.col("got"), 6).alias("precision"))


@query("agg34_metric_mean", "SELECT key, round(avg(v), 4) AS mean FROM (SELECT 'cost' AS key, CAST(cost_cents AS DOUBLE) AS v FROM usage UNION ALL SELECT 'duration', duration_ms FROM usage UNION ALL SELECT 'tokens', input_tokens FROM usage) GROUP BY key")
def _(t: Tables):
    u = t.usage.select(F.expr("stack(3, 'cost', cast(cost_cents as double), 'duration', cast(duration_ms as double), 'tokens', cast(input_tokens as double)) as (key, v)"))
    return u.groupBy("key").agg(F.round(F.avg("v"), 4).alias("mean"))


@query("agg35_judge_batch", "SELECT count(*) AS total, count(*) FILTER (WHERE value >= 60 AND event_type <> 'error') AS passed, round(avg(value) FILTER (WHERE event_type <> 'error'), 6) AS mean FROM events")
def _(t: Tables):
    ok = F.col("event_type") != "error"
    return t.events.agg(F.count("*").alias("total"), F.count_if((F.col("value") >= 60) & ok).alias("passed"), F.round(F.avg(F.when(ok, F.col("value"))), 6).alias("mean"))


@query("agg36_dimension_averages", "SELECT event_type AS dimension, count(*) AS n, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean FROM events WHERE value > 5 GROUP BY 1")
def _(t: Tables):
    m = t.events.where("value > 5").select(F.explode(F.create_map("event_type", F.get_json_object("props", "$.k").cast("double"))).alias("dimension", "v"))
    return m.groupBy("dimension").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query("agg37_length_stats", "SELECT count(*) AS n, round(avg(l), 4) AS mean, min(l) AS least, max(l) AS most, quantile_disc(l, 0.5) AS p50, quantile_disc(l, 0.9) AS p90, quantile_disc(l, 0.99) AS p99 FROM (SELECT length(content) AS l FROM docs)")
def _(t: Tables):
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by l)")
    return t.docs.select(F.length("content").alias("l")).agg(F.count("*").alias("n"), F.round(F.avg("l"), 4).alias("mean"), F.min("l").alias("least"), F.max("l").alias("most"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"))


BINS = [64, 128, 256, 512, 1024, 2048, 4096, 8192]


@query("agg38_length_histogram", "WITH b AS (SELECT unnest([0, 64, 128, 256, 512, 1024, 2048, 4096, 8192]) AS lo, unnest([64, 128, 256, 512, 1024, 2048, 4096, 8192, NULL]) AS hi) SELECT b.lo, count(d.l) AS n FROM b LEFT JOIN (SELECT length(content) AS l FROM docs) d ON (d.l > b.lo OR b.lo = 0) AND (b.hi IS NULL OR d.l <= b.hi) GROUP BY b.lo")
def _(t: Tables):
    l = F.length("content")
    bucket = F.lit(BINS[-1])
    for lo, hi in reversed(list(zip([0, *BINS], BINS))):
        bucket = F.when(l <= hi, F.lit(lo)).otherwise(bucket)
    n = t.docs.groupBy(bucket.alias("lo")).agg(F.count("*").alias("n"))
    bins = t.spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in [0, *BINS]])).alias("lo"))
    return bins.join(n, "lo", "left").select("lo", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg39_source_distribution", "SELECT coalesce(ext_source, 'unknown') AS source, count(*) AS n FROM docs GROUP BY 1 ORDER BY n DESC, source")
def _(t: Tables):
    return t.docs.groupBy(F.coalesce("ext_source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@query("agg40_trail_summary", "SELECT count(*) AS sessions, round(avg(CASE WHEN last_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS completion, round(avg(CASE WHEN n >= 70 THEN 1.0 ELSE 0.0 END), 6) AS max_iter, round(avg(n) FILTER (WHERE last_type = 'purchase'), 6) AS avg_iterations FROM (SELECT user_id, count(*) AS n, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1)")
def _(t: Tables):
    s = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_type", "event_id").alias("last"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    done = F.col("last") == "purchase"
    return s.agg(F.count("*").alias("sessions"), share(done).alias("completion"), share(F.col("n") >= 70).alias("max_iter"), F.round(F.avg(F.when(done, F.col("n"))), 6).alias("avg_iterations"))


@query("agg41_tool_distribution", "SELECT event_type AS tool, count(*) AS hits FROM events WHERE value >= 20 GROUP BY 1")
def _(t: Tables):
    calls = t.events.select(F.explode(F.array(F.struct(F.col("event_type").alias("tool"), (F.col("value") >= 20).alias("hit")))).alias("c"))
    return calls.where("c.hit").groupBy("c.tool").agg(F.count("*").alias("hits"))


@query("agg42_filter_statistics", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN doc_id % 4 = 3 THEN 'classification' WHEN length(content) < 100 THEN 'too_short' WHEN length(content) > 8000 THEN 'too_long' ELSE 'kept' END AS reason FROM docs) GROUP BY reason")
def _(t: Tables):
    n = F.length("content")
    r = F.when(F.col("doc_id") % 4 == 3, "classification").when(n < 100, "too_short").when(n > 8000, "too_long").otherwise("kept")
    return t.docs.groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


@query("agg43_billing_sum", "SELECT user_id, CAST(sum(cost_cents) AS BIGINT) AS cents FROM usage GROUP BY user_id")
def _(t: Tables):
    return t.usage.groupBy("user_id").agg(F.sum("cost_cents").alias("cents"))


@query("agg44_pii_counts")
def _(t: Tables):
    return t.documents.groupBy("source").agg(*[F.sum(c).alias(k) for k, c in text.pii_counts(F.col("text")).items()])


@query("agg45_suite_statistics", "SELECT kb_id, round(sum(view_count * n_chars) * 1.0 / sum(n_chars), 4) AS weighted, count(*) FILTER (WHERE status = 'published') AS ok FROM docs GROUP BY kb_id")
def _(t: Tables):
    return t.docs.groupBy("kb_id").agg(F.round(F.sum(F.col("view_count") * F.col("n_chars")) / F.sum("n_chars"), 4).alias("weighted"), F.count_if(F.col("status") == "published").alias("ok"))


@query("agg46_counters_and_acceptance", "SELECT question_id, count(*) AS answers_n, min(id) FILTER (WHERE is_accepted) AS accepted FROM answers GROUP BY question_id")
def _(t: Tables):
    return t.answers.groupBy("question_id").agg(F.count("*").alias("answers_n"), F.min(F.when(F.col("is_accepted"), F.col("id"))).alias("accepted"))


@query("agg47_evidence_status", "SELECT item_id, CASE WHEN n IS NULL THEN 'gap' WHEN best < 60 THEN 'uncertain' ELSE 'confirmed' END AS status FROM benchmark LEFT JOIN (SELECT clicked_doc_id, count(*) AS n, max(value) AS best FROM searches WHERE clicked GROUP BY 1) ON item_id = clicked_doc_id")
def _(t: Tables):
    s = t.searches.where("clicked").groupBy(F.col("clicked_doc_id").alias("item_id")).agg(F.count("*").alias("n"), F.max("value").alias("best"))
    return t.benchmark.join(s, "item_id", "left").select("item_id", F.when(F.col("n").isNull(), "gap").when(F.col("best") < 60, "uncertain").otherwise("confirmed").alias("status"))
