"""Queries: recommendation, graph, training sets, pair joins, ordered folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking as C
from ..operators import folds as G
from ..operators import learning as L
from ..operators import relational as R
from ..operators import retrieval as V
from .registry import Tables, query

M = "m AS (SELECT user_id, doc_id, CAST(sum(half_weight) AS BIGINT) AS w FROM behaviors GROUP BY 1, 2)"
SZ = M + ", sz AS (SELECT user_id, count(*) AS n FROM m GROUP BY 1)"
UCF = SZ + """, c AS (SELECT a.user_id, b.user_id AS other, count(*) AS c FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.user_id <> b.user_id GROUP BY 1, 2),
sim AS (SELECT c.user_id, other, c * 1.0 / (x.n + y.n - c) AS sim FROM c JOIN sz x ON x.user_id = c.user_id JOIN sz y ON y.user_id = other),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, other) AS rn FROM sim) WHERE rn <= 10),
us AS (SELECT near.user_id, m.doc_id, round(sum(sim * w), 6) AS score FROM near JOIN m ON m.user_id = other GROUP BY 1, 2),
ucf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, doc_id) AS rn FROM us WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.user_id = us.user_id AND m.doc_id = us.doc_id)) WHERE rn <= 10)"""


def m(t: Tables):
    return L.matrix(t.behaviors)


def everyone():
    return F.lit(True)


@query("rec01_interaction_matrix", "SELECT user_id, doc_id, CAST(sum(half_weight) AS BIGINT) AS w FROM behaviors WHERE acted_at >= TIMESTAMP '2024-01-05' GROUP BY 1, 2")
def _(t: Tables):
    return L.matrix(t.behaviors.where(F.col("acted_at") >= F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")))


@query("jn16_user_jaccard", "WITH " + UCF + " SELECT user_id, other, round(sim, 6) AS sim FROM near")
def _(t: Tables):
    return L.nearest_sets(m(t), "doc_id", "user_id", 10).select("user_id", "other", F.round("sim", 6).alias("sim"))


@query("jn16b_similar_users", "WITH " + UCF + " SELECT user_id, other, round(sim, 6) AS sim FROM sim WHERE sim >= 0.2")
def _(t: Tables):
    s = L.similar_sets(m(t), "doc_id", "user_id", 0.2)
    return s.select("user_id", "other", F.round("sim", 6).alias("sim"))


@query("rec02_user_cf", "WITH " + UCF + " SELECT user_id, doc_id, score FROM ucf")
def _(t: Tables):
    return L.user_cf(m(t), everyone())


ICF = M + """, sz AS (SELECT doc_id, count(*) AS n FROM m GROUP BY 1), own AS (SELECT DISTINCT doc_id FROM m),
c AS (SELECT a.doc_id, b.doc_id AS other, count(*) AS c FROM m a JOIN m b ON a.user_id = b.user_id AND a.doc_id <> b.doc_id WHERE a.doc_id IN (SELECT doc_id FROM own) GROUP BY 1, 2),
sim AS (SELECT c.doc_id, other, c * 1.0 / (x.n + y.n - c) AS sim FROM c JOIN sz x ON x.doc_id = c.doc_id JOIN sz y ON y.doc_id = other),
s AS (SELECT m.user_id, other AS doc_id, round(sum(sim), 6) AS score FROM m JOIN sim ON sim.doc_id = m.doc_id GROUP BY 1, 2)"""


@query("jn17_item_jaccard", "WITH " + ICF + " SELECT doc_id, count(*) AS n, round(max(sim), 6) AS best FROM sim GROUP BY doc_id")
def _(t: Tables):
    return L.in_common(m(t), "user_id", "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.max("sim"), 6).alias("best"))


@query("rec03_item_cf", "WITH " + ICF + " SELECT user_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, doc_id) AS rn FROM s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.user_id = s.user_id AND m.doc_id = s.doc_id)) WHERE rn <= 10")
def _(t: Tables):
    return L.item_cf(m(t), everyone())


@query("rec04_content_recall", "SELECT user_id, vec_id, score FROM (SELECT user_id, vec_id, round(list_cosine_similarity(p, CAST(embedding AS DOUBLE[])), 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(list_cosine_similarity(p, CAST(embedding AS DOUBLE[])), 6) DESC, vec_id) AS rn FROM (SELECT user_id, list(v ORDER BY pos) AS p FROM (SELECT user_id, pos, avg(v) AS v FROM (SELECT b.user_id, unnest(range(1, 65)) AS pos, CAST(unnest(e.embedding) AS DOUBLE) AS v FROM (SELECT DISTINCT user_id, doc_id FROM behaviors WHERE user_id % 100 = 0) b JOIN embeddings e ON e.vec_id = b.doc_id) GROUP BY 1, 2) GROUP BY 1), embeddings) WHERE rn <= 5")
def _(t: Tables):
    seen = t.behaviors.where("user_id % 100 = 0").select("user_id", "doc_id").distinct()
    v = seen.join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").select("user_id", F.posexplode("embedding").alias("pos", "v"))
    p = v.groupBy("user_id", "pos").agg(F.avg(F.col("v").cast("double")).alias("v")).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("q"))
    return V.vector_topk(p.withColumnRenamed("user_id", "query_id"), t.embeddings, 5).withColumnRenamed("query_id", "user_id")  # the stated query set


LINKS = "links AS (SELECT doc_id AS src, (doc_id * 7 + 3) % 200 AS dst FROM docs UNION SELECT (doc_id * 7 + 3) % 200, doc_id FROM docs)"


@query("rec05_graph_recall", f"""WITH {LINKS}, last AS (SELECT user_id, doc_id, row_number() OVER (PARTITION BY user_id ORDER BY max(event_id) DESC) AS k FROM behaviors GROUP BY 1, 2), seeds AS (SELECT * FROM last WHERE k <= 5),
one AS (SELECT user_id, k, seeds.doc_id AS seed, dst, 1 AS depth FROM seeds JOIN links ON src = seeds.doc_id), two AS (SELECT user_id, k, seed, links.dst, 2 AS depth FROM one JOIN links ON links.src = one.dst),
r AS (SELECT user_id, k, dst AS doc_id, min(depth) AS depth FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE dst <> seed GROUP BY 1, 2, 3), top AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY depth, doc_id) AS n FROM r),
hit AS (SELECT *, row_number() OVER (PARTITION BY user_id, doc_id ORDER BY k) AS first FROM top WHERE n <= 10)
SELECT user_id, doc_id, round(1.0 / depth, 6) AS score, 'graph' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k, n) AS place FROM hit WHERE first = 1) WHERE place <= 10""")
def _(t: Tables):
    one = t.behaviors.groupBy("user_id", "doc_id").agg(F.max("event_id").alias("at"))
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at"))).alias("k")
    seeds = one.select("user_id", "doc_id", k).where("k <= 5")
    d = t.docs.select("doc_id", ((F.col("doc_id") * 7 + 3) % 200).alias("to"))
    links = d.toDF("src", "dst").union(d.select("to", "doc_id")).distinct()
    return L.graph_recall(seeds, links, 10)


@query("rec06_hot_fallback", "SELECT doc_id FROM docs WHERE status = 'published' ORDER BY view_count DESC, doc_id LIMIT 20")
def _(t: Tables):
    return t.docs.where("status = 'published'").orderBy(F.desc("view_count"), "doc_id").limit(20).select("doc_id")


RRF = """p AS (SELECT user_id, doc_id, 'recent' AS path, row_number() OVER (PARTITION BY user_id ORDER BY max(event_id) DESC) - 1 AS rank FROM behaviors GROUP BY 1, 2 UNION ALL
SELECT user_id, doc_id, 'strong', row_number() OVER (PARTITION BY user_id ORDER BY sum(half_weight) DESC, doc_id) - 1 FROM behaviors GROUP BY 1, 2),
f AS (SELECT user_id, doc_id, round(sum(1.0 / (60 + rank + 1)), 6) AS score, string_agg(DISTINCT path, ',' ORDER BY path) AS reasons FROM p WHERE rank < 20 GROUP BY 1, 2)"""


def fused(t: Tables):
    b = t.behaviors.groupBy("user_id", "doc_id").agg(F.max("event_id").alias("at"), F.sum("half_weight").alias("w"))
    rank = lambda *order: (F.row_number().over(Window.partitionBy("user_id").orderBy(*order)) - 1).alias("rank")
    paths = b.select("user_id", "doc_id", F.lit("recent").alias("path"), rank(F.desc("at"))).unionByName(b.select("user_id", "doc_id", F.lit("strong").alias("path"), rank(F.desc("w"), F.asc("doc_id"))))
    return V.rrf(paths.where("rank < 20"))


@query("rec07_rrf", "WITH " + RRF + " SELECT user_id, doc_id, score, reasons FROM f")
def _(t: Tables):
    return fused(t)


@query("rec08_finalise", "WITH " + RRF + " SELECT user_id, doc_id FROM (SELECT f.user_id, f.doc_id, row_number() OVER (PARTITION BY f.user_id ORDER BY score DESC, f.doc_id) AS rn FROM f JOIN docs d ON d.doc_id = f.doc_id AND d.status = 'published' WHERE NOT EXISTS (SELECT 1 FROM behaviors b WHERE b.user_id = f.user_id AND b.doc_id = f.doc_id AND b.action_type = 'purchase')) WHERE rn <= 5")
def _(t: Tables):
    bought = t.behaviors.where("action_type = 'purchase'").select("user_id", "doc_id")
    ok = fused(t).join(bought, ["user_id", "doc_id"], "left_anti").join(t.docs.where("status = 'published'").select("doc_id"), "doc_id", "left_semi")
    return R.latest_by(ok, ["user_id"], [F.desc("score"), F.asc("doc_id")], 5).select("user_id", "doc_id")


@query("rec09_gate", "SELECT user_id, CASE WHEN count(event_id) = 0 THEN 'hot' WHEN count(event_id) < 3 THEN 'content' ELSE 'cf' END AS path FROM (SELECT c_custkey AS user_id FROM customer) LEFT JOIN (SELECT user_id AS u, event_id FROM behaviors WHERE action_type = 'purchase') ON u = user_id GROUP BY user_id")
def _(t: Tables):
    n = t.behaviors.where("action_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"))
    c = F.coalesce("n", F.lit(0))
    return t.users.select("user_id").join(n, "user_id", "left").select("user_id", F.when(c == 0, "hot").when(c < 3, "content").otherwise("cf").alias("path"))


# --- graph

EDGES = "e AS (SELECT o_custkey AS src, 100000000 + l_partkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey), g AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


def orders_parts(t: Tables):
    """(src, dst): customers and the parts they ordered, with repeats."""
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), (F.lit(100000000) + F.col("l_partkey")).alias("dst"))


def edges(t: Tables):
    e = orders_parts(t)
    return e.union(e.select("dst", "src")).distinct()


def starts(t: Tables):
    """The stated query set: every customer whose id is divisible by 100."""
    return t.orders.where("o_custkey % 100 = 0").join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("o_custkey").alias("origin"), F.col("o_custkey").alias("node")).distinct()


def bfs(hops: int) -> str:
    return f"WITH RECURSIVE {EDGES}, s AS (SELECT DISTINCT src AS origin FROM e WHERE src % 100 = 0), r(origin, node, depth) AS (SELECT origin, origin, 0 FROM s UNION SELECT r.origin, g.dst, r.depth + 1 FROM r JOIN g ON g.src = r.node WHERE r.depth < {hops}), d AS (SELECT origin, node, min(depth) AS depth FROM r GROUP BY 1, 2)"


@query("jn23_variable_length_paths", bfs(3) + " SELECT origin, node, depth FROM d")
def _(t: Tables):
    return R.reach(edges(t), starts(t), 3).select("origin", "node", "depth")


@query("gr01_triple_normalise", "SELECT s_suppkey, coalesce(n_name, 'Concept') AS canonical, coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN 'LOCATED_IN' END, 'RELATES_TO') AS predicate FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON n_nationkey = s_nationkey")
def _(t: Tables):
    n = t.nation.where("n_nationkey % 4 <> 0")
    return t.supplier.join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("Concept")).alias("canonical"), F.coalesce(F.when(F.col("s_suppkey") % 3 != 0, "LOCATED_IN"), F.lit("RELATES_TO")).alias("predicate"))


@query("gr02_related_nodes", bfs(2) + " SELECT origin, node, depth FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY depth, node) AS k FROM d WHERE depth > 0) WHERE k <= 50")
def _(t: Tables):
    return R.latest_by(R.reach(edges(t), starts(t), 2).where("depth > 0"), ["origin"], [F.asc("depth"), F.asc("node")], 50).select("origin", "node", "depth")


@query("gr03_docs_from_entities", bfs(2) + " SELECT origin, node FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY node) AS k FROM d WHERE node >= 100000000) WHERE k <= 10")
def _(t: Tables):
    return R.latest_by(R.reach(edges(t), starts(t), 2).where("node >= 100000000"), ["origin"], [F.asc("node")], 10).select("origin", "node")


@query("gr04_related_docs", bfs(2) + " SELECT origin, node, round(1.0 / depth, 6) AS score FROM d WHERE depth > 0")
def _(t: Tables):
    return R.reach(edges(t), starts(t), 2).where("depth > 0").select("origin", "node", F.round(F.try_divide(F.lit(1.0), F.col("depth").cast("double")), 6).alias("score"))


def ways(t: Tables, path: bool):
    """Shortest paths, of five edges at most, from each start to the part with the number that follows its own."""
    from ..session import cut

    e = cut(orders_parts(t), "bought")
    pairs = e.where("src % 100 = 0").select(F.col("src").alias("origin"), (F.lit(100000001) + F.col("src")).alias("target")).distinct()
    return R.shortest_paths(e, pairs, 5, path, one_way=True)


@query("gr05_shortest_path", bfs(5) + " SELECT origin, node AS target, depth AS length FROM d WHERE node = 100000001 + origin")
def _(t: Tables):
    return ways(t, False).select("origin", "target", "length")


@query("gr05b_path_nodes")
def _(t: Tables):
    return ways(t, True).select("origin", "target", "length", "path")


@query("gr06_neighbourhood", bfs(2) + " SELECT a.origin, count(*) AS edges_n FROM d a JOIN g ON g.src = a.node JOIN d b ON b.node = g.dst AND b.origin = a.origin GROUP BY 1")
def _(t: Tables):
    from ..session import cut

    e, near = edges(t), cut(R.reach(edges(t), starts(t), 2).select("origin", "node"), "near")
    inside = near.withColumnRenamed("node", "src").join(e, "src").select("origin", F.col("dst").alias("node"))
    return inside.join(near, ["origin", "node"], "left_semi").groupBy("origin").agg(F.count("*").alias("edges_n"))


@query("gr07_chunk_triples", "SELECT DISTINCT 'S' || CAST(s_suppkey AS VARCHAR) AS subject, '依赖' AS predicate, 'N' || CAST(s_nationkey AS VARCHAR) AS object FROM supplier")
def _(t: Tables):
    from ..functions.rules import triples

    d = t.supplier.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("依赖N"), F.col("s_nationkey").cast("string")).alias("t"))
    return triples(d.union(d), "t", []).distinct()


# --- training sets

PAIRS = "p AS (SELECT conv_id AS id, max(text) FILTER (WHERE role = 'user' AND turn = u) AS question, max(text) FILTER (WHERE role = 'assistant' AND turn = a) AS answer FROM (SELECT *, min(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS u, min(turn) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) AS a FROM conversations) GROUP BY 1)"
GOLD = "(6 * list_sum(list_transform(string_split(substr(h, 1, 63), ''), lambda x: strpos('0123456789abcdef', x) - 1)) + strpos('0123456789abcdef', substr(h, 64, 1)) - 1) % 10"
SFT = "WITH " + PAIRS + ", k AS (SELECT id, question, regexp_replace(answer, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g') AS masked, sha256(regexp_replace(question, '^\\s+|\\s+$', '', 'g')) AS h, id % 4 AS level FROM p WHERE question IS NOT NULL AND answer IS NOT NULL), e AS (SELECT *, regexp_replace(masked, '^\\s+|\\s+$', '', 'g') AS s, CASE WHEN " + GOLD + " = 0 THEN 'golden_excluded' WHEN level > 2 THEN 'classification' WHEN length(regexp_replace(masked, '^\\s+|\\s+$', '', 'g')) < 10 THEN 'too_short' WHEN length(regexp_replace(masked, '^\\s+|\\s+$', '', 'g')) > 8000 THEN 'too_long' END AS early FROM k), r AS (SELECT *, coalesce(early, CASE WHEN id <> min(id) FILTER (WHERE early IS NULL) OVER (PARTITION BY s) THEN 'duplicate' END) AS reason FROM e)"


def pairs(t: Tables):
    first = lambda role: F.min_by("text", F.when(F.col("role") == role, F.col("turn")))
    return t.conversations.groupBy(F.col("conv_id").alias("id")).agg(first("user").alias("question"), first("assistant").alias("answer")).where("question is not null and answer is not null").withColumn("level", F.col("id") % 4)


@query("ds01_sft_builder", SFT + " SELECT id, question, masked AS answer FROM r WHERE reason IS NULL")
def _(t: Tables):
    return L.sft(pairs(t)).where("reason is null").select("id", "question", F.col("masked").alias("answer"))


@query("ds01_sft_statistics", SFT + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1")
def _(t: Tables):
    return L.sft(pairs(t)).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


TURNS = "t AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_no FROM messages), a AS (SELECT * FROM t WHERE turn_no > 0 AND role = 'assistant'), b AS (SELECT conv_id, turn_no, coalesce(arg_min(content, turn) FILTER (WHERE rating BETWEEN 1 AND 2), arg_min(content, turn) FILTER (WHERE rating IS NULL)) AS rejected FROM a GROUP BY 1, 2)"


def merged_turns(t: Tables):
    """Two conversations read as one, so that a turn has several answers."""
    return R.turns(t.messages.where("role <> 'user' or conv_id % 2 = 0").withColumn("turn", F.col("turn") * 2 + F.col("conv_id") % 2).withColumn("conv_id", F.floor(F.col("conv_id") / 2)))


MERGED = TURNS.replace("FROM messages)", "FROM (SELECT conv_id // 2 AS conv_id, turn * 2 + conv_id % 2 AS turn, role, content, rating FROM messages WHERE role <> 'user' OR conv_id % 2 = 0))")


@query("jn11_preferred_rejected", "WITH " + MERGED + " SELECT a.conv_id, a.turn_no, a.turn, a.content AS chosen, b.rejected FROM a JOIN b ON a.conv_id = b.conv_id AND a.turn_no = b.turn_no WHERE a.rating >= 4 AND b.rejected IS NOT NULL")
def _(t: Tables):
    return L.turn_pairs(merged_turns(t))


@query("jn12_accepted_rejected", "SELECT a.question_id, a.id AS chosen, b.id AS rejected FROM answers a JOIN answers b ON a.question_id = b.question_id WHERE a.is_accepted AND NOT b.is_accepted")
def _(t: Tables):
    return L.answer_pairs(t.answers)


@query("jn13_blocked_praised", "SELECT q.conv_id, p.content AS answer FROM (SELECT conv_id, trim(content) AS q FROM messages WHERE role = 'user' AND turn = 0) q JOIN (SELECT q, arg_min(content, msg_id) AS content FROM (SELECT u.content AS raw, trim(u.content) AS q, a.content, a.msg_id FROM messages u JOIN messages a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.rating >= 4 WHERE u.role = 'user') GROUP BY q) p ON p.q = q.q")
def _(t: Tables):
    u = t.messages.where("role = 'user'").select("conv_id", F.trim("content").alias("q"), "turn")
    a = t.messages.where("rating >= 4").select("conv_id", (F.col("turn") - 1).alias("turn"), "content", "msg_id")
    praised = u.join(a, ["conv_id", "turn"]).groupBy("q").agg(F.min_by("content", "msg_id").alias("answer"))
    return u.where("turn = 0").join(praised, "q").select("conv_id", "answer")


@query("ds02_dpo_builder", "WITH " + MERGED + " SELECT 'turn' AS origin, a.conv_id AS key, a.content AS chosen, b.rejected FROM a JOIN b ON a.conv_id = b.conv_id AND a.turn_no = b.turn_no WHERE a.rating >= 4 AND b.rejected IS NOT NULL UNION ALL SELECT 'answer', x.question_id, x.content, y.content FROM answers x JOIN answers y ON x.question_id = y.question_id WHERE x.is_accepted AND NOT y.is_accepted")
def _(t: Tables):
    turns = L.turn_pairs(merged_turns(t)).select(F.lit("turn").alias("origin"), F.col("conv_id").alias("key"), "chosen", "rejected")
    a = t.answers
    x = a.where("is_accepted").select("question_id", F.col("content").alias("chosen"))
    y = a.where("not is_accepted").select("question_id", F.col("content").alias("rejected"))
    return turns.unionByName(x.join(y, "question_id").select(F.lit("answer").alias("origin"), F.col("question_id").alias("key"), "chosen", "rejected"))


@query("ds03_embedding_triplets", "SELECT s.query, substr(d.content, 1, 500) AS pos, n.neg FROM (SELECT query, arg_max(clicked_doc_id, event_id) AS doc_id FROM searches WHERE clicked GROUP BY query) s JOIN docs d ON d.doc_id = s.doc_id JOIN (SELECT kb_id, min(doc_id) AS neg FROM docs WHERE status = 'draft' GROUP BY 1) n ON n.kb_id = d.kb_id WHERE n.neg <> d.doc_id")
def _(t: Tables):
    s = t.searches.where("clicked").groupBy("query").agg(F.max_by("clicked_doc_id", "event_id").alias("doc_id"))
    neg = t.docs.where("status = 'draft'").groupBy("kb_id").agg(F.min("doc_id").alias("neg"))
    return s.join(t.docs.select("doc_id", "kb_id", "content"), "doc_id").join(neg, "kb_id").where("neg <> doc_id").select("query", F.substring("content", 1, 500).alias("pos"), "neg")


@query("ds04_golden_set", "WITH " + PAIRS + " SELECT id, question FROM (SELECT *, sha256(regexp_replace(question, '^\\s+|\\s+$', '', 'g')) AS h FROM p WHERE question IS NOT NULL AND answer IS NOT NULL) WHERE " + GOLD + " = 0")
def _(t: Tables):
    return pairs(t).where(text.golden_bucket(F.col("question")) == 0).select("id", "question")


@query("ds05_rating_map", "SELECT id, CASE type WHEN 'praise' THEN 5 WHEN 'suggestion' THEN 3 WHEN 'complaint' THEN 2 WHEN 'bug' THEN 1 ELSE 3 END AS rating FROM feedback")
def _(t: Tables):
    ratings = F.create_map(*[F.lit(x) for kv in {"praise": 5, "suggestion": 3, "complaint": 2, "bug": 1}.items() for x in kv])
    return t.feedback.select("id", F.coalesce(F.element_at(ratings, F.col("type")), F.lit(3)).alias("rating"))


@query("ds06_dataset_report", "WITH " + PAIRS + " SELECT count(*) AS n, CAST(sum(length(question)) AS BIGINT) AS q_chars, CAST(sum(length(answer)) AS BIGINT) AS a_chars, quantile_disc(length(answer), 0.9) AS p90 FROM p WHERE question IS NOT NULL AND answer IS NOT NULL")
def _(t: Tables):
    n = F.length("answer")
    return pairs(t).withColumn("l", n).agg(F.count("*").alias("n"), F.sum(F.length("question")).alias("q_chars"), F.sum("l").alias("a_chars"), F.expr("percentile_disc(0.9) within group (order by l)").alias("p90"))


@query("snk01_jsonl_export", "WITH " + PAIRS + " SELECT 'default' AS tenant, question, answer FROM p WHERE question IS NOT NULL AND answer IS NOT NULL")
def _(t: Tables):
    # written under <base>/<tenant>/<version>/<kind> and read back
    from ..session import scratch
    from ..sources import jsonl

    at = jsonl.write_jsonl(pairs(t).select("question", "answer"), scratch(t.spark, "export"), None, "v20240131-000000", "sft")
    return jsonl.read_jsonl(t.spark, at, "question string, answer string").select(F.lit("default").alias("tenant"), "question", "answer")


# --- ordered folds


LEVELS = ", ".join(f"max(CASE WHEN level = {k} THEN struct_pack(n := n, title := title) END) OVER w AS h{k}" for k in range(1, 7))
PATH = ", ".join(f"CASE WHEN level > {k} AND h{k}.n > greatest(0" + "".join(f", coalesce(h{j}.n, 0)" for j in range(1, k)) + f") THEN h{k}.title END" for k in range(1, 6))
HEADED = """WITH l AS (SELECT doc_id, i, x AS line, length(regexp_extract(x, '^(#{1,6})[ \t]+[^ \t]', 1)) AS level FROM (SELECT doc_id, unnest(u) AS x, unnest(range(len(u))) AS i FROM (SELECT doc_id, string_split('# Top' || chr(10) || replace(content, chr(10), chr(10) || '## Part' || chr(10) || '### Detail' || chr(10)), chr(10)) AS u FROM docs))),
c AS (SELECT *, CASE WHEN level > 0 THEN trim(regexp_replace(line, '^#{1,6}[ \t]+', ''), ' ') END AS title, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l),
s AS (SELECT doc_id, n, max(level) AS level, max(title) AS title, string_agg(line, chr(10) ORDER BY i) AS body FROM c WHERE n > 0 GROUP BY 1, 2)"""


@query("wf06_heading_stack", f"{HEADED} SELECT doc_id, n, array_to_string(list_filter([{PATH}, title], lambda x: x IS NOT NULL), ' > ') AS title_path, md5(body) AS body_md5 FROM (SELECT *, {LEVELS} FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY n))")
def _(t: Tables):
    from .retrieval import headed

    return V.sections(headed(t)).select("doc_id", "n", "title_path", F.md5("body").alias("body_md5"))


@query("wf09_tie_bands")
def _(t: Tables):
    rows = t.events.select("user_id", "event_id", F.col("value").alias("score"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (-F.col("value")).alias("o"))
    fold = lambda rs: [(r.event_id, b) for b, band in enumerate(G.tie_bands(rs, 5.0)) for r in band]
    return G.per_group(rows, ["user_id"], ["o", "event_id"], fold, "user_id long, event_id long, band int")


@query("wf10_repeat_streak")
def _(t: Tables):
    return G.per_group(t.messages.select("conv_id", "turn", "role", "content"), ["conv_id"], ["turn"], lambda rs: [(G.repeat_streak([(r.role, r.content or "") for r in rs]),)], "conv_id long, streak int")


SEGMENTS = "SELECT conv_id, turn, turn * 50.0 AS a, turn * 50.0 + 45 AS b FROM messages"


@query("wf14_time_windows", f"""WITH RECURSIVE s AS ({SEGMENTS}), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM s),
r AS (SELECT conv_id, turn, k, a AS start, 0 AS window_no FROM o WHERE k = 1 UNION ALL SELECT o.conv_id, o.turn, o.k, CASE WHEN o.a >= r.start + 120 THEN o.a ELSE r.start END, CASE WHEN o.a >= r.start + 120 THEN r.window_no + 1 ELSE r.window_no END FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k + 1)
SELECT conv_id, turn, window_no FROM r""")
def _(t: Tables):
    s = t.messages.select("conv_id", "turn", (F.col("turn") * 50.0).alias("a"), (F.col("turn") * 50.0 + 45).alias("b"))

    def numbered(rows):
        return [(rows[i].turn, w) for w, part in enumerate(C.windows([(r.a, r.b, "x") for r in rows])) for i in part]

    return G.per_group(s, ["conv_id"], ["turn"], numbered, "conv_id long, turn long, window_no int")


@query("top06_knapsack")
def _(t: Tables):
    m_ = t.messages.select("conv_id", "turn", F.length("content").alias("cost"), (F.col("turn") % 3).cast("int").alias("priority"), (F.length("content") % 97).cast("double").alias("relevance"), (F.col("role") == "system").alias("must"))
    return G.per_group(m_, ["conv_id"], ["turn"], lambda rs: [(r.turn, c) for r, c in zip(rs, G.knapsack([(r.cost, r.priority, r.relevance, r.must) for r in rs], 2000))], "conv_id long, turn long, chosen boolean")


@query("top07_history_selection")
def _(t: Tables):
    cost = F.floor((F.length("role") + 2 + F.least(F.length("content"), F.lit(200))) / 3)  # "role: " and the first 200 characters, 3 to a token
    m_ = t.messages.select("conv_id", "turn", cost.cast("int").alias("cost"), ((F.length("content") % 100) / 100.0).alias("sim"))
    return G.per_group(m_, ["conv_id"], ["turn"], lambda rs: [(r.turn, c) for r, c in zip(rs, G.select_history([(r.cost, r.sim) for r in rs], 8, 600))], "conv_id long, turn long, chosen boolean")


@query("set07_near_duplicate_pointers")
def _(t: Tables):
    return G.per_group(t.messages.select("conv_id", "turn", "content"), ["conv_id"], ["turn"], lambda rs: [(r.turn, p) for r, p in zip(rs, G.near_duplicate_pointers([r.content for r in rs]))], "conv_id long, turn long, pointer int")
