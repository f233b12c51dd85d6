"""Queries: retrieval, chunking and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import maths, rules, text
from ..operators import chunking as C
from ..operators import dictionary as D
from ..operators.index import TextIndex, VectorIndex
from ..operators import relational as R
from ..operators import retrieval as V
from ..session import scratch
from .registry import Tables, as_of, query



def bm25_sql(queries: str) -> str:
    """Common tables up to s: the score of every chunk that a query (query_id, text) meets, by its better field."""
    return f"""WITH chunks AS (SELECT doc_id, i AS pos, doc_id || ':' || i AS chunk_id, substr(text, CAST(i * 1000 + 1 AS BIGINT), 1000) AS body, substr(text, 1, 60) AS title FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)),
qs AS ({queries}), tok AS (SELECT chunk_id, unnest(regexp_extract_all(lower(body), '[a-z0-9]+|[\\x{{4E00}}-\\x{{9FFF}}]')) AS term FROM chunks), tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY 1, 2), len AS (SELECT chunk_id, count(*) AS n FROM tok GROUP BY 1),
stat AS (SELECT count(*) AS total, avg(n) AS mean FROM len), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), q AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+|[\\x{{4E00}}-\\x{{9FFF}}]')) AS term FROM qs)),
body_s AS (SELECT query_id, tf.chunk_id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM q JOIN df ON q.term = df.term JOIN tf ON tf.term = q.term JOIN len ON len.chunk_id = tf.chunk_id, stat GROUP BY 1, 2),
title_df AS (SELECT title, count(*) AS df FROM chunks GROUP BY 1), title_s AS (SELECT query_id, chunk_id, round(2 * ln(1 + ((SELECT count(*) FROM chunks) - df + 0.5) / (df + 0.5)), 6) AS score FROM qs JOIN chunks ON qs.text = chunks.title JOIN title_df ON title_df.title = chunks.title),
s AS (SELECT query_id, chunk_id, max(score) AS score FROM (SELECT * FROM body_s UNION ALL SELECT * FROM title_s) GROUP BY 1, 2)"""


ITEMS = "SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 100 = 0"
BM25 = bm25_sql(ITEMS) + ", ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM s) WHERE rn <= 20)"
VEC = """vs AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q),
vk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM vs) WHERE rn <= 20)"""


def text_queries(t: Tables):
    """The stated query set of searches: rows whose id is divisible by 100, against all rows."""
    return t.benchmark.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text")


def vector_queries(t: Tables):
    return t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def chunks(t: Tables):
    return V.windows(t.documents, 1000, text="text", keep=[F.substring("text", 1, 60).alias("title")])


def fulltext(t: Tables, k: int = 20, keep=None):
    return V.bm25(text_queries(t), chunks(t), k, keep=keep)


@query("ret01_vector_topk", "WITH " + VEC + ", f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM vs WHERE label % 2 = 0) SELECT query_id, vec_id, score FROM f WHERE k <= 5")
def _(t: Tables):
    return V.vector_topk(vector_queries(t), t.embeddings, 5, F.col("label") % 2 == 0)


@query("ret02_raw_score_order", "WITH " + VEC + " SELECT query_id, vec_id, rn AS rank FROM vk")
def _(t: Tables):
    s = V.vector_topk(vector_queries(t), t.embeddings, 20)
    return s.select("query_id", "vec_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("long").alias("rank"))


@query("ret03_fulltext_bm25", BM25 + " SELECT query_id, chunk_id, score FROM ft")
def _(t: Tables):
    return fulltext(t)


def stored_index(t: Tables):
    """An index of all chunks that began with other texts: every third document's chunks were longer, and chunks that no longer are were there."""
    index = TextIndex(t.spark, scratch(t.spark, "text-index"))
    now = chunks(t).select("doc_id", "chunk_id", "body", "title")
    third = F.col("doc_id") % 3 == 0
    index.update(now.withColumn("body", F.when(third, F.concat(F.lit("before this "), "body")).otherwise(F.col("body"))).withColumn("title", F.when(third, F.upper("title")).otherwise(F.col("title"))))
    index.update(now)
    return index


@query("ret03c_stored_index", BM25 + " SELECT query_id, chunk_id, score FROM ft")
def _(t: Tables):
    return stored_index(t).search(text_queries(t), 20)


@query("snk03b_stored_postings", BM25 + ", live AS (SELECT * FROM chunks WHERE doc_id % 10 <> 9) SELECT term, 0 AS field, count(*) AS df, CAST(sum(n) AS BIGINT) AS tf FROM (SELECT term, count(*) AS n FROM tok WHERE chunk_id IN (SELECT chunk_id FROM live) GROUP BY term, chunk_id) GROUP BY term UNION ALL SELECT title, 1, count(*), count(*) FROM live GROUP BY title")
def _(t: Tables):
    # postings after two updates, the deletion of every tenth document, and a merge
    index = stored_index(t)
    index.delete(chunks(t).where("doc_id % 10 = 9"))
    index.merge()
    return index.postings().groupBy("term", "field").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def vector_index(t: Tables):
    return VectorIndex.create(t.embeddings, scratch(t.spark, "vector-index"))


@query("ret01b_index_exact", "WITH " + VEC + ", f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM vs WHERE label % 2 = 0) SELECT query_id, vec_id, score FROM f WHERE k <= 5")
def _(t: Tables):
    return vector_index(t).search(vector_queries(t), 5, F.col("label") % 2 == 0, exact=True)


@query("ret01c_index_recall", "WITH " + VEC + ", f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM vs WHERE label % 2 = 0) SELECT count(*) AS wanted, true AS enough FROM f WHERE k <= 10")
def _(t: Tables):
    # the share of the exact ten nearest that the index finds when it probes only the nearest cells: at least 0.9
    keep = F.col("label") % 2 == 0
    r = vector_index(t).recall(vector_queries(t), V.vector_topk(vector_queries(t), t.embeddings, 10, keep), 10, keep=keep)
    return r.agg(F.sum("wanted").alias("wanted"), (F.sum("found") / F.sum("wanted") >= 0.9).alias("enough"))


@query("ret04_cross_modal_channel", "WITH " + VEC + " SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM vs WHERE label >= 5) WHERE k <= 8")
def _(t: Tables):
    return V.vector_topk(vector_queries(t), t.embeddings, 8, F.col("label") >= 5)


ENTITIES = "SELECT DISTINCT item_id AS query_id, n_name AS entity FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark WHERE item_id % 100 = 0) JOIN nation ON w = CASE n_nationkey % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'and' ELSE 'with' END"
GRAPH = f"gh AS (SELECT query_id, 'graph_' || CAST(doc_id AS VARCHAR) AS chunk_id, 0.5::DOUBLE AS score FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS k FROM (SELECT DISTINCT query_id, s_suppkey AS doc_id FROM ({ENTITIES}) JOIN nation ON n_name = entity JOIN supplier ON s_nationkey = n_nationkey)) WHERE k <= 3)"


def expanded(t: Tables, items):
    """(item_id, canonical): entities whose synonyms the text holds."""
    words = items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("w"))
    m = F.col("n_nationkey") % 3
    syn = t.nation.select(F.when(m == 0, "the").when(m == 1, "and").otherwise("with").alias("w"), F.col("n_name").alias("canonical"))
    return words.join(syn, "w").select("item_id", "canonical").distinct()


def graph_hits(t: Tables, k: int = 3):
    named = expanded(t, t.benchmark.where("item_id % 100 = 0")).select(F.col("item_id").alias("query_id"), F.col("canonical").alias("entity"))
    mentions = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("entity"), F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("title"))
    return V.graph_channel(named, mentions, k)


@query("ret05_graph_channel", f"WITH {GRAPH} SELECT query_id, chunk_id, score, s_name AS content FROM gh JOIN supplier ON chunk_id = 'graph_' || s_suppkey")
def _(t: Tables):
    return graph_hits(t)


#: Synonyms: the first two and three words of every text stand for one of 25 entities, and three terms within each other; texts some of which end in such terms.
NAMED = "regexp_replace(lower(text || CASE item_id % 4 WHEN 0 THEN ' 差旅报销流程' WHEN 1 THEN ' 流程图' ELSE '' END), '[^a-z0-9一-鿿]+', ' '{g})"
SYN = "syn AS (SELECT DISTINCT term, entity FROM (SELECT regexp_extract(n, '^ ?([a-z0-9]+ [a-z0-9]+)', 1) AS term, 'E' || item_id % 25 AS entity FROM named UNION ALL SELECT regexp_extract(n, '^ ?([a-z0-9]+ [a-z0-9]+ [a-z0-9]+)', 1), 'F' || item_id % 25 FROM named UNION ALL SELECT * FROM (VALUES ('差旅', 'Travel'), ('报销流程', 'Expense'), ('流程', 'Process'), ('the', 'Article'))) WHERE term <> '')"
NAMES = f"named AS (SELECT item_id, {NAMED.format(g=", 'g'")} AS n FROM benchmark), {SYN}, ent AS (SELECT DISTINCT item_id, entity FROM named JOIN syn ON CASE WHEN regexp_matches(term, '^[a-z0-9]') THEN contains(' ' || n || ' ', ' ' || term || ' ') ELSE contains(n, term) END)"


def synonyms(t: Tables):
    """(texts (item_id, n), synonyms (term, entity)) of the expansion queries."""
    n = t.benchmark.select("item_id", F.expr(NAMED.format(g="")).alias("n"))
    first = lambda p, e: n.select(F.regexp_extract("n", p, 1).alias("term"), F.concat(F.lit(e), (F.col("item_id") % 25).cast("string")).alias("entity"))
    fixed = t.spark.createDataFrame([("差旅", "Travel"), ("报销流程", "Expense"), ("流程", "Process"), ("the", "Article")], "term string, entity string")
    words = first("^ ?([a-z0-9]+ [a-z0-9]+)", "E").unionByName(first("^ ?([a-z0-9]+ [a-z0-9]+ [a-z0-9]+)", "F"))
    return n, words.where("term <> ''").distinct().unionByName(fixed)


@query("ret06_entity_expansion", f"WITH {NAMES} SELECT item_id, entity AS canonical FROM ent")
def _(t: Tables):
    n, syn = synonyms(t)
    return D.entities_of(n, syn, "item_id", "n").select("item_id", F.col("entity").alias("canonical"))


@query("ret06b_expanded_fulltext", bm25_sql(f"WITH {NAMES}, more AS (SELECT item_id, string_agg(term, ' ' ORDER BY term) AS more FROM (SELECT DISTINCT item_id, term FROM ent JOIN syn USING (entity)) GROUP BY 1) SELECT item_id AS query_id, n || coalesce(' ' || more, '') AS text FROM named LEFT JOIN more USING (item_id) WHERE item_id % 100 = 0") + ", ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM s) WHERE rn <= 20) SELECT query_id, chunk_id, score FROM ft")
def _(t: Tables):
    # synonyms of the entities that a query names go to the full text only
    n, syn = synonyms(t)
    asked = D.expanded(n.where("item_id % 100 = 0"), syn, "item_id", "n").select(F.col("item_id").alias("query_id"), F.col("n").alias("text"))
    return V.bm25(asked, chunks(t), 20)


HYBRID = BM25 + ", " + VEC + ", " + GRAPH + """, side AS (SELECT *, row_number() OVER (PARTITION BY query_id, label >= 5 ORDER BY score DESC, vec_id) AS k FROM vs),
sem AS (SELECT query_id, vec_id || ':0' AS chunk_id, score FROM side WHERE k <= CASE WHEN label >= 5 THEN 8 ELSE 20 END UNION ALL SELECT * FROM gh),
n AS (SELECT query_id, chunk_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS score FROM sem WINDOW w AS (PARTITION BY query_id)
UNION ALL SELECT query_id, chunk_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) FROM ft WINDOW w AS (PARTITION BY query_id)),
h AS (SELECT * FROM (SELECT query_id, chunk_id, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, chunk_id) AS rank FROM n GROUP BY 1, 2) WHERE rank <= 10)"""
HITS = "query_id long, chunk_id string, score double"


def hybrid(t: Tables, k: int = 10, cross_modal=None):
    """Four channels: text vectors, cross-modal vectors (an index of their own), graph, full text; one that fails is empty."""
    of = lambda df: df.select("query_id", F.concat(F.col("vec_id").cast("string"), F.lit(":0")).alias("chunk_id"), "score")
    semantic = [
        lambda: of(V.vector_topk(vector_queries(t), t.embeddings, 20, F.col("label") < 5)),
        cross_modal or (lambda: of(V.vector_topk(vector_queries(t), t.embeddings, 8, F.col("label") >= 5))),
        lambda: graph_hits(t),
    ]
    a, b, c = (V.isolated(f, HITS, t.spark, name) for f, name in zip(semantic, ("vectors", "cross-modal", "graph")))
    return V.merge_channels(a.unionByName(b).unionByName(c), V.isolated(lambda: fulltext(t), HITS, t.spark, "full-text"), k)


@query("ret07_hybrid_search", HYBRID + " SELECT query_id, chunk_id, score FROM h")
def _(t: Tables):
    return hybrid(t)


@query("ret08_failing_channel", HYBRID.replace("label >= 5 THEN 8", "label >= 5 THEN 0") + " SELECT query_id, chunk_id, score FROM h")
def _(t: Tables):
    return hybrid(t, cross_modal=lambda: t.spark.read.parquet(f"{t.sf_dir}/no_such_index.parquet"))


@query("ret08b_channel_fails_running", HYBRID.replace("label >= 5 THEN 8", "label >= 5 THEN 0") + " SELECT query_id, chunk_id, score FROM h")
def _(t: Tables):
    # a channel that plans well and fails in its tasks
    broken = lambda: t.embeddings.where("label >= 5").select(F.col("vec_id").alias("query_id"), F.lit("x").alias("chunk_id"), F.when(F.col("vec_id") >= 0, F.raise_error(F.lit("index lost"))).cast("double").alias("score"))
    return hybrid(t, cross_modal=broken)


@query("ret09_rerank_apply", HYBRID + " SELECT query_id, chunk_id, rerank FROM (SELECT query_id, chunk_id, rerank, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id) AS k FROM (SELECT *, length(body) % 101 / 100.0 AS rerank FROM h JOIN (SELECT chunk_id AS c, body FROM chunks) ON c = chunk_id) WHERE rerank > 0.05) WHERE k <= 5")
def _(t: Tables):
    # the reranker's list: a score for some hits, from the text of the chunk; hits without one leave
    scores = chunks(t).select("chunk_id", ((F.length("body") % 101) / 100.0).alias("rerank")).where("rerank > 0.05")
    return R.latest_by(hybrid(t).join(scores, "chunk_id").select("query_id", "chunk_id", "rerank"), ["query_id"], [F.desc("rerank"), F.asc("chunk_id")], 5)


@query("ret10_parent_expansion", BM25 + ", p AS (SELECT doc_id, substr(text, 1, 60) AS title FROM documents) SELECT query_id, p.doc_id AS parent_id, max(score) AS score, max(p.title) AS title FROM ft JOIN chunks ON chunks.chunk_id = ft.chunk_id LEFT JOIN p ON p.doc_id = chunks.doc_id GROUP BY 1, 2")
def _(t: Tables):
    hits = fulltext(t).withColumn("parent_id", F.split_part("chunk_id", F.lit(":"), F.lit(1)).cast("long"))
    return V.expand_parents(hits, t.docs.select(F.col("doc_id").alias("parent_id"), "title"))


RETRY = "WITH " + VEC + ", f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM vs WHERE label % 2 = 1 AND vec_id <> query_id), j AS (SELECT query_id, round(avg(score) FILTER (WHERE k <= 5), 4) AS m5, round(avg(score) FILTER (WHERE k <= 15), 4) AS m15 FROM f GROUP BY 1)"


def retried(t: Tables):
    """Searches over others of odd labels, again with fifteen where the five best are far off."""
    q = vector_queries(t)
    search = lambda asked, k: R.latest_by(V.vector_topk(asked, t.embeddings, k + 1, F.col("label") % 2 == 1).where("vec_id <> query_id"), ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
    return V.quality_retry(search, q, 5, 10, 0.7)


@query("ret11_quality_retry", RETRY + " SELECT query_id, vec_id, score FROM f JOIN j USING (query_id) WHERE k <= CASE WHEN m5 < 0.7 THEN 15 ELSE 5 END")
def _(t: Tables):
    return retried(t)[0].select("query_id", "vec_id", "score")


@query("ret11b_retry_verdicts", RETRY + " SELECT query_id, CASE WHEN m5 < 0.7 THEN m15 ELSE m5 END AS mean, m5 < 0.7 AS retried, CASE WHEN m5 < 0.7 THEN m15 ELSE m5 END < 0.7 AS insufficient FROM j")
def _(t: Tables):
    return retried(t)[1]


@query("ret03b_title_field", bm25_sql("SELECT doc_id AS query_id, substr(text, 1, 60) AS text FROM documents WHERE doc_id % 100 = 0 AND length(text) > 0") + " SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS k FROM s) WHERE k <= 5")
def _(t: Tables):
    titles = t.documents.where("doc_id % 100 = 0 and length(text) > 0").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 60).alias("text"))
    return V.bm25(titles, chunks(t), 5)


@query("ret12_faq_shortcut", BM25 + " SELECT query_id, chunk_id, score FROM (SELECT query_id, s.chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s.chunk_id) AS k FROM s JOIN chunks ON chunks.chunk_id = s.chunk_id WHERE doc_id % 5 = 0) WHERE k = 1 AND score >= 15")
def _(t: Tables):
    return fulltext(t, 1, keep=F.col("doc_id") % 5 == 0).where("score >= 15")  # every fifth document is a FAQ


@query("ret13_conflict_resolution", "SELECT doc_id FROM (SELECT doc_id, version_of, row_number() OVER (PARTITION BY version_of ORDER BY CASE kb_id WHEN 'src0' THEN 5 WHEN 'src6' THEN 4 ELSE 1 END DESC, updated_on DESC NULLS LAST, doc_id) AS rn FROM docs) WHERE version_of IS NULL OR rn = 1")
def _(t: Tables):
    a = F.when(F.col("kb_id") == "src0", 5).when(F.col("kb_id") == "src6", 4).otherwise(1)
    return V.resolve_conflicts(t.docs, "version_of", a, "updated_on", "doc_id").select("doc_id")


@query("ret14_semantic_cache", "WITH " + VEC + " SELECT query_id, vec_id, score FROM (SELECT vs.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vs.vec_id) AS k FROM vs JOIN embeddings q ON q.vec_id = query_id WHERE vs.label % 3 = q.label % 3 AND vs.vec_id % 2 = q.vec_id % 2 AND vs.vec_id % 30 < 14) WHERE k = 1 AND score >= 0.95")
def _(t: Tables):
    # entries of the cache: tenant and scope by label and id, a fortnight to live
    scope = F.concat_ws("/", (F.col("label") % 3).cast("string"), (F.col("vec_id") % 2).cast("string"))
    e = t.embeddings.withColumn("scope", scope)
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "scope")
    return V.vector_topk(asked, e, 1, F.col("vec_id") % 30 < 14, same="scope").where("score >= 0.95")


@query("ret15_retrieval_match", "WITH " + VEC + " SELECT query_id, max(score) FILTER (WHERE vec_id <> query_id) < 0.3 AS mismatch FROM vs GROUP BY query_id")
def _(t: Tables):
    return V.vector_topk(vector_queries(t), t.embeddings, 2).where("vec_id <> query_id").groupBy("query_id").agg((F.max("score") < 0.3).alias("mismatch"))


FACTS = """facts AS (SELECT vec_id AS fact_id, label AS user_id, 'Fact ' || (vec_id % 50) AS text, CASE WHEN vec_id % 7 <> 0 THEN embedding END AS embedding, vec_id % 60 AS age, vec_id % 13 <> 0 AND vec_id % 17 <> 0 AS live FROM embeddings),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY age, fact_id) AS n FROM facts WHERE live) WHERE n <= 15),
asked AS (SELECT vec_id AS query_id, label AS user_id, CASE WHEN vec_id % 200 = 0 THEN 'fact ' || (vec_id // 100 % 50) ELSE 'no such thing' END AS text, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
c AS (SELECT query_id, fact_id, n, contains(lower(f.text), lower(a.text)) AS holds, CASE WHEN f.embedding IS NULL THEN CASE WHEN contains(lower(f.text), lower(a.text)) THEN 0.0 END WHEN round(list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])), 6) >= 0.3 THEN round(round(list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])), 6) * exp(-ln(2.0) * age / 30), 6) END AS score FROM asked a JOIN newest f ON f.user_id = a.user_id),
p AS (SELECT *, CASE WHEN max(score) OVER w IS NOT NULL THEN 0 WHEN bool_or(holds) OVER w THEN 1 ELSE 2 END AS path FROM c WINDOW w AS (PARTITION BY query_id))"""


@query("ret16_memory_search", f"WITH {FACTS} SELECT query_id, fact_id, path, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN path = 0 THEN score END DESC NULLS LAST, n) AS place FROM p WHERE CASE path WHEN 0 THEN score IS NOT NULL WHEN 1 THEN holds ELSE true END) WHERE place <= 5")
def _(t: Tables):
    day = lambda age: F.expr(f"timestamp_ntz'2024-01-31 00:00:00' - make_interval(0, 0, 0, cast({age} as int))")
    facts = t.embeddings.select(F.col("vec_id").alias("fact_id"), F.col("label").alias("user_id"), F.concat(F.lit("Fact "), (F.col("vec_id") % 50).cast("string")).alias("text"), F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("embedding"), (F.col("vec_id") % 13 != 0).alias("active"), F.when(F.col("vec_id") % 17 == 0, day("1")).alias("expires_at"), day("vec_id % 60").alias("created_at"))
    text_ = F.when(F.col("vec_id") % 200 == 0, F.concat(F.lit("fact "), (F.floor(F.col("vec_id") / 100) % 50).cast("string"))).otherwise("no such thing")
    asked = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("user_id"), text_.alias("text"), F.col("embedding").alias("q"))
    return V.memory_search(asked, facts, as_of(), 5)


@query("ret17_memory_duplicates", "WITH facts AS (SELECT vec_id, label, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, label, embedding FROM embeddings WHERE vec_id % 200 = 0), q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0) SELECT DISTINCT q.vec_id AS query_id FROM q JOIN facts f ON f.label = q.label AND f.vec_id <> q.vec_id AND round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])), 6) >= 0.85")
def _(t: Tables):
    # a search: the facts asked about against all facts of their category, some of which were said twice; itself is one of the nearest
    e = t.embeddings.select("vec_id", "label", "embedding")
    e = e.union(e.where("vec_id % 200 = 0").select(F.col("vec_id") + 1000000, "label", "embedding")).withColumn("category", F.col("label").cast("string"))
    asked = e.where("vec_id % 100 = 0 and vec_id < 1000000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "category")
    return V.vector_topk(asked, e, 3, same="category").where("vec_id <> query_id and score >= 0.85").select("query_id").distinct()


WISH = "lower(text) || CASE item_id % 300 WHEN 0 THEN ' a small widget, economy' WHEN 100 THEN ' brand bolt bolt' ELSE '' END"


@query("ret18_skill_match", f"""WITH asked AS (SELECT item_id AS query_id, unnest(list_filter(regexp_extract_all({WISH}, '[a-zA-Z][a-zA-Z0-9_]*'), lambda w: length(w) >= 2 AND w NOT IN ({", ".join(f"'{w}'" for w in rules.STOP_EN)}))) AS w FROM benchmark WHERE item_id % 100 = 0),
skills AS (SELECT p_partkey AS skill_id, lower(p_name) AS name, lower(p_type) AS category, lower(p_brand) AS tag, lower(p_name || ' of ' || p_type) AS description FROM part),
k AS (SELECT query_id, skill_id, sum(CASE WHEN contains(name, w) THEN 10 ELSE 0 END + CASE WHEN contains(category, w) THEN 5 ELSE 0 END + CASE WHEN contains(tag, w) THEN 8 ELSE 0 END + CASE WHEN contains(description, w) THEN 3 ELSE 0 END) AS points FROM asked, skills GROUP BY 1, 2),
f AS (SELECT query_id, skill_id, round(points + CASE WHEN sim >= 0.4 THEN sim * 10 ELSE 0 END, 6) AS score FROM (SELECT i.item_id AS query_id, skills.skill_id, coalesce(points, 0) AS points, round(coalesce(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 0), 6) AS sim FROM (SELECT item_id FROM benchmark WHERE item_id % 100 = 0) i CROSS JOIN skills LEFT JOIN k ON k.query_id = i.item_id AND k.skill_id = skills.skill_id LEFT JOIN embeddings q ON q.vec_id = i.item_id LEFT JOIN embeddings v ON v.vec_id = skills.skill_id) k),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, skill_id) AS n FROM f WHERE score >= 5)
SELECT query_id, skill_id, score, false AS "all" FROM r WHERE n <= 3 UNION ALL SELECT item_id, NULL, 0.0, true FROM benchmark WHERE item_id % 100 = 0 AND item_id NOT IN (SELECT query_id FROM r)""")
def _(t: Tables):
    v = t.embeddings.select("vec_id", F.col("embedding").alias("e"))
    asked = t.benchmark.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), rules.skill_terms(F.expr(WISH)).alias("terms"))
    asked = asked.join(v, F.col("vec_id") == F.col("query_id"), "left").select("query_id", "terms", F.col("e").alias("q"))
    skills = t.part.join(v, F.col("vec_id") == F.col("p_partkey"), "left").select(F.col("p_partkey").alias("skill_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.array("p_brand").alias("tags"), F.concat_ws(" of ", "p_name", "p_type").alias("description"), F.col("e").alias("embedding"))
    return V.skill_match(asked, skills, 3)


@query("ret19_drift_ladder", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), f AS (SELECT a.vec_id, a.label, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
d AS (SELECT *, CASE WHEN vec_id % 9 = 0 THEN 'keep' WHEN vec_id % 9 = 1 THEN 'reset' WHEN s < 0.4 THEN 'drift' WHEN s < 0.6 THEN 'possible' ELSE 'keep' END AS state, vec_id % 11 < 4 AS unsure FROM f),
g AS (SELECT *, sum(CASE WHEN unsure THEN 0 ELSE 1 END) OVER (PARTITION BY label ORDER BY vec_id) AS run FROM d)
SELECT vec_id, CASE WHEN state IN ('keep', 'possible') AND streak >= 3 THEN 'reset' ELSE state END AS state, streak FROM (SELECT *, CAST(sum(CASE WHEN unsure THEN 1 ELSE 0 END) OVER (PARTITION BY label, run ORDER BY vec_id) AS BIGINT) AS streak FROM g)""")
def _(t: Tables):
    # turns of a session (label) in the order of ids; the next vector is the focus, rules and confidence go by id
    nxt = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("focus"))
    s = t.embeddings.join(nxt, "vec_id").select("vec_id", "label", F.round(maths.cosine(F.col("embedding"), F.col("focus")), 6).alias("s"))
    m = F.col("vec_id") % 9
    return V.drift_ladder(s, "label", "vec_id", keep=m == 0, switch=m == 1, unsure=F.col("vec_id") % 11 < 4).select("vec_id", "state", "streak")


@query("ret20_image_rows", "SELECT page_id, 'image ' || CAST(page_id AS VARCHAR) AS content, length('image ' || CAST(page_id AS VARCHAR)) // 2 AS tokens FROM pages WHERE contains(html, '<script')")
def _(t: Tables):
    c = F.concat(F.lit("image "), F.col("page_id").cast("string"))
    return t.pages.where(F.col("html").contains("<script")).select("page_id", c.alias("content"), F.floor(F.length(c) / 2).alias("tokens"))


@query("ret21_multi_query_set", "SELECT DISTINCT item_id, q FROM (SELECT item_id, unnest([lower(text), substr(lower(text), 1, 40), lower(text)]) AS q FROM benchmark)")
def _(t: Tables):
    low = F.lower("text")
    return t.benchmark.select("item_id", F.explode(F.array_distinct(F.array(low, F.substring(low, 1, 40), low))).alias("q"))


# --- chunking: every row bears a hash of its content

KINDS = ["faq", "tutorial", "specification", "report", "plain", "auto"]


def hashed(chunks):
    return chunks.select("doc_id", "n", "strategy", "title_path", F.md5("content").alias("content_md5"), "start_pos", "end_pos", "tokens", F.col("parent_id").isNotNull().alias("is_child"))


@query("ch01_router")
def _(t: Tables):
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return hashed(C.chunk_docs(t.docs, kind=kind))


@query("ch02_qa_split")
def _(t: Tables):
    own = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))), lambda m: F.concat(F.when(m["role"] == "assistant", "A: ").otherwise("Q: "), F.regexp_replace(m["content"], "\n", " ")))
    qa = t.messages.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(own, "\n").alias("content"))
    return hashed(C.chunk_docs(qa, kind="faq"))


def headed(t: Tables):
    """Documents as Markdown of several levels: every line under a heading."""
    return t.docs.select("doc_id", F.concat(F.lit("# Top\n"), F.regexp_replace("content", "\n", "\n## Part\n### Detail\n")).alias("content"))


@query("ch03_markdown_split")
def _(t: Tables):
    return hashed(C.chunk_docs(headed(t), kind="tutorial").where("strategy = 'structural'"))


@query("ch04_html_split")
def _(t: Tables):
    html = t.docs.select("doc_id", F.concat(F.lit("<H1>Top</H1><p>"), F.regexp_replace("content", "\n", "</p>\n<h2 class='x'>Part <b>two</b></h2>\n<p>"), F.lit("</p><h4>End\nof text</h4>")).alias("content"))
    return hashed(C.chunk_docs(html, kind="specification").where("strategy = 'structural'"))


SETS = "[a-z]+|[\\x{4E00}-\\x{9FFF}]"
BLANK = "[ \\t\\n\\f\\r\\x0B]"
UNITS = f"""cut AS (SELECT doc_id, content, list_filter(list_transform(string_split_regex(content, '\\n{BLANK}*\\n'), lambda x: regexp_replace(x, '^{BLANK}+|{BLANK}+$', '', 'g')), lambda x: x <> '') AS p FROM docs),
units AS (SELECT doc_id, CASE WHEN len(p) > 1 THEN p ELSE list_filter(list_transform(string_split(regexp_replace(content, '([。！？.!?]){BLANK}*', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^{BLANK}+|{BLANK}+$', '', 'g')), lambda x: x <> '') END AS u FROM cut)"""
TILE = f"""WITH {UNITS}, w AS (SELECT doc_id, s, list_distinct(regexp_extract_all(lower(array_to_string(u[s + 1 : s + 3], '')), '{SETS}')) AS w FROM (SELECT doc_id, u, unnest(range(0, len(u) - 3)) AS s FROM units WHERE len(u) > 6)),
sims AS (SELECT b.doc_id, b.s AS i, CASE WHEN len(a.w) = 0 AND len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) * 1.0 / len(list_distinct(list_concat(a.w, b.w))) END AS sim FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.s = a.s + 3)"""


def tiles(t: Tables):
    return V.tiling(t.docs.select("doc_id", text.units(F.col("content")).alias("units")))


@query("wf07_texttiling", f"{TILE} SELECT doc_id, i, round(sim, 6) AS sim FROM sims")
def _(t: Tables):
    return tiles(t).select("doc_id", F.col("i").cast("long").alias("i"), F.round("sim", 6).alias("sim"))


@query("wf08_boundary_threshold", f"{TILE} SELECT doc_id, count(*) AS n, round(avg(sim) - stddev_pop(sim), 6) AS threshold FROM sims GROUP BY doc_id")
def _(t: Tables):
    return tiles(t).groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.avg("sim") - F.stddev_pop("sim"), 6).alias("threshold"))


@query("ch05_semantic_split")
def _(t: Tables):
    return hashed(C.chunk_docs(t.docs, split=lambda x, _: C.semantic(x or "")))


@query("ch06_parent_child")
def _(t: Tables):
    return hashed(C.chunk_docs(t.docs, kind="plain").where("strategy = 'semantic'"))


@query("ch07_fixed_split")
def _(t: Tables):
    return hashed(C.chunk_docs(t.docs, split=lambda x, _: C.fixed(x) if x and x.strip() else []))


@query("ch07b_fixed_overlap")
def _(t: Tables):
    return hashed(C.chunk_docs(t.docs, split=lambda x, _: C.fixed(x, overlap=C.OVERLAP) if x and x.strip() else []))


@query("ch08_pack_by_tokens")
def _(t: Tables):
    return hashed(C.chunk_docs(t.docs, split=lambda x, _: [C.Chunk(p, "pack") for p in C.split_by_tokens(x or "", 256)]))


@query("ch09_transcript_windows")
def _(t: Tables):
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) * 17.0
    seg = t.events.withColumn("start", at).select("user_id", "start", (F.col("start") + 5 + F.col("value") % 30).alias("end"), F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat_ws(" ", "event_type", "props")).alias("said"))
    frames = t.events.where("event_id % 5 = 0").select("user_id", (F.col("event_id") % 900 * 1.0).alias("at"), F.col("event_type").alias("shown"))
    return C.chunk_transcripts(seg, frames, "user_id").select("user_id", "n", "title_path", F.md5("content").alias("content_md5"), "start_pos", "end_pos", "tokens")


# --- evaluation

RANKED = "ranked AS (SELECT user_id, doc_id, row_number() OVER (PARTITION BY user_id ORDER BY first_at) AS pos FROM (SELECT user_id, doc_id, min(event_id) AS first_at FROM behaviors GROUP BY 1, 2)), r AS (SELECT user_id, pos, CASE WHEN doc_id % 7 = user_id % 7 THEN 1 ELSE 0 END AS hit, (199 - user_id % 7) // 7 + 1 AS n_rel FROM ranked WHERE pos <= 10)"


def cases(t: Tables):
    first = t.behaviors.groupBy("user_id", "doc_id").agg(F.min("event_id").alias("at"))
    g = first.groupBy("user_id").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("at", "doc_id"))), 1, 10), lambda s: s["doc_id"]).alias("ranked"))
    return g.withColumn("relevant", F.filter(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long")), lambda d: d % 7 == F.col("user_id") % 7))


@query("ev01_recall_at_k", f"WITH {RANKED} SELECT user_id, round(sum(hit) FILTER (WHERE pos <= 5) * 1.0 / max(n_rel), 6) AS recall FROM r GROUP BY user_id")
def _(t: Tables):
    return cases(t).select("user_id", F.round(maths.recall_at(F.col("ranked"), F.col("relevant"), 5), 6).alias("recall"))


@query("ev02_mrr", f"WITH {RANKED} SELECT user_id, round(coalesce(1.0 / min(pos) FILTER (WHERE hit = 1), 0.0), 6) AS mrr FROM r GROUP BY user_id")
def _(t: Tables):
    return cases(t).select("user_id", F.round(maths.reciprocal_rank(F.col("ranked"), F.col("relevant")), 6).alias("mrr"))


@query("wf13_dcg", f"WITH {RANKED} SELECT user_id, round(sum(hit / log2(pos + 1)), 6) AS dcg FROM r GROUP BY user_id")
def _(t: Tables):
    rel = F.transform("ranked", lambda d: F.array_contains("relevant", d).cast("int"))
    return cases(t).select("user_id", F.round(maths.dcg(rel), 6).alias("dcg"))


@query("ev03_ndcg", f"WITH {RANKED} SELECT user_id, round(coalesce(sum(hit / log2(pos + 1)) FILTER (WHERE pos <= 5), 0) / (1 / log2(2) + 1 / log2(3) + 1 / log2(4) + 1 / log2(5) + 1 / log2(6)), 6) AS ndcg FROM r GROUP BY user_id")
def _(t: Tables):
    return cases(t).select("user_id", F.round(maths.ndcg_at(F.col("ranked"), F.col("relevant"), 5), 6).alias("ndcg"))


@query("ev04_rag_metrics", f"WITH {RANKED}, c AS (SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY pos) AS hits FROM r) SELECT user_id, round(sum(hit) FILTER (WHERE pos <= 3) / 3.0, 4) AS p3, round(sum(hit) FILTER (WHERE pos <= 3) * 1.0 / max(n_rel), 4) AS r3, max(hit) > 0 AS any_hit, round(sum(hit * hits * 1.0 / pos) / max(n_rel), 4) AS ap FROM c GROUP BY user_id")
def _(t: Tables):
    ranked, rel = F.col("ranked"), F.col("relevant")
    h3 = F.size(F.filter(F.slice(ranked, 1, 3), lambda d: F.array_contains(rel, d)))
    return cases(t).select("user_id", F.round(h3 / 3.0, 4).alias("p3"), F.round(h3 / F.size(rel), 4).alias("r3"), F.arrays_overlap(ranked, rel).alias("any_hit"), F.round(maths.average_precision(ranked, rel), 4).alias("ap"))


@query("ev05_hit_at_k", f"WITH {RANKED} SELECT user_id, coalesce(max(hit) FILTER (WHERE pos <= 3), 0) = 1 AS hit FROM r GROUP BY user_id")
def _(t: Tables):
    return cases(t).select("user_id", F.arrays_overlap(F.slice("ranked", 1, 3), F.col("relevant")).alias("hit"))


@query("ev06_heuristic_relevancy", "SELECT a.item_id, round(least(len(list_intersect(a.s, b.s)) * 1.0 / len(a.s), 1.0), 6) AS relevancy FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS s FROM benchmark) a JOIN (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS s FROM benchmark) b ON b.item_id = a.item_id + 1 WHERE len(a.s) > 0")
def _(t: Tables):
    a = t.benchmark.select("item_id", text.mixed_tokens(F.col("text")).alias("q"))
    b = t.benchmark.select((F.col("item_id") - 1).alias("item_id"), text.mixed_tokens(F.col("text")).alias("a"))
    return a.join(b, "item_id").where("size(q) > 0").select("item_id", F.round(F.least(F.size(F.array_intersect("q", "a")) / F.size("q"), F.lit(1.0)), 6).alias("relevancy"))


#: A question, an answer in sentences, an expected answer and three contexts, from a text and the next one.
GRADED = """g AS (SELECT a.item_id, replace(regexp_replace(lower(a.text), '[^ -~]', '', 'g'), '. ', '。') AS answer, replace(regexp_replace(lower(b.text), '[^ -~]', '', 'g'), '. ', '。') AS expected, [substr(regexp_replace(lower(b.text), '[^ -~]', '', 'g'), 1, 100), regexp_replace(lower(a.text), '[^ -~]', '', 'g'), substr(regexp_replace(lower(b.text), '[^ -~]', '', 'g'), 50)] AS contexts FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
tok AS (SELECT *, list_distinct(regexp_extract_all(array_to_string(contexts, chr(10)), '[a-z0-9]+')) AS known, list_distinct(regexp_extract_all(expected, '[a-z0-9]+')) AS wanted FROM g)"""
SUPPORT = "len(list_filter(s, lambda x: len(list_intersect(list_distinct(regexp_extract_all(x, '[a-z0-9]+')), known)) > len(list_distinct(regexp_extract_all(x, '[a-z0-9]+'))) * 0.5)) / len(s)"
PARTS = "list_filter(list_transform(string_split({c}, '。'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


@query("ev06b_heuristic_rag_scores", f"""WITH {GRADED}, f AS (SELECT item_id, {SUPPORT} AS faithfulness FROM (SELECT item_id, known, {PARTS.format(c='answer')} AS s FROM tok)), r AS (SELECT item_id, CASE WHEN len(s) = 0 THEN 1.0 ELSE {SUPPORT} END AS recall FROM (SELECT item_id, known, {PARTS.format(c='expected')} AS s FROM tok)),
rel AS (SELECT item_id, i, least(len(list_intersect(wanted, list_distinct(regexp_extract_all(contexts[i], '[a-z0-9]+')))) / greatest(len(wanted), 1), 1.0) AS rel FROM tok, range(1, 4) t(i)),
d AS (SELECT item_id, sum(rel / log2(i + 1)) AS dcg, sum(best / log2(i + 1)) AS ideal FROM (SELECT *, list_extract(list_reverse_sort(list(rel) OVER (PARTITION BY item_id)), i) AS best FROM rel) GROUP BY 1)
SELECT item_id, round(faithfulness, 6) AS faithfulness, round(CASE WHEN ideal = 0 THEN 0.0 ELSE dcg / ideal END, 6) AS precision, round(recall, 6) AS recall FROM f JOIN r USING (item_id) JOIN d USING (item_id)""")
def _(t: Tables):
    plain = lambda c: F.regexp_replace(F.lower(c), "[^ -~]", "")
    nxt = t.benchmark.select((F.col("item_id") - 1).alias("item_id"), plain("text").alias("b"))
    j = t.benchmark.select("item_id", plain("text").alias("a")).join(nxt, "item_id")
    contexts = F.array(F.substring("b", 1, 100), F.col("a"), F.substr("b", F.lit(50)))
    stop = lambda c: F.replace(F.col(c), F.lit(". "), F.lit("。"))
    scores = {"faithfulness": maths.supported(stop("a"), contexts, 0.0), "precision": maths.graded_precision(stop("b"), contexts), "recall": maths.supported(stop("b"), contexts, 1.0)}
    return j.select("item_id", *[F.round(v, 6).alias(k) for k, v in scores.items()])


@query("ev07_rule_checks", "SELECT conv_id, turn, CASE WHEN turn % 4 = 1 AND NOT contains(content, 'the') THEN 'pass' WHEN turn % 4 <> 1 THEN 'not_refused' ELSE 'leak' END AS verdict FROM messages")
def _(t: Tables):
    c = F.concat("content", F.when(F.col("turn") % 4 == 1, "，拒绝").otherwise(""))
    refused, leak = text.any_of(c, text.REFUSALS), c.contains("the")
    return t.messages.select("conv_id", "turn", F.when(refused & ~leak, "pass").when(~refused, "not_refused").otherwise("leak").alias("verdict"))


@query("ev08_regression_gate", "SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'new' WHEN b.user_id IS NULL THEN 'missing' WHEN a.v >= 50 AND b.v < 50 THEN 'pass_to_fail' WHEN a.v > 0 AND (a.v - b.v) / a.v > 0.05 THEN 'metric_drop' ELSE 'ok' END AS verdict FROM (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1) a FULL JOIN (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'signup' GROUP BY 1) b ON a.user_id = b.user_id")
def _(t: Tables):
    a = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.avg("value").alias("a"))
    b = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.avg("value").alias("b"))
    was, now = F.col("a"), F.col("b")
    v = F.when(was.isNull(), "new").when(now.isNull(), "missing").when((was >= 50) & (now < 50), "pass_to_fail").when((was > 0) & ((was - now) / was > 0.05), "metric_drop").otherwise("ok")
    return a.join(b, "user_id", "full").select("user_id", v.alias("verdict"))


@query("ev09_parse_quality")
def _(t: Tables):
    from ..functions.folds import parse_quality
    from .text import parsed_pairs

    q = parse_quality(parsed_pairs(t), "standard", "parsed")
    return q.groupBy("source").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("text_score", "table_score", "formula_score", "layout_score", "overall")])


@query("ev10_injection_verdict", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'pass' WHEN contains(lower(text), 'the') OR contains(lower(text), 'secret') THEN 'fail' ELSE 'partial' END AS verdict FROM benchmark")
def _(t: Tables):
    c = F.concat("text", F.when(F.col("item_id") % 3 == 0, "，拒绝, injection").otherwise(""))
    refused = text.any_of(c, text.REFUSALS)
    hit = text.any_of(F.lower(c), ["the", "secret"])
    return t.benchmark.select("item_id", F.when(~refused & hit, "fail").when(refused & F.lower(c).contains("injection"), "pass").otherwise("partial").alias("verdict"))
