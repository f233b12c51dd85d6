"""Queries: scans, sinks, filters, projections, joins, windows, top-k, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators.store import VectorStore
from ..session import scratch
from .registry import AS_OF, Tables, query

TS = f"TIMESTAMP '{AS_OF}'"
LEVEL = "CASE {c} WHEN 'public' THEN 0 WHEN 'internal' THEN 1 WHEN 'confidential' THEN 2 WHEN 'secret' THEN 3 END"

# --- scans


@query("src01_table_scan", "SELECT doc_id, title, kb_id FROM docs WHERE deleted_at IS NULL AND tenant_id = 1")
def _(t: Tables):
    return R.scan(t.docs, 1).select("doc_id", "title", "kb_id")


@query("src02_paged_scan", "SELECT doc_id, title, (SELECT count(*) FROM docs WHERE deleted_at IS NULL) AS total FROM (SELECT * FROM docs WHERE deleted_at IS NULL ORDER BY updated_on DESC, doc_id LIMIT 20 OFFSET 20)")
def _(t: Tables):
    live = R.scan(t.docs)
    return R.page(live, [F.desc("updated_on"), F.asc("doc_id")], 2, 20).select("doc_id", "title").crossJoin(F.broadcast(live.agg(F.count("*").alias("total"))))


@query("src03_jsonl_reader", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 10 <> 3 AND json_valid(props)")
def _(t: Tables):
    from ..sources.jsonl import parse_lines

    lines = t.events.select("event_id", F.when(F.col("event_id") % 10 == 3, F.lit("{broken")).otherwise(F.col("props")).alias("line"))
    return parse_lines(lines, "line", "k long").select("event_id", "k")


@query("src04_eval_dataset_loader", "SELECT CAST(item_id AS VARCHAR) AS case_id, text AS query, 'normal' AS case_type, substr(sha1(text || chr(31) || CAST(item_id AS VARCHAR) || chr(31) || 'normal'), 1, 12) AS fingerprint FROM benchmark WHERE item_id % 7 <> 0")
def _(t: Tables):
    from ..sources.jsonl import load_eval_cases

    lines = t.benchmark.select(F.when(F.col("item_id") % 7 == 0, F.when(F.col("item_id") % 14 == 0, F.lit("# note")).otherwise(F.lit('{"query": ""}'))).otherwise(F.to_json(F.struct(F.col("text").alias("query"), F.col("item_id").alias("case_id")))).alias("line"))
    return load_eval_cases(lines, "line")


@query("src05_jsonl_preview", "SELECT event_id, props FROM events ORDER BY event_id LIMIT 25")
def _(t: Tables):
    return t.events.select("event_id", "props").orderBy("event_id").limit(25)


@query("src06_open_dataset_converter", "SELECT conv_id, max(text) FILTER (WHERE role = 'user' AND turn = fu) AS question, max(text) FILTER (WHERE role = 'assistant' AND turn = fa) AS answer FROM (SELECT *, min(turn) FILTER (WHERE role = 'user' AND trim(text) <> '') OVER (PARTITION BY conv_id) AS fu, min(turn) FILTER (WHERE role = 'assistant' AND trim(text) <> '') OVER (PARTITION BY conv_id) AS fa FROM conversations) GROUP BY conv_id HAVING max(fu) IS NOT NULL AND max(fa) IS NOT NULL")
def _(t: Tables):
    from ..sources.jsonl import to_sft

    return to_sft(t.conversations)


#: Records of four shapes, each whole, blank, missing, of another type, or with lists, by id; w is plain words.
RAW = {
    "ranking": ["'{\"query\": \" ' || w || ' \", \"positive\": [\" \", 3, \"p ' || w || '\"], \"negative\": \"n\"}'", "'{\"query\": \"' || w || '\", \"positive\": [], \"negative\": [\"n\"]}'"],
    "reading": ["'{\"question\": \"' || w || '\", \"answers\": [{\"text\": \" \"}, {\"text\": \"a ' || w || '\", \"answer_start\": 3}]}'", "'{\"question\": \"' || w || '\", \"answers\": {\"text\": [\"\", \" b \"]}}'", "'{\"question\": \"q\", \"answers\": [null, \"' || w || '\"]}'", "'{\"question\": 7, \"answers\": [\"x\"]}'", "'{\"question\": \"q\", \"answers\": {\"text\": \"c\"}}'"],
    "instruction": ["'{\"instruction\": \"' || w || '\", \"input\": \" more \", \"output\": \"o\"}'", "'{\"instruction\": \"' || w || '\", \"input\": null, \"output\": \" o2\"}'", "'{\"instruction\": \"' || w || '\", \"output\": [\"o\"]}'"],
    "preference": ["'{\"question\": \"' || w || '\", \"response_chosen\": \"yes\", \"response_rejected\": \"no\"}'", "'{\"question\": \"' || w || '\", \"response_chosen\": \"yes\", \"response_rejected\": \" yes \"}'", "'{\"question\": \"' || w || '\", '"],
}
RECORDS = [(shape, raw) for shape, raws in RAW.items() for raw in raws]
RAW_OF = "CASE item_id % " + str(len(RECORDS)) + " " + " ".join(f"WHEN {i} THEN {raw}" for i, (_, raw) in enumerate(RECORDS)) + " END"
SHAPE_OF = "CASE item_id % " + str(len(RECORDS)) + " " + " ".join(f"WHEN {i} THEN '{shape}'" for i, (shape, _) in enumerate(RECORDS)) + " END"
AT = lambda p: f"nullif(trim(CASE WHEN json_type(j, '{p}') = 'VARCHAR' THEN json_extract_string(j, '{p}') END), '')"
FIRST = lambda p: f"coalesce({AT(p)}, list_filter(list_transform(CASE WHEN json_type(j, '{p}') = 'ARRAY' THEN CAST(json_extract(j, '{p}') AS JSON[]) ELSE [] END, lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN nullif(trim(json_extract_string(x, '$')), '') END), lambda x: x IS NOT NULL)[1])"
ANSWER = "coalesce(list_filter(list_transform(CASE WHEN json_type(j, '$.answers') = 'ARRAY' THEN CAST(json_extract(j, '$.answers') AS JSON[]) ELSE [] END, lambda x: CASE json_type(x) WHEN 'VARCHAR' THEN nullif(trim(json_extract_string(x, '$')), '') WHEN 'OBJECT' THEN nullif(trim(json_extract_string(x, '$.text')), '') END), lambda x: x IS NOT NULL)[1], " + FIRST("$.answers.text") + ")"


@query("src06b_datasets_by_shape", f"""WITH r AS (SELECT item_id, {SHAPE_OF} AS shape, {RAW_OF} AS raw FROM (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z ]', '', 'g')) AS w FROM benchmark)), p AS (SELECT item_id, shape, CAST(raw AS JSON) AS j FROM r WHERE json_valid(raw)),
o AS (SELECT item_id, 'embedding' AS kind, {AT('$.query')} AS a, {FIRST('$.positive')} AS b, {FIRST('$.negative')} AS c FROM p WHERE shape = 'ranking' UNION ALL SELECT item_id, 'sft', {AT('$.question')}, {ANSWER}, '' FROM p WHERE shape = 'reading'
UNION ALL SELECT item_id, 'sft', {AT('$.instruction')} || coalesce(chr(10) || chr(10) || {AT('$.input')}, ''), {AT('$.output')}, '' FROM p WHERE shape = 'instruction' UNION ALL SELECT item_id, 'dpo', {AT('$.question')}, {AT('$.response_chosen')}, {AT('$.response_rejected')} FROM p WHERE shape = 'preference')
SELECT * FROM o WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND NOT (kind = 'dpo' AND b = c)""")
def _(t: Tables):
    from ..sources.shapes import converted

    w = t.benchmark.select("item_id", F.trim(F.regexp_replace(F.lower("text"), "[^a-z ]", "")).alias("w"))
    c = converted(w.select("item_id", F.expr(SHAPE_OF).alias("shape"), F.expr(RAW_OF).alias("raw")))
    return c.select("item_id", "kind", F.coalesce("query", "question", "prompt").alias("a"), F.coalesce("pos", "answer", "chosen").alias("b"), F.coalesce("neg", "rejected", F.lit("")).alias("c"))


@query("src07_markdown_reader", "SELECT doc_id, text FROM documents WHERE text LIKE '%' || chr(10) || '%'")
def _(t: Tables):
    return t.documents.where(F.col("text").contains("\n")).select("doc_id", "text")


@query("src08_html_source")
def _(t: Tables):
    from ..sources.html import clean_pages

    return clean_pages(t.pages)


@query("src09_rows_to_html", "SELECT o_orderpriority AS sheet, '<table>' || string_agg('<tr><td>' || CAST(o_orderkey AS VARCHAR) || '</td><td>' || o_orderstatus || '</td></tr>', '' ORDER BY o_orderkey) || '</table>' AS html FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 100 GROUP BY 1")
def _(t: Tables):
    from ..sources.html import sheet_to_html

    return sheet_to_html(t.orders, "o_orderpriority", "o_orderkey", ["o_orderkey", "o_orderstatus"], 100).withColumnRenamed("o_orderpriority", "sheet")


@query("src12_section_concat", "SELECT conv_id, string_agg('<!-- page ' || CAST(turn + 1 AS VARCHAR) || ' -->' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS document FROM conversations GROUP BY conv_id")
def _(t: Tables):
    parts = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda s: F.concat(F.lit("<!-- page "), (s["turn"] + 1).cast("string"), F.lit(" -->\n"), s["text"])), "\n\n").alias("document"))


@query("src13_parser_registry", "SELECT doc_type, count(*) AS n, CAST(sum(length(parsed)) AS BIGINT) AS chars FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'html' ELSE 'bin' END AS doc_type, CASE doc_id % 3 WHEN 1 THEN regexp_replace(text, '<[^>]+>', '', 'g') WHEN 0 THEN text ELSE '' END AS parsed FROM documents) GROUP BY 1")
def _(t: Tables):
    from ..sources.registry import parse

    docs = t.documents.select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "md").when(F.col("doc_id") % 3 == 1, "html").otherwise("bin").alias("doc_type"))
    return parse(docs).groupBy("doc_type").agg(F.count("*").alias("n"), F.sum(F.length("parsed")).alias("chars"))


@query("src17_fetch_by_ids", "SELECT doc_id, title FROM docs WHERE doc_id IN (SELECT clicked_doc_id FROM searches WHERE clicked)")
def _(t: Tables):
    ids = t.searches.where("clicked").select(F.col("clicked_doc_id").alias("doc_id"))
    return t.docs.join(ids, "doc_id", "left_semi").select("doc_id", "title")


# --- sinks, as the state they leave


@query("snk02_vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN label + 200 WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 4 <> 0 OR vec_id % 3 = 0")
def _(t: Tables):
    # a store with three of four vectors gains and replaces every third, every sixth twice: the later row stays; who opens the path again reads it
    path, kind = scratch(t.spark, "vectors"), dict(t.embeddings.dtypes)["label"]
    store = VectorStore(t.spark, path, t.embeddings.schema)
    store.upsert(t.embeddings.where("vec_id % 4 <> 0"))
    new = t.embeddings.where("vec_id % 3 = 0").withColumn("label", (F.col("label") + 100).cast(kind))
    again = t.embeddings.where("vec_id % 6 = 0").withColumn("label", (F.col("label") + 200).cast(kind))
    store.upsert(new.union(again))
    return VectorStore(t.spark, path).table().select("vec_id", "label")


@query("snk02b_store_versions", "SELECT 2 AS version, vec_id, label FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 3, vec_id, CASE WHEN vec_id % 10 = 0 THEN label + 1 ELSE label END FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 5 = 0 UNION ALL SELECT 4, vec_id, label FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 10 <> 0")
def _(t: Tables):
    # three versions side by side: a first load, an upsert, a delete
    path, kind = scratch(t.spark, "vectors"), dict(t.embeddings.dtypes)["label"]
    store = VectorStore(t.spark, path, t.embeddings.schema)
    store.upsert(t.embeddings.where("vec_id % 2 = 0"))
    store.upsert(t.embeddings.where("vec_id % 5 = 0").withColumn("label", F.when(F.col("vec_id") % 2 == 0, F.col("label") + 1).otherwise(F.col("label")).cast(kind)))
    store.delete(t.embeddings.where("vec_id % 5 = 0"))
    of = lambda n: VectorStore(t.spark, path).table(n).select(F.lit(n).alias("version"), "vec_id", "label")
    return of(2).unionByName(of(3)).unionByName(of(4))


@query("udf06_vector_store", "SELECT vec_id, label FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 2 = 0")
def _(t: Tables):
    store = VectorStore(t.spark, scratch(t.spark, "vectors"), t.embeddings.schema)
    store.upsert(t.embeddings)
    store.delete(t.embeddings.where("vec_id % 5 = 0"))
    return store.fetch(t.embeddings.where("vec_id % 2 = 0")).select("vec_id", "label")


@query("udf06b_store_search", "SELECT query_id, vec_id, score FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) DESC, v.vec_id) AS k FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND v.vec_id % 5 <> 0 AND v.label % 2 = 1) WHERE k <= 5")
def _(t: Tables):
    store = VectorStore(t.spark, scratch(t.spark, "vectors"), t.embeddings.schema)
    store.upsert(t.embeddings)
    store.delete(t.embeddings.where("vec_id % 5 = 0"))
    asked = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return store.search(asked, 5, F.col("label") % 2 == 1)


@query("snk03_incremental_index", "SELECT d.doc_id, sha256(d.content) AS content_hash FROM docs d WHERE NOT EXISTS (SELECT 1 FROM docs i WHERE i.doc_id = d.doc_id AND i.doc_id % 3 <> 0 AND sha256(i.content) = sha256(d.content))")
def _(t: Tables):
    now = t.docs.select("doc_id", F.sha2("content", 256).alias("content_hash"))
    return now.join(now.where("doc_id % 3 <> 0"), ["doc_id", "content_hash"], "left_anti")


@query("snk04_delete_and_rebuild", "SELECT doc_id, kb_id, 0 AS generation FROM docs WHERE kb_id <> 'src3' UNION ALL SELECT doc_id, kb_id, 1 FROM docs WHERE kb_id = 'src3' AND status = 'published'")
def _(t: Tables):
    index = t.docs.select("doc_id", "kb_id", F.lit(0).alias("generation"))
    rebuilt = t.docs.where("kb_id = 'src3' and status = 'published'").select("doc_id", "kb_id", F.lit(1).alias("generation"))
    gone = t.docs.where("kb_id = 'src3'").select("doc_id")
    return index.join(gone, "doc_id", "left_anti").unionByName(rebuilt)


@query("snk05_graph_merge", "SELECT DISTINCT s_suppkey AS src, n_nationkey AS dst, 'IN' AS type FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 5 <> 0")
def _(t: Tables):
    nodes = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id")).unionByName(t.nation.where("n_nationkey % 5 <> 0").select(F.concat(F.lit("n"), "n_nationkey").alias("id")))
    edges = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"), F.lit("IN").alias("type"))
    _, e = R.merge_graph(nodes.unionByName(nodes), edges.unionByName(edges))
    return e.select(F.substring("src", 2, 20).cast("long").alias("src"), F.substring("dst", 2, 20).cast("int").alias("dst"), "type")


@query("snk06_behaviour_upsert", "SELECT user_id, doc_id, action_type, CAST(sum(half_weight) AS BIGINT) AS half_weight, max(acted_at) AS acted_at FROM behaviors GROUP BY 1, 2, 3")
def _(t: Tables):
    return R.upsert_sum(t.behaviors, ["user_id", "doc_id", "action_type"], "half_weight", "acted_at")


GAP = "SELECT trim(query) AS topic, count(*) AS search_count, CASE WHEN count(*) >= 10 THEN 'high' WHEN count(*) >= 5 THEN 'medium' ELSE 'low' END AS priority FROM searches WHERE NOT clicked GROUP BY 1"


def gaps(t: Tables):
    n = F.col("search_count")
    g = t.searches.where("not clicked").groupBy(F.trim("query").alias("topic")).agg(F.count("*").alias("search_count"))
    return g.withColumn("priority", F.when(n >= 10, "high").when(n >= 5, "medium").otherwise("low"))


@query("snk07_gap_upsert", GAP)
def _(t: Tables):
    return gaps(t)


@query("snk08_event_append_seq", "WITH log AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + 5 AS seq FROM events WHERE event_id % 3 = 0) SELECT n.user_id, n.event_id, coalesce(last, 0) + row_number() OVER (PARTITION BY n.user_id ORDER BY ts, n.event_id) AS seq FROM events n LEFT JOIN (SELECT user_id, max(seq) AS last FROM log GROUP BY 1) l ON l.user_id = n.user_id WHERE n.event_id % 3 <> 0")
def _(t: Tables):
    # a log that starts at 6; the rest is appended
    log = t.events.where("event_id % 3 = 0").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) + 5).alias("seq"))
    return R.append_events(log, t.events.where("event_id % 3 <> 0"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "seq")


@query("snk09_event_truncate", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 10")
def _(t: Tables):
    return R.latest_by(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id")


@query("snk10_checkpoint_latest", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(t: Tables):
    return t.events.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@query("snk11_conditional_deactivate", "SELECT event_id, user_id, event_type AS fact_key, query AS fact_value, query = last_value(query) OVER (PARTITION BY user_id, event_type ORDER BY created_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS is_active FROM (SELECT *, split_part(query, ':', 1) AS event_type FROM searches)")
def _(t: Tables):
    s = t.searches.withColumn("fact_key", F.substring_index("query", ":", 1))
    last = s.groupBy("user_id", "fact_key").agg(F.max_by("query", F.struct("created_at", "event_id")).alias("last"))
    return s.join(last, ["user_id", "fact_key"]).select("event_id", "user_id", "fact_key", F.col("query").alias("fact_value"), (F.col("query") == F.col("last")).alias("is_active"))


SCD = "SELECT event_id, user_id AS entity_id, event_type AS new_value, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events"


def timeline(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.col("user_id").alias("entity_id"), F.col("event_type").alias("new_value"), F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"))


@query("snk12_scd2_insert", SCD)
def _(t: Tables):
    return timeline(t)


# --- filters


@query("flt01_hierarchy_filter", "SELECT doc_id FROM docs WHERE series_id = 3 AND path LIKE '/src%' AND depth = 3 AND status = 'published'")
def _(t: Tables):
    return R.hierarchy(t.docs, {"series_id": 3, "path_prefix": "/src", "depth": "3", "version_of": None, "doc_status": "published", "bogus": 1}).select("doc_id")


@query("flt02_kb_in_filter", "SELECT doc_id, kb_id FROM docs WHERE kb_id IN ('src1', 'src4')")
def _(t: Tables):
    return R.in_kbs(t.docs, ["src1", "src4"]).select("doc_id", "kb_id")


@query("flt03_published_only", "SELECT doc_id FROM docs WHERE status = 'published'")
def _(t: Tables):
    return R.hierarchy(t.docs, {"doc_status": "published"}).select("doc_id")


@query("flt04_empty_access", "SELECT 'unrestricted' AS access, doc_id FROM docs UNION ALL SELECT 'two', doc_id FROM docs WHERE kb_id IN ('src0', 'src1')")
def _(t: Tables):
    # no restriction gives every row, an empty set none
    sets = {"unrestricted": None, "two": ["src0", "src1"], "empty": []}
    parts = [R.accessible(t.docs, kbs).select(F.lit(name).alias("access"), "doc_id") for name, kbs in sets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("flt05_permission_hits", f"SELECT s.event_id, d.doc_id FROM searches s JOIN docs d ON s.clicked_doc_id = d.doc_id WHERE d.kb_id IN ('src0', 'src1', 'src2', 'src3') AND {LEVEL.format(c='d.classification')} <= 1")
def _(t: Tables):
    docs = R.in_kbs(t.docs, ["src0", "src1", "src2", "src3"]).where(R.level(F.col("classification"), None) <= 1).select("doc_id")
    return t.searches.join(docs, F.col("clicked_doc_id") == F.col("doc_id")).select("event_id", "doc_id")


@query("flt06_permission_docs", f"SELECT doc_id FROM docs WHERE coalesce({LEVEL.format(c='classification')}, 1) <= 2 AND (owner_id = 7 OR kb_id IN ('src2', 'src5'))")
def _(t: Tables):
    return t.docs.where((R.level(F.col("classification"), 1) <= 2) & ((F.col("owner_id") == 7) | F.col("kb_id").isin("src2", "src5"))).select("doc_id")


@query("flt07_validity_window", "SELECT doc_id FROM docs WHERE (effective_from IS NULL OR effective_from <= DATE '2024-01-31') AND (effective_to IS NULL OR effective_to >= DATE '2024-01-31')")
def _(t: Tables):
    return R.valid_at(t.docs, F.lit("2024-01-31").cast("date")).select("doc_id")


@query("flt08_hard_constraints", f"SELECT doc_id FROM docs WHERE kb_id IN ('src0', 'src2', 'src4', 'src6') AND doc_id NOT IN (2, 4, 6) AND {LEVEL.format(c='classification')} <= 2 AND contains(lower(content), 'the') AND contains(lower(content), 'and')")
def _(t: Tables):
    low = F.lower("content")
    return R.in_kbs(t.docs, ["src0", "src2", "src4", "src6"]).where(~F.col("doc_id").isin(2, 4, 6) & (R.level(F.col("classification"), None) <= 2) & low.contains("the") & low.contains("and")).select("doc_id")


@query("flt09_keyword_search", "SELECT doc_id, CASE WHEN contains(lower(title), 'and') THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS score, substr(content, greatest(1, strpos(lower(content), 'and') - 50), 150) AS snippet FROM docs WHERE contains(lower(title), 'and') OR contains(lower(content), 'and') ORDER BY score DESC, doc_id LIMIT 100")
def _(t: Tables):
    at = F.expr("substr(content, greatest(1, locate('and', lower(content)) - 50), 150)")
    title = F.lower("title").contains("and")
    hits = t.docs.where(title | F.lower("content").contains("and"))
    return hits.select("doc_id", F.when(title, 0.9).otherwise(0.6).alias("score"), at.alias("snippet")).orderBy(F.desc("score"), "doc_id").limit(100)


@query("flt10_suggest", "SELECT title, max(CASE WHEN starts_with(lower(title), 'th') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS score FROM docs WHERE contains(lower(title), 'th') GROUP BY title ORDER BY score DESC, title LIMIT 10")
def _(t: Tables):
    low = F.lower("title")
    s = t.docs.where(low.contains("th")).groupBy("title").agg(F.max(F.when(low.startswith("th"), 1.0).otherwise(0.5)).alias("score"))
    return s.orderBy(F.desc("score"), "title").limit(10)


@query("flt11_document_list", f"SELECT doc_id, title FROM docs WHERE status = 'published' AND contains(lower(title), 'e') AND {LEVEL.format(c='classification')} <= 2 AND kb_id IN (SELECT kb_id FROM docs WHERE owner_id IN (5, 6, 7))")
def _(t: Tables):
    mine = t.docs.where("owner_id in (5, 6, 7)").select("kb_id")
    return t.docs.where((F.col("status") == "published") & F.lower("title").contains("e") & (R.level(F.col("classification"), None) <= 2)).join(mine, "kb_id", "left_semi").select("doc_id", "title")


@query("flt12_stale_external", "SELECT doc_id, last_checked FROM docs WHERE ext_source IS NOT NULL AND ext_id IS NOT NULL AND (last_checked IS NULL OR last_checked < DATE '2024-01-28') ORDER BY last_checked ASC NULLS FIRST, doc_id LIMIT 50")
def _(t: Tables):
    d = t.docs.where("ext_source is not null and ext_id is not null and (last_checked is null or last_checked < date '2024-01-28')")
    return d.select("doc_id", "last_checked").orderBy(F.asc_nulls_first("last_checked"), "doc_id").limit(50)


@query("flt13_docs_to_verify", "SELECT doc_id FROM docs WHERE ext_source IS NOT NULL AND category IN ('en', 'de') AND (last_checked IS NULL OR last_checked < DATE '2024-01-24')")
def _(t: Tables):
    return t.docs.where(F.col("ext_source").isNotNull() & F.col("category").isin("en", "de") & F.expr("last_checked is null or last_checked < date '2024-01-24'")).select("doc_id")


@query("flt14_length_gate", "SELECT doc_id, CASE WHEN n < 10 THEN 'too_short' WHEN n > 8000 THEN 'too_long' END AS reason FROM (SELECT doc_id, length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) AS n FROM docs)")
def _(t: Tables):
    from ..functions.text import length_reason

    return t.docs.select("doc_id", length_reason(F.col("content")).alias("reason"))


@query("flt15_classification_gate", f"SELECT conv_id FROM (SELECT m.conv_id, max(coalesce({LEVEL.format(c='d.classification')}, 1)) AS w FROM messages m JOIN docs d ON d.doc_id = m.msg_id % 200 GROUP BY 1) WHERE w <= 2")
def _(t: Tables):
    j = t.messages.join(t.docs, F.col("msg_id") % 200 == F.col("doc_id")).groupBy("conv_id").agg(F.max(R.level(F.col("classification"), 1)).alias("w"))
    return j.where("w <= 2").select("conv_id")


GOLD = "(6 * list_sum(list_transform(string_split(substr(h, 1, 63), ''), lambda x: strpos('0123456789abcdef', x) - 1)) + strpos('0123456789abcdef', substr(h, 64, 1)) - 1) % 10"


@query("flt16_golden_bucket", f"SELECT doc_id, CAST({GOLD} AS INT) AS bucket FROM (SELECT doc_id, sha256(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) AS h FROM docs)")
def _(t: Tables):
    from ..functions.text import golden_bucket

    return t.docs.select("doc_id", golden_bucket(F.col("content")).alias("bucket"))


@query("flt20_sampling")
def _(t: Tables):
    keep = F.col("is_root") | F.col("is_error") | (F.pmod(F.xxhash64("event_id"), F.lit(1000)) < 100)
    return t.spans.where(keep).select("event_id", "is_root", "is_error")


@query("flt21_connector_permission", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def _(t: Tables):
    ids = t.orders.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(ids, "c_custkey", "left_semi").select("c_custkey")


@query("flt22_entity_timeline", f"WITH s AS ({SCD}) SELECT entity_id, event_id, CASE WHEN valid_to < TIMESTAMP '2024-01-15' THEN 'expired' WHEN valid_to <= TIMESTAMP '2024-01-22' THEN 'expiring' ELSE 'open' END AS state FROM s")
def _(t: Tables):
    v = F.col("valid_to")
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return timeline(t).select("entity_id", "event_id", F.when(v < at("2024-01-15 00:00:00"), "expired").when(v <= at("2024-01-22 00:00:00"), "expiring").otherwise("open").alias("state"))


@query("flt23_relevant_assets", "SELECT p_partkey, p_size FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') ORDER BY p_size DESC NULLS LAST, p_partkey LIMIT 20")
def _(t: Tables):
    return t.part.where(F.col("p_brand").isin("Brand#1", "Brand#2")).select("p_partkey", "p_size").orderBy(F.desc_nulls_last("p_size"), "p_partkey").limit(20)


@query("flt24_filtered_paged_list", "SELECT id, model FROM usage WHERE model = '5-LOW' AND success ORDER BY created_at DESC, id LIMIT 30")
def _(t: Tables):
    return R.page(t.usage.where("model = '5-LOW' and success"), [F.desc("created_at"), F.asc("id")], 1, 30).select("id", "model")


@query("flt25_repository_lookups", "SELECT q.id, count(a.id) AS n_answers FROM questions q LEFT JOIN answers a ON a.question_id = q.id AND a.deleted_at IS NULL WHERE q.deleted_at IS NULL GROUP BY q.id")
def _(t: Tables):
    q = R.scan(t.questions).select("id")
    a = R.scan(t.answers).select(F.col("question_id").alias("id"), F.lit(1).alias("one"))
    return q.join(a, "id", "left").groupBy("id").agg(F.count("one").alias("n_answers"))


@query("flt26_open_search", "SELECT doc_id, (SELECT count(*) FROM docs WHERE title ILIKE '%on%' OR content ILIKE '%on%') AS total FROM docs WHERE title ILIKE '%on%' OR content ILIKE '%on%' ORDER BY doc_id LIMIT 10")
def _(t: Tables):
    hits = t.docs.where(F.col("title").ilike("%on%") | F.col("content").ilike("%on%"))
    return R.page(hits, [F.asc("doc_id")], 1, 10).select("doc_id").crossJoin(F.broadcast(hits.agg(F.count("*").alias("total"))))


@query("flt27_unread_notifications", "SELECT user_id, count(*) AS unread FROM events WHERE event_type = 'view' AND value < 50 GROUP BY user_id")
def _(t: Tables):
    return t.events.where("event_type = 'view' and value < 50").groupBy("user_id").agg(F.count("*").alias("unread"))


# --- projections


@query("prj01_weighted_score", "SELECT id, (cost_cents * 4 + input_tokens * 3 + output_tokens * 3) AS score10 FROM usage")
def _(t: Tables):
    return t.usage.select("id", (F.col("cost_cents") * 4 + F.col("input_tokens") * 3 + F.col("output_tokens") * 3).alias("score10"))


@query("prj02_guarded_ratio", "SELECT model, CASE WHEN count(*) FILTER (WHERE success) = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE NOT success) * 1.0 / count(*) FILTER (WHERE success), 6) END AS fail_ratio FROM usage GROUP BY model")
def _(t: Tables):
    return t.usage.groupBy("model").agg(F.round(R.ratio(F.count_if(~F.col("success")).cast("double"), F.count_if("success")), 6).alias("fail_ratio"))


PRICES = [("1-", 300, 1500), ("2-", 250, 1000), ("3-", 100, 500), ("4-", 15, 60)]  # cents for a million tokens in and out, by name prefix


@query("prj03_cost_estimate", "SELECT id, CASE WHEN starts_with(model, '1-') THEN (input_tokens * 300 + output_tokens * 1500) // 1000000 WHEN starts_with(model, '2-') THEN (input_tokens * 250 + output_tokens * 1000) // 1000000 WHEN starts_with(model, '3-') THEN (input_tokens * 100 + output_tokens * 500) // 1000000 WHEN starts_with(model, '4-') THEN (input_tokens * 15 + output_tokens * 60) // 1000000 ELSE 0 END AS cents FROM usage")
def _(t: Tables):
    from ..functions.maths import cost_cents

    return t.usage.select("id", cost_cents(F.col("model"), F.col("input_tokens"), F.col("output_tokens"), PRICES).alias("cents"))


@query("prj04_scale_adapters", "SELECT event_id, round(least(value / 5, 1.0), 6) AS as_ragas, round(least(value / 100, 1.0) * 5, 6) AS as_judge, round(0.7 * least(value / 100, 1.0) + 0.3 * least(value / 200, 1.0), 6) AS completeness FROM events")
def _(t: Tables):
    v = F.col("value")
    one = F.lit(1.0)
    return t.events.select("event_id", F.round(F.least(v / 5, one), 6).alias("as_ragas"), F.round(F.least(v / 100, one) * 5, 6).alias("as_judge"), F.round(0.7 * F.least(v / 100, one) + 0.3 * F.least(v / 200, one), 6).alias("completeness"))


@query("prj05_unified_metric", "SELECT id, coalesce(CASE WHEN success THEN duration_ms END, input_tokens) AS metric, CASE WHEN success AND duration_ms IS NOT NULL THEN 'primary' ELSE 'fallback' END AS origin FROM usage")
def _(t: Tables):
    own = F.when(F.col("success"), F.col("duration_ms"))
    return t.usage.select("id", F.coalesce(own, "input_tokens").alias("metric"), F.when(own.isNotNull(), "primary").otherwise("fallback").alias("origin"))


# --- joins


@query("jn01_answer_question", "SELECT a.id AS answer_id, q.id AS question_id FROM answers a JOIN questions q ON a.question_id = q.id WHERE a.is_accepted AND a.deleted_at IS NULL AND q.deleted_at IS NULL AND a.created_at >= TIMESTAMP '1996-01-01' ORDER BY a.created_at DESC, a.id LIMIT 500")
def _(t: Tables):
    a = R.scan(t.answers).where("is_accepted and created_at >= '1996-01-01'").select(F.col("id").alias("answer_id"), "question_id", F.col("created_at").alias("at"))
    q = R.scan(t.questions).select(F.col("id").alias("question_id"))
    return a.join(q, "question_id").orderBy(F.desc("at"), "answer_id").limit(500).select("answer_id", "question_id")


@query("jn02_document_kb", "SELECT d.doc_id, k.kb_name FROM docs d JOIN (SELECT kb_id, 'KB ' || kb_id AS kb_name FROM docs GROUP BY kb_id) k ON d.kb_id = k.kb_id")
def _(t: Tables):
    kb = t.docs.select("kb_id").distinct().withColumn("kb_name", F.concat(F.lit("KB "), "kb_id"))
    return t.docs.join(kb, "kb_id").select("doc_id", "kb_name")


@query("jn03_kb_document_group", "SELECT n.n_name, count(*) AS n, count(*) FILTER (WHERE s_acctbal < 0) AS bad, CAST(round(100.0 * (count(*) - count(*) FILTER (WHERE s_acctbal < 0)) / count(*)) AS INT) AS health FROM nation n JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def _(t: Tables):
    n, bad = F.count("*"), F.count_if(F.col("s_acctbal") < 0)
    return t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(n.alias("n"), bad.alias("bad"), F.round(100.0 * (n - bad) / n).cast("int").alias("health"))


@query("jn18_chunk_parent", "SELECT c.doc_id, p.title AS parent_title FROM docs c LEFT JOIN docs p ON p.doc_id = c.parent_id")
def _(t: Tables):
    p = t.docs.select(F.col("doc_id").alias("parent_id"), F.col("title").alias("parent_title"))
    return t.docs.select("doc_id", "parent_id").join(p, "parent_id", "left").select("doc_id", "parent_title")


@query("jn25_fuzzy_cell_match", "SELECT l_orderkey, len(list_filter(a, lambda x: len(list_filter(b, lambda y: x = y OR 1 - levenshtein(x, y) / greatest(length(x), length(y)) > 0.9)) > 0)) AS matched FROM (SELECT l_orderkey, list(CAST(l_partkey AS VARCHAR)) AS a, list(CAST(l_partkey - l_linenumber % 2 AS VARCHAR)) AS b FROM lineitem GROUP BY 1)")
def _(t: Tables):
    g = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("a"), F.collect_list((F.col("l_partkey") - F.col("l_linenumber") % 2).cast("string")).alias("b"))
    like = lambda x, y: (x == y) | (1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)) > 0.9)
    return g.select("l_orderkey", F.size(F.filter("a", lambda x: F.exists("b", lambda y: like(x, y)))).alias("matched"))


@query("jn04_query_left_result", "SELECT b.item_id, coalesce(n, 0) AS n_results FROM benchmark b LEFT JOIN (SELECT clicked_doc_id, count(*) AS n FROM searches WHERE clicked GROUP BY 1) r ON b.item_id = r.clicked_doc_id")
def _(t: Tables):
    r = t.searches.where("clicked").groupBy(F.col("clicked_doc_id").alias("item_id")).agg(F.count("*").alias("n"))
    return t.benchmark.join(r, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_results"))


@query("jn05_live_parents_children", "SELECT count(*) AS n FROM answers a JOIN questions q ON a.question_id = q.id WHERE q.deleted_at IS NULL")
def _(t: Tables):
    return t.answers.join(R.scan(t.questions).select(F.col("id").alias("question_id")), "question_id", "left_semi").agg(F.count("*").alias("n"))


@query("jn06_semi_join", "SELECT doc_id FROM docs WHERE kb_id IN (SELECT kb_id FROM docs WHERE owner_id = 3)")
def _(t: Tables):
    return t.docs.join(t.docs.where("owner_id = 3").select("kb_id"), "kb_id", "left_semi").select("doc_id")


@query("jn07_anti_join", "SELECT doc_id FROM docs WHERE doc_id NOT IN (SELECT clicked_doc_id FROM searches WHERE clicked) AND content <> '' ORDER BY doc_id LIMIT 200")
def _(t: Tables):
    seen = t.searches.where("clicked").select(F.col("clicked_doc_id").alias("doc_id"))
    return t.docs.where("content <> ''").join(seen, "doc_id", "left_anti").select("doc_id").orderBy("doc_id").limit(200)


@query("jn08_lookup_join", "SELECT f.id, m.conv_id, d.title FROM feedback f LEFT JOIN messages m ON m.msg_id = f.message_id LEFT JOIN docs d ON d.doc_id = f.doc_id")
def _(t: Tables):
    m = t.messages.select(F.col("msg_id").alias("message_id"), "conv_id")
    return t.feedback.join(m, "message_id", "left").join(t.docs.select("doc_id", "title"), "doc_id", "left").select("id", "conv_id", "title")


@query("jn09_asof_question", "SELECT a.msg_id, q.content AS question FROM messages a ASOF JOIN (SELECT * FROM messages WHERE role = 'user') q ON a.conv_id = q.conv_id AND a.turn >= q.turn WHERE a.role = 'assistant' AND a.rating IS NOT NULL")
def _(t: Tables):
    m = R.asof_backward(t.messages, "conv_id", "turn", F.when(F.col("role") == "user", F.col("content")), "question")
    return m.where("role = 'assistant' and rating is not null and question is not null").select("msg_id", "question")


@query("jn10_turn_grouping", "SELECT conv_id, turn_no, count(*) FILTER (WHERE role = 'assistant') AS n_assistant FROM (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_no FROM messages) WHERE turn_no > 0 GROUP BY 1, 2")
def _(t: Tables):
    return R.turns(t.messages).groupBy("conv_id", "turn_no").agg(F.count_if(F.col("role") == "assistant").alias("n_assistant"))


@query("jn15_feedback_documents", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM feedback WHERE doc_id IS NOT NULL UNION ALL SELECT unnest([message_id, message_id + 40]) FROM feedback) GROUP BY doc_id")
def _(t: Tables):
    f = t.feedback
    direct = f.where("doc_id is not null").select("doc_id")
    via = f.select(F.explode(F.array("message_id", F.col("message_id") + 40)).alias("doc_id"))
    return direct.unionByName(via).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("jn14_full_outer_of_three", "SELECT user_id, CAST(sum(docs_n) AS BIGINT) AS docs_n, CAST(sum(answers_n) AS BIGINT) AS answers_n, CAST(sum(events_n) AS BIGINT) AS events_n FROM (SELECT owner_id AS user_id, count(*) AS docs_n, 0 AS answers_n, 0 AS events_n FROM docs GROUP BY 1 UNION ALL SELECT author_id, 0, count(*), 0 FROM answers GROUP BY 1 UNION ALL SELECT user_id, 0, 0, count(*) FROM events GROUP BY 1) GROUP BY user_id")
def _(t: Tables):
    n = F.count("*").alias("n")
    return R.outer_sum({"docs_n": t.docs.groupBy(F.col("owner_id").alias("user_id")).agg(n), "answers_n": t.answers.groupBy(F.col("author_id").alias("user_id")).agg(n), "events_n": t.events.groupBy("user_id").agg(n)}, "user_id")


@query("jn19_comments_activity", "SELECT e.event_id, d.doc_id FROM behaviors e JOIN docs d ON d.doc_id = e.doc_id WHERE d.deleted_at IS NULL ORDER BY e.acted_at DESC, e.event_id LIMIT 40")
def _(t: Tables):
    d = R.scan(t.docs).select("doc_id")
    return t.behaviors.join(d, "doc_id").orderBy(F.desc("acted_at"), "event_id").limit(40).select("event_id", "doc_id")


@query("jn20_interval_join", "SELECT e.event_id, r.l_linenumber AS window_no FROM (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS at FROM events) e JOIN (SELECT l_linenumber, 0 + min(l_partkey) AS lo, min(l_partkey) + 1500 AS hi FROM lineitem GROUP BY 1) r ON e.at BETWEEN r.lo AND r.hi")
def _(t: Tables):
    from ..operators.ranges import interval_join

    w = t.lineitem.groupBy(F.col("l_linenumber").alias("window_no")).agg(F.min("l_partkey").alias("lo"), (F.min("l_partkey") + 1500).alias("hi"))
    e = t.events.select("event_id", F.floor(F.col("value") * 100).cast("long").alias("at"))
    return interval_join(e, w, "at", "lo", "hi", 512).select("event_id", "window_no")


@query("jn21_tool_set_check", "SELECT user_id, len(list_intersect(used, ['click', 'view'])) = 2 AS has_all, len(list_intersect(used, ['error'])) > 0 AS has_forbidden FROM (SELECT user_id, list(DISTINCT event_type) AS used FROM events WHERE value >= 60 GROUP BY 1)")
def _(t: Tables):
    used = t.events.where("value >= 60").groupBy("user_id").agg(F.collect_set("event_type").alias("used"))
    want, bad = F.array(F.lit("click"), F.lit("view")), F.array(F.lit("error"))
    return used.select("user_id", (F.size(F.array_except(want, "used")) == 0).alias("has_all"), (F.size(F.array_intersect(bad, "used")) > 0).alias("has_forbidden"))


@query("jn22_baseline_vs_current", "SELECT coalesce(a.doc_id, b.doc_id) AS case_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'missing' WHEN b.n < a.n THEN 'drop' ELSE 'ok' END AS verdict FROM (SELECT doc_id, count(*) AS n FROM behaviors WHERE action_type = 'purchase' GROUP BY 1) a FULL JOIN (SELECT doc_id, count(*) AS n FROM behaviors WHERE action_type = 'signup' GROUP BY 1) b ON a.doc_id = b.doc_id")
def _(t: Tables):
    a = t.behaviors.where("action_type = 'purchase'").groupBy("doc_id").agg(F.count("*").alias("was"))
    b = t.behaviors.where("action_type = 'signup'").groupBy("doc_id").agg(F.count("*").alias("now"))
    return a.join(b, "doc_id", "full").select(F.col("doc_id").alias("case_id"), F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("now") < F.col("was"), "drop").otherwise("ok").alias("verdict"))


@query("jn24_conflict_candidates", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def _(t: Tables):
    a = t.part.select("p_type", "p_brand", "p_size", F.col("p_partkey").alias("a"))
    b = t.part.select("p_type", "p_brand", "p_size", F.col("p_partkey").alias("b"))
    return a.join(b, ["p_type", "p_brand", "p_size"]).where("a < b").select("a", "b")


@query("jn26_active_sessions", "SELECT c.conv_id, max(e.event_id) AS last_event FROM (SELECT DISTINCT conv_id FROM messages WHERE owner_id = 2) c JOIN events e ON CAST(c.conv_id AS VARCHAR) = CAST(e.user_id AS VARCHAR) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t: Tables):
    c = t.messages.where("owner_id = 2").select(F.col("conv_id").cast("string").alias("session_id"), "conv_id").distinct()
    e = t.events.select(F.col("user_id").cast("string").alias("session_id"), "event_id")
    return c.join(e, "session_id").groupBy("conv_id").agg(F.max("event_id").alias("last_event")).orderBy(F.desc("last_event"), "conv_id").limit(10)


@query("jn27_personal_digest", "SELECT user_id, doc_id FROM (SELECT b.user_id, d.doc_id, row_number() OVER (PARTITION BY b.user_id ORDER BY d.view_count DESC, d.doc_id) AS rn FROM (SELECT DISTINCT x.user_id, substr(k.title, 1, 2) AS pre FROM behaviors x JOIN docs k ON k.doc_id = x.doc_id) b JOIN docs d ON substr(d.title, 1, 2) = b.pre WHERE NOT EXISTS (SELECT 1 FROM behaviors s WHERE s.user_id = b.user_id AND s.doc_id = d.doc_id)) WHERE rn <= 5")
def _(t: Tables):
    d = t.docs.select("doc_id", F.substring("title", 1, 2).alias("pre"), "view_count")
    seen = t.behaviors.select("user_id", "doc_id").distinct()
    likes = seen.join(d.select("doc_id", "pre"), "doc_id").select("user_id", "pre").distinct()
    return R.top_of_groups(likes, d, seen, "user_id", "pre", "doc_id", [F.desc("view_count"), F.asc("doc_id")], 5)


@query("jn28_change_audience", "SELECT DISTINCT b.doc_id, b.user_id FROM behaviors b JOIN docs d ON d.doc_id = b.doc_id WHERE b.action_type = 'purchase' AND b.user_id <> d.owner_id")
def _(t: Tables):
    d = t.docs.select("doc_id", "owner_id")
    return t.behaviors.where("action_type = 'purchase'").join(d, "doc_id").where("user_id <> owner_id").select("doc_id", "user_id").distinct()


@query("jn29_org_upsert", "SELECT n.n_nationkey AS dept_id, n.n_name AS name, r.r_name AS parent FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")
def _(t: Tables):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("dept_id"), F.col("n_name").alias("name"), F.col("r_name").alias("parent"))


# --- windows


@query("wf01_last_n_messages", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM messages) WHERE rn <= 3")
def _(t: Tables):
    return R.latest_by(t.messages, ["conv_id"], [F.desc("turn")], 3).select("conv_id", "turn", "role")


@query("wf02_rank_in_path", "SELECT kb_id, doc_id, row_number() OVER (PARTITION BY kb_id ORDER BY view_count DESC, doc_id) - 1 AS rank FROM docs")
def _(t: Tables):
    return t.docs.select("kb_id", "doc_id", (F.row_number().over(Window.partitionBy("kb_id").orderBy(F.desc("view_count"), "doc_id")) - 1).cast("long").alias("rank"))


@query("wf03_recent_docs_per_user", "SELECT user_id, doc_id FROM (SELECT user_id, doc_id, row_number() OVER (PARTITION BY user_id ORDER BY max(acted_at) DESC, doc_id) AS rn FROM behaviors GROUP BY user_id, doc_id) WHERE rn <= 20")
def _(t: Tables):
    one = t.behaviors.groupBy("user_id", "doc_id").agg(F.max("acted_at").alias("at"))
    return R.latest_by(one, ["user_id"], [F.desc("at"), F.asc("doc_id")], 20).select("user_id", "doc_id")


@query("wf04_minmax_normalise", "SELECT event_id, round(CASE WHEN max(value) OVER w = min(value) OVER w THEN 1.0 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END, 6) AS norm FROM events WINDOW w AS (PARTITION BY user_id, event_type)")
def _(t: Tables):
    from ..functions.maths import minmax

    return t.events.select("event_id", F.round(minmax("value", ["user_id", "event_type"]), 6).alias("norm"))


@query("wf05_close_open_validity", f"SELECT entity_id, count(*) AS versions, count(*) FILTER (WHERE valid_to IS NULL) AS open FROM ({SCD}) GROUP BY entity_id")
def _(t: Tables):
    return timeline(t).groupBy("entity_id").agg(F.count("*").alias("versions"), F.count_if(F.col("valid_to").isNull()).alias("open"))


@query("wf11_low_confidence_streak", "SELECT event_id, count(*) FILTER (WHERE value < 40) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS streak FROM (SELECT *, sum(CASE WHEN value >= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)")
def _(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.withColumn("island", F.sum((F.col("value") >= 40).cast("int")).over(w))
    run = Window.partitionBy("user_id", "island").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.select("event_id", F.count_if(F.col("value") < 40).over(run).alias("streak"))


@query("wf12_cumulative_offsets", "SELECT conv_id, turn, CAST(coalesce(sum(length(content) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_pos FROM messages")
def _(t: Tables):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return t.messages.select("conv_id", "turn", F.coalesce(F.sum(F.length("content") + 1).over(w), F.lit(0)).alias("start_pos"))


# --- top-k


@query("top01_stable_sort_slice", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def _(t: Tables):
    return t.events.select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(20)


@query("top02_case_ranking", "SELECT id, priority FROM feedback ORDER BY CASE priority WHEN 'high' THEN 3 WHEN 'normal' THEN 2 ELSE 1 END DESC, id LIMIT 50")
def _(t: Tables):
    rank = F.when(F.col("priority") == "high", 3).when(F.col("priority") == "normal", 2).otherwise(1)
    return t.feedback.select("id", "priority").orderBy(rank.desc(), "id").limit(50)


@query("top03_nulls_first", "SELECT doc_id, version_of FROM docs ORDER BY version_of ASC NULLS FIRST, doc_id LIMIT 30")
def _(t: Tables):
    return t.docs.select("doc_id", "version_of").orderBy(F.asc_nulls_first("version_of"), "doc_id").limit(30)


@query("top04_topk_per_group", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 5")
def _(t: Tables):
    return R.latest_by(t.events, ["user_id"], [F.desc("value"), F.asc("event_id")], 5).select("user_id", "event_id")


@query("top05_overfetch_filter", "SELECT event_id FROM (SELECT * FROM events ORDER BY value DESC, event_id LIMIT 60) WHERE event_type <> 'error' ORDER BY value DESC, event_id LIMIT 20")
def _(t: Tables):
    order = [F.desc("value"), F.asc("event_id")]
    return t.events.orderBy(*order).limit(60).where("event_type <> 'error'").orderBy(*order).limit(20).select("event_id")


@query("top08_deterministic_negative", "SELECT d.doc_id, min(n.doc_id) AS negative FROM docs d JOIN (SELECT doc_id, kb_id FROM docs WHERE depth = 1) n ON n.kb_id = d.kb_id AND n.doc_id <> d.doc_id GROUP BY d.doc_id")
def _(t: Tables):
    # the two smallest candidates of a knowledge base: the document itself is never its own negative
    neg = R.latest_by(t.docs.where("depth = 1").select("kb_id", F.col("doc_id").alias("n")), ["kb_id"], [F.asc("n")], 2)
    return t.docs.join(neg, "kb_id").where("n <> doc_id").groupBy("doc_id").agg(F.min("n").alias("negative"))


@query("top09_limit_after_filters", "SELECT doc_id FROM docs WHERE length(content) BETWEEN 10 AND 8000 AND status = 'published' ORDER BY doc_id LIMIT 100")
def _(t: Tables):
    return t.docs.where("length(content) between 10 and 8000 and status = 'published'").select("doc_id").orderBy("doc_id").limit(100)


# --- sets


@query("set01_concat_sources", "SELECT id, 'answer' AS kind FROM answers UNION ALL SELECT id, 'question' FROM questions")
def _(t: Tables):
    a = t.answers.select("id", F.lit("answer").alias("kind"))
    return a.unionByName(t.questions.select("id", F.lit("question").alias("kind")))


@query("set02_key_union", "SELECT DISTINCT user_id FROM (SELECT owner_id AS user_id FROM docs UNION ALL SELECT user_id FROM events)")
def _(t: Tables):
    return t.docs.select(F.col("owner_id").alias("user_id")).union(t.events.select("user_id")).distinct()


@query("set03_array_sets", "SELECT a.user_id, len(list_intersect(a.x, b.x)) AS both_n, len(list_distinct(list_concat(a.x, b.x))) AS any_n, len(list_filter(a.x, lambda v: NOT list_contains(b.x, v))) AS only_a FROM (SELECT user_id, list(DISTINCT doc_id) AS x FROM behaviors WHERE action_type = 'view' GROUP BY 1) a JOIN (SELECT user_id, list(DISTINCT doc_id) AS x FROM behaviors WHERE action_type = 'click' GROUP BY 1) b ON a.user_id = b.user_id")
def _(t: Tables):
    of = lambda k, n: t.behaviors.where(F.col("action_type") == k).groupBy("user_id").agg(F.collect_set("doc_id").alias(n))
    return of("view", "a").join(of("click", "b"), "user_id").select("user_id", F.size(F.array_intersect("a", "b")).alias("both_n"), F.size(F.array_union("a", "b")).alias("any_n"), F.size(F.array_except("a", "b")).alias("only_a"))


@query("set04_exact_dedup_first", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) ORDER BY doc_id) AS rn FROM docs) WHERE rn = 1")
def _(t: Tables):
    from ..functions.text import strip

    return t.docs.groupBy(F.sha2(strip(F.col("content")), 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("set05_duplicate_lookup", "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(content)) AS first_doc FROM docs")
def _(t: Tables):
    d = t.docs.select("doc_id", F.sha2("content", 256).alias("h"))
    return d.join(d.groupBy("h").agg(F.min("doc_id").alias("first_doc")), "h").select("doc_id", "first_doc")


@query("set06_ordered_distinct", "SELECT user_id, string_agg(event_type, ',' ORDER BY first_at) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY 1, 2) GROUP BY user_id")
def _(t: Tables):
    one = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    return one.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "event_type"))), lambda s: s["event_type"]), ",").alias("kinds"))


@query("set08_tagged_union", "SELECT 'customer' AS origin, c_custkey AS id FROM customer WHERE c_nationkey = 1 UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_nationkey = 1")
def _(t: Tables):
    c = t.customer.where("c_nationkey = 1").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"))
    return c.unionByName(t.supplier.where("s_nationkey = 1").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("id")))


@query("set09_grouped_split", "SELECT kb_id, before < 0.2 * total AS in_test FROM (SELECT kb_id, coalesce(sum(n) OVER (ORDER BY md5(kb_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM (SELECT kb_id, count(*) AS n FROM docs GROUP BY kb_id))")
def _(t: Tables):
    from ..operators.ranges import grouped_split

    return grouped_split(t.docs, "kb_id", 0.2)
