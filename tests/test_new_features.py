"""Dictionary matching, isolated channels, quality retry, timed stream state, converters by shape, revisions of a source."""

import random

import pytest
from pyspark.sql import functions as F

from loomlake.operators import dictionary as D
from loomlake.operators import folds as G
from loomlake.operators import retrieval as V
from loomlake.sources import adapter, shapes
from loomlake.streaming import state, windows

WORDS = "abcdefghijklmnopqrstuvwxyz0123456789"


def plain_hits(text, terms):
    out = []
    for t in terms:
        for i in range(len(text) - len(t) + 1):
            if text[i : i + len(t)] == t and not (t[0] in WORDS and i and text[i - 1] in WORDS) and not (t[-1] in WORDS and i + len(t) < len(text) and text[i + len(t)] in WORDS):
                out.append((i, i + len(t), t))
    return sorted(out)


@pytest.mark.parametrize("most", [500_000, 3])
def test_dictionary_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(D, "MOST", most)
    rng = random.Random(3)
    pool = ["ab", "a", "b c", " ", "报", "报销", "销", "流程", "-", "A", "bc"]
    terms = ["a", "ab", "ab a", "b c", "报销", "报销流程", "流程", "销流", "a-b", "bc", ""]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(60)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    syn = spark.createDataFrame([(t.upper(), f"E{i % 3}") for i, t in enumerate(terms)] + [(None, "x")], "term string, entity string")
    known = [t for t in terms if t]
    every = {r.id: [tuple(h) for h in r.hits] for r in D.term_matches(df, syn).collect()}
    first = {r.id: [tuple(h) for h in r.hits] for r in D.term_matches(df, syn, overlaps=False).collect()}
    for i, t in enumerate(texts):
        want = plain_hits((t or "").lower(), known)
        assert sorted(every[i]) == want
        at, longest = 0, []
        while at < len(t or ""):
            here = [h for h in want if h[0] == at]
            if here:
                longest.append(max(here, key=lambda h: h[1]))
                at = longest[-1][1]
            else:
                at += 1
        assert first[i] == longest
    named = {(r.id, r.entity) for r in D.entities_of(df, syn, "id").collect()}
    assert named == {(i, f"E{terms.index(h[2]) % 3}") for i, hs in every.items() for h in hs}
    assert D.expanded(df.where("id >= 60"), syn, "id").where("id = 61").first().text is None


def test_a_channel_that_fails_counts_as_empty(spark, caplog):
    schema = "query_id long, chunk_id string, score double"
    good = lambda: spark.range(2).selectExpr("id AS query_id", "'c' AS chunk_id", "1.0D AS score")
    assert V.isolated(good, schema, spark).count() == 2
    for bad in (lambda: spark.read.parquet("/no/such/path"), lambda: good().select("nothing"), lambda: good().withColumn("score", F.raise_error(F.lit("down")).cast("double"))):
        with caplog.at_level("WARNING", "loomlake"):
            assert V.isolated(bad, schema, spark, "graph").count() == 0
        assert "graph failed" in caplog.text
        caplog.clear()


def test_only_poor_queries_are_searched_again(spark):
    scores = {1: [0.9, 0.8, 0.7], 2: [0.4, 0.2, 0.6], 3: [0.1], 4: []}
    rows = spark.createDataFrame([(q, f"c{i}", s) for q, ss in scores.items() for i, s in enumerate(ss)], "query_id long, chunk_id string, score double")
    asked = []

    def search(queries, k):
        asked.append((sorted(r.query_id for r in queries.collect()), k))
        return rows.join(queries, "query_id", "left_semi").where(F.regexp_extract("chunk_id", r"(\d+)", 1).cast("int") < k)

    hits, verdicts = V.quality_retry(search, spark.createDataFrame([(q,) for q in scores], "query_id long"), 2, 1, 0.35)
    assert asked == [([1, 2, 3, 4], 2), ([2, 3], 3)]
    assert sorted((r.query_id, r.chunk_id) for r in hits.collect()) == [(1, "c0"), (1, "c1"), (2, "c0"), (2, "c1"), (2, "c2"), (3, "c0")]
    assert sorted(tuple(r) for r in verdicts.collect() if r.query_id < 4) == [(1, 0.85, False, False), (2, 0.4, True, False), (3, 0.1, True, True)]
    assert [tuple(r) for r in verdicts.where("query_id = 4").collect()] == [(4, None, False, True)]


def run_lives(spark, tmp_path, batches, rolling):
    """Each batch a file; what every batch emits, in order."""
    src, out = f"{tmp_path}/in", []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "user string, at long").selectExpr("user", "timestamp_seconds(at) AS ts").coalesce(1).write.mode("append").parquet(f"{src}/{i}")
        s = spark.readStream.schema("user string, ts timestamp").parquet(f"{src}/*")
        q = state.lives(s, "user", 100, delay="10 seconds", rolling=rolling).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
        q = q.foreachBatch(lambda df, _: out.extend((r.key, r.n, int(r.start.timestamp()), int(r.until.timestamp()), r.expired) for r in df.collect())).start()
        q.awaitTermination()
    return out


def test_lives_end_by_timers(spark, tmp_path):
    # a's life ends when the watermark passes, though nothing more comes for a
    got = run_lives(spark, tmp_path / "fixed", [[("a", 1000), ("a", 1050), ("b", 1000)], [("b", 1090)], [("c", 1500)], [("c", 1501)]], False)
    assert ("a", 2, 1000, 1100, False) in got and ("b", 2, 1000, 1100, False) in got
    assert sorted(g for g in got if g[4]) == [("a", 2, 1000, 1100, True), ("b", 2, 1000, 1100, True)]
    got = run_lives(spark, tmp_path / "rolling", [[("a", 1000), ("b", 1000)], [("b", 1090)], [("c", 1120)], [("c", 1121)]], True)
    assert ("b", 2, 1000, 1190, False) in got and [g for g in got if g[4]] == [("a", 1, 1000, 1100, True)]


def test_running_lives_stream_through_hot_keys(spark):
    times = {u: sorted(random.Random(u).randrange(2000) for _ in range(300 if u == 0 else 5)) for u in range(4)}
    df = spark.createDataFrame([(u, t, i) for u, ts in times.items() for i, t in enumerate(ts)], "user int, at long, i int")
    got = {(r.user, r.i): r.n for r in state.running_lives(df, "user", ["at", "i"], "at", 70, ["user", "i"]).collect()}
    assert got == {(u, i): n for u, ts in times.items() for i, n in enumerate(G.ttl_counts(ts, 70))}


def test_session_ends(spark):
    df = spark.createDataFrame([(1, 0), (1, 50), (1, 200)], "user_id int, s long").selectExpr("user_id", "timestamp_seconds(s) AS ts")
    assert sorted((r.n, int(r.until.timestamp())) for r in windows.sessions(df, "100 seconds", until=True).collect()) == [(1, 300), (2, 150)]


def test_shapes(spark):
    rows = [("ranking", '{"query": "q", "positive": "p", "negative": ["", "n"]}'), ("ranking", "no json"), ("reading", '{"question": "q", "answers": []}'), ("reading", '{"question": " q ", "answers": {"text": " a "}}'), ("instruction", '{"instruction": "i", "input": " x ", "output": "o"}'), ("preference", '{"question": "q", "response_chosen": "c", "response_rejected": 3}'), ("other", "{}"), ("reading", None)]
    got = shapes.converted(spark.createDataFrame(rows, "shape string, raw string")).collect()
    assert [(r.kind, r.query or r.question, r.pos or r.answer, r.neg) for r in got] == [("embedding", "q", "p", "n"), ("sft", "q", "a", None), ("sft", "i\n\nx", "o", None)]


def test_a_source_streams_only_changed_revisions(spark, tmp_path):
    path = f"{tmp_path}/docs"
    table = lambda rows: spark.createDataFrame(rows, "id long, title string, body string, rev long").coalesce(1).write.mode("overwrite").parquet(path)
    make = lambda: adapter.TableAdapter(path, "id", "title", "body", "rev")
    got = []

    def run():
        q = adapter.stream(spark, "loomlake_revisions", make, 3).writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).foreachBatch(lambda df, _: got.append(sorted((r.doc_id, r.content, r.revision) for r in df.collect()))).start()
        q.awaitTermination()

    table([(1, "t", "one", 1), (2, "t", "two", 2)])
    run()
    table([(1, "t", "one", 1), (2, "t", "two again", 3), (3, "t", "three", 4)])
    run()
    assert [g for g in got if g] == [[("1", "one", "1"), ("2", "two", "2")], [("2", "two again", "3"), ("3", "three", "4")]]
    assert adapter.read(spark, "loomlake_table", make).count() == 3


def test_fixed_parts_overlap():
    from loomlake.operators import chunking as C

    text = "".join(f"Sentence number {i}. " for i in range(200))
    plain, over = C.fixed(text, 64), C.fixed(text, 64, 20)
    assert len(plain) == len(over) > 2 and over[0].content == plain[0].content
    assert all(b.content == a.content[-20:] + c.content for a, b, c in zip(plain, over[1:], plain[1:]))
    assert over[1].start == over[0].end and over[1].end - over[1].start == len(over[1].content)
    assert [c.content for c in C.fixed("short", 64, 20)] == ["short"]


def test_registration(spark):
    rows = [("A", "x", "Alpha", ["one", "Two"], 1), ("A", "y", "Alef", None, 3), ("B", "z", "Beta", ["ALEF", "one"], 2)]
    got = {r.term: (r.entity, r.type) for r in D.registered(spark.createDataFrame(rows, "canonical string, type string, display string, synonyms array<string>, at long")).collect()}
    assert got == {"a": ("A", "y"), "alef": ("A", "y"), "b": ("B", "z"), "beta": ("B", "z"), "one": ("B", "z")}
