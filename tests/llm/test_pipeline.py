"""The corpus pipeline stage by stage against plain versions, and every stage on odd tables."""

import struct
from collections import Counter
from hashlib import sha256

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from loomlake.llm import bpe, mixing, quality  # noqa: E402
from loomlake.llm.common import cut, documents  # noqa: E402

from .test_operators import TEXTS, lower, plan_by_hand, table  # noqa: E402


def test_stages_and_run(spark, sf):
    from tokenizers import Tokenizer

    docs = [documents(spark, sf)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs.append(cut(stage(spark, docs[-1], sf), name))
        assert docs[-1].columns == docs[0].columns
    rows = [[r.asDict() for r in d.collect()] for d in docs]
    ids = [[r["doc_id"] for r in x] for x in rows]
    # quality: what the classifier accepts
    accepted = {r.doc_id for r in quality.op5_quality(spark, sf).where("predicted = 1").collect()}
    assert set(ids[1]) == accepted and len(ids[1]) == len(accepted)
    # exact dedup: of equal texts the largest id
    best = {}
    for r in rows[1]:
        best[lower(r["text"])] = max(best.get(lower(r["text"]), -1), r["doc_id"])
    assert sorted(ids[2]) == sorted(best.values())
    # SimHash: the smallest id of each class of texts whose sets of 5-word shingles are 0.8 alike, compared pair by pair
    words = {r["doc_id"]: lower(r["text"]).encode().split() for r in rows[2]}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, w in words.items()}
    up = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if up[a] != up[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
                    changed = True
    assert sorted(ids[3]) == sorted(set(up.values()))
    # mixing: copies near the targets, none above three
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in rows[3]}
    src = {r["doc_id"]: r["source"] for r in rows[3]}
    total, taken, copies = Counter(), Counter(), Counter(ids[4])
    for i in size:
        total[src[i]] += size[i]
        taken[src[i]] += size[i] * copies[i]
    want = plan_by_hand(total)
    assert max(copies.values()) <= 3 and set(copies) <= set(size)
    assert all(abs(taken[s] - want[s]) <= max(0.05 * want[s], 30) for s in want)
    # BPE: the library's ids
    tok = Tokenizer.from_file(bpe.tokenizer_path())
    text = {r["doc_id"]: r["text"] for r in rows[4]}
    out = [r.asDict() for r in corpus_pipeline.run(spark, sf).collect()]
    assert Counter(r["doc_id"] for r in out) == copies
    for r in out:
        e = tok.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(e) and r["ids_sha256"] == sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_tables(spark, tmp_path, name, stage):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(TEXTS))] + [(None, 1, None), (3, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, ids=[None, 0, 0, 1, 1, *range(2, len(TEXTS) - 3)])
    out = stage(spark, docs, str(tmp_path))
    n = out.count()
    assert n <= 3 * len(TEXTS)
    if name != "bpe":
        assert out.columns == docs.columns and {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.collect()}
    else:
        assert n == len(TEXTS)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_mixing_keeps_whole_texts(spark):
    docs = table(spark)
    text = {(r.doc_id, r.text) for r in docs.collect()}
    assert {(r.doc_id, r.text) for r in mixing.stage(spark, docs, "").collect()} <= text


def test_near_classes_in_blocks(spark, monkeypatch):
    """Many texts around the same shingles, in families that are alike and families that only share a passage, with groups cut in blocks; against pairwise comparison."""
    import random

    from loomlake.llm import simhash

    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for family in range(6):
        base = passage + [f"f{family}w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts = sorted(set(texts))
    sets = [set(simhash.shingle_set(t).tolist()) for t in texts]
    up = list(range(len(texts)))
    root = lambda i: i if up[i] == i else root(up[i])
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    want = {i: root(i) for i in range(len(texts))}
    assert 1 < len(set(want.values())) < len(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) AS __fp", "text")
    key = {r["__fp"]: r.doc_id for r in rows.collect()}
    for block, rounds, pairs, graph in ((5, 2, 0, 0), (2000, 1, 0, 10**6), (7, 6, 10**9, 3)):
        monkeypatch.setattr(simhash, "GRAPH", graph)
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "ROUNDS", rounds)
        monkeypatch.setattr(simhash, "PAIRS", pairs)
        got = {key[r["__fp"]]: r.component_id for r in simhash.near_classes(rows).collect()}
        assert got == want


def test_sketches_bound_what_is_in_common():
    import numpy as np

    from loomlake.llm import simhash

    rng = np.random.default_rng(6)
    for n, m, c in ((0, 0, 0), (1, 9, 1), (40, 50, 30), (3000, 2500, 2400), (20_000, 17_000, 100)):
        common = rng.integers(0, 2**64, c, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**64, k - c, dtype=np.uint64)])) for k in (n, m))
        most = simhash.in_common_at_most(simhash.sketch(a), simhash.sketch(b))
        assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))


def test_small_graphs_are_united_alike(spark):
    import random

    from loomlake.llm.common import components

    rng = random.Random(3)
    edges = spark.createDataFrame([(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(500, 500)], "a long, b long")
    want = sorted(map(tuple, components(edges).collect()))
    assert sorted(map(tuple, components(edges, small=1000).collect())) == want and want
    assert components(edges.limit(0), small=1000).count() == 0
