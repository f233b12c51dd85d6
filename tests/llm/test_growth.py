"""Trees that grow in rounds: many more large leaves than a round's sample has room for, and balls that do not split."""

import numpy as np
import pytest

from loomlake.llm import embed_dedup, simhash


def test_random_projection_trees_end_with_many_leaves(spark, monkeypatch):
    for k, v in (("TASK", 16), ("SAMPLE", 64)):
        monkeypatch.setattr(embed_dedup, k, v)
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.standard_normal((1500, 8)), np.ones((1, 8)) + 1e-6 * rng.standard_normal((200, 8))])
    kinds = spark.createDataFrame([(x.tolist(),) for x in v], "__v array<double>").repartition(3)
    forests, dense = embed_dedup.plant(kinds, 0.9, 2)
    u = embed_dedup.unit(v)
    leaves = 0
    for t, nodes in enumerate(forests[8]):
        at, leaf = embed_dedup.route(u, nodes)
        assert set(at.tolist()) == set(range(len(v)))  # every vector is in some leaf
        names, n = np.unique(leaf, return_counts=True)
        stuck = {x & (1 << embed_dedup._TREE) - 1 for d, x in dense if x >> embed_dedup._TREE == t}
        assert all(k <= 16 or x in stuck for x, k in zip(names.tolist(), n.tolist()))
        leaves += len(names)
    assert leaves > 2 * 64 / 8 and dense


def test_vantage_trees_end_with_many_shards(spark, monkeypatch):
    for k, v in (("SHARD", 40), ("MOST", 60), ("SAMPLE", 128), ("SHARDS", 4)):
        monkeypatch.setattr(simhash, k, v)
    rng = np.random.default_rng(2)
    ball = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    f = np.unique(np.concatenate([rng.integers(0, 2**63, 2500, dtype=np.uint64), ball]))
    nodes = simhash.plant(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "__fp long").repartition(3))
    i, leaf = simhash.route(f, nodes)
    assert set(i.tolist()) == set(range(len(f))) and len(set(leaf.tolist())) > 16
    shards = {x: set(i[leaf == x].tolist()) for x in set(leaf.tolist())}
    a, b = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= simhash.RADIUS)
    of = {}
    for x, own in shards.items():
        for k in own:
            of.setdefault(k, set()).add(x)
    assert all(of[p] & of[q] for p, q in zip(a.tolist(), b.tolist()))  # every pair meets


@pytest.mark.parametrize("module", [embed_dedup, simhash])
def test_grafting_keeps_other_leaves(module):
    leaf = (lambda a, b: [0, 0, a, b]) if module is simhash else (lambda a, b: [0, 0, 0, a, b])
    base = [leaf(1, -1), leaf(-2, -3)]
    out = module.graft(base, {1: [leaf(-1, -2)], 2: [leaf(1, -3), leaf(-1, -2)]})
    ends = sorted(-1 - c for n in out for c in list(n)[-2:] if c < 0)
    assert len(out) == 5 and len(set(ends)) == len(ends) == 6 and 0 in ends
    assert module.graft([], {0: base}) == base
