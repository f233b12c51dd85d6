"""Whitening against numpy's own solver and exact integers, the rotations alone, odd rows."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlake.llm import whitening


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 24), st.integers(0, 1 << 30))
def test_rotations(d, seed):
    m = np.random.default_rng(seed).standard_normal((d + 3, d))
    a = m.T @ m
    e, v = whitening.jacobi(a)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], rtol=1e-10) and np.allclose(v.T @ v, np.eye(d), atol=1e-12) and np.allclose(a @ v, v * e, atol=1e-10 * e[0])


def test_small_eigenvalues_are_accurate():
    rng = np.random.default_rng(1)
    scale = 10.0 ** -np.arange(0, 16, 2)
    q = np.linalg.qr(rng.standard_normal((8, 8)))[0] * 0.1 + np.eye(8)
    b = q @ q.T
    a = b * scale[:, None] * scale  # graded: small eigenvalues are well determined
    e, _ = whitening.jacobi(a)
    from decimal import Decimal, getcontext

    getcontext().prec = 80
    m = [[Decimal(float(x)) for x in row] for row in a]
    det = Decimal(1)
    for i in range(8):  # elimination in 80 digits
        det *= m[i][i]
        for j in range(i + 1, 8):
            f = m[j][i] / m[i][i]
            m[j] = [x - f * y for x, y in zip(m[j], m[i])]
    prod = math.prod(map(float, e / scale**2)) * float(np.prod(scale**2))
    assert abs(prod / float(det) - 1) < 1e-10 and (e > 0).all()


def check(rows, vectors):
    """rows of the query against numpy over the usable vectors [(id, vector)]."""
    x = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v in vectors}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    e, v = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(len(s), len(s)))
    e, v = e[::-1], v[:, ::-1]
    sign = {}
    for r in rows:
        k = r.component - 1
        y = n * x[r.vec_id] - s
        want = (x[r.vec_id] - s / n) @ v[:, k] / math.sqrt(e[k])
        if abs(want) > 1e-9:
            assert sign.setdefault(k, np.sign(r.whitened * want)) * want == pytest.approx(r.whitened, abs=1e-8)
        assert (r.n, r.deviation) == (n, int((y * y).sum())) and r.explained == pytest.approx(e[k] / e.sum(), rel=1e-9) and r.identity_error < 1e-9


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, id int, d int").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    df = whitening.op13_whitening(spark, str(tmp_path))
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return df.collect()


def test_query(spark, sf):
    rows = whitening.op13_whitening(spark, sf).collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert len(rows) == 4 * len(vectors)
    check(rows, vectors)


def test_odd_rows_and_a_tree_of_sums(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(2)
    good = [(i, [float(c) for c in rng.standard_normal(6).astype(np.float32)]) for i in range(60)]
    good += [(i + 100, good[i][1]) for i in range(40)]  # copies weigh as one
    bad = [(200, None), (201, [1.0, None] * 3), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, [])]
    rows = run(spark, tmp_path, [(i, v, "x", 1, 2) for i, v in good + bad])
    assert sorted((r.vec_id, r.component) for r in rows) == sorted((i, k) for i, _ in good for k in (1, 2, 3, 4))
    check(rows, good)


def test_few_dimensions_equal_vectors_lengths_and_none(spark, tmp_path):
    two = [(i, [float(i % 5), float(i % 3)]) for i in range(15)]
    rows = run(spark, tmp_path / "two", [(i, v, "x", 1, 2) for i, v in two])
    assert len(rows) == 30
    check(rows, two)
    assert run(spark, tmp_path / "equal", [(1, [1.0, 2.0], "x", 1, 2), (2, [1.0, 2.0], "x", 1, 2)]) == []  # no variance
    line = run(spark, tmp_path / "line", [(None if i == 3 else i, [float(i), 2.0 * i, 5.0], "x", 1, 2) for i in range(4)])
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in line) == [(False, 0, 1), (False, 1, 1), (False, 2, 1), (True, 0, 1)]
    mixed = run(spark, tmp_path / "mixed", [(i, v, "x", 1, 2) for i, v in two] + [(100 + i, [float(i)], "x", 1, 2) for i in range(4)])
    assert {(r.vec_id >= 100, r.n) for r in mixed} == {(False, 15), (True, 4)}
    assert run(spark, tmp_path / "none", []) == []
    huge = run(spark, tmp_path / "huge", [(i, [3e38 * (i % 2), float(i)], "x", 1, 2) for i in range(4)])
    assert {r.vec_id for r in huge} == {0, 1, 2, 3} and all(r.deviation is None for r in huge)
