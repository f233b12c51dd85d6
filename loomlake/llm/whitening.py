"""Embedding whitening: a distributed centred scatter, cyclic Jacobi rotations on the driver, a broadcast matrix.

Entries become whole numbers, floor(SCALE * c).  The fit list has every distinct vector once, so copies weigh
as one.  A first pass over it adds up the vectors exactly (n and the sums S); a second one centres every
vector at S / n and adds up its products with itself.  Both emit one matrix a task, and matrices are added in
a tree of FAN a task, so that one matrix of the size of the dimension squared reaches the driver, whatever the
number of rows.  There rotations, applied to all disjoint pairs of a round at a time, go through every pair of
dimensions sweep after sweep until no off-diagonal entry is left that rounding would not explain; each is judged
against its own two diagonal entries, which keeps small eigenvalues accurate.  The whitening matrix (eigenvectors by
falling eigenvalue over their roots) is broadcast, and rows are projected in Arrow batches.

Rows whose vector is null or has null or non-finite entries are dropped.  Vectors of each length are a table of their own,
with their own fit list; empty vectors have no components.  Components without variance are left out: they
have no whitened form, so fewer than `components` rows a vector appear, none where all vectors are equal.
Equal eigenvalues are numbered in the order the rotations leave them in.  Rows that repeat, also under
one id, appear as often as they are there; null ids are ids.  The exact deviation is null where it exceeds a long.  An
empty table gives an empty result; further columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, python_ready

SCALE, COMPONENTS = 256, 4
#: Matrices added in a task; sweeps at most (a handful is usual).
FAN, SWEEPS = 16, 60
_EXACT = 1 << 62


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, falling, by cyclic Jacobi rotations.

    A round of a sweep holds every dimension in one pair at most (as in a tournament), so its rotations do not touch each
    other and are applied at once; a sweep's rounds meet every pair once.
    """
    a = np.array(a, np.float64)
    d = len(a)
    v = np.eye(d)
    ring = np.arange(d + d % 2)
    tiny = np.finfo(np.float64).eps
    for _ in range(SWEEPS):
        rotated = False
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[::-1][: len(ring) // 2]
            p, q = np.minimum(p, q), np.maximum(p, q)
            ring = np.concatenate((ring[:1], ring[-1:], ring[1:-1]))
            real = q < d
            p, q = p[real], q[real]
            off, x, y = a[p, q], a[p, p], a[q, q]
            need = np.abs(off) > tiny * np.sqrt(np.abs(x)) * np.sqrt(np.abs(y))
            if not need.any():
                continue
            rotated = True
            p, q, off, x, y = p[need], q[need], off[need], x[need], y[need]
            theta = (y - x) / (2 * off)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            for m in (a, v):
                left, right = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            up, low = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * up - s[:, None] * low, s[:, None] * up + c[:, None] * low
            a[p, q] = a[q, p] = 0
            a[p, p], a[q, q] = x - t * off, y + t * off
        if not rotated:
            break
    e = np.diag(a).copy()
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order] / np.linalg.norm(v[:, order], axis=0)


def integers(vec: str, scale: int = SCALE):
    """An array column as whole numbers, null where it is null or holds null or non-finite entries."""
    v = F.col(vec)
    usable = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(usable, F.transform(v, lambda c: F.floor(c.cast("double") * scale)))


def _matrix(rows) -> np.ndarray:
    return np.array(list(rows), np.int64)


def _exact_sum(x: np.ndarray) -> list[int]:
    """Column sums of integers, exact at any size."""
    if len(x) and int(np.abs(x).max(initial=0)) <= _EXACT // len(x):
        return x.sum(0).tolist()
    return x.astype(object).sum(0).tolist()


def tree_sum(parts: DataFrame, add: Callable[[list], object], pickled: Callable[[object], bytes], opened: Callable[[bytes], object]) -> dict[int, object]:
    """The sum of the parts (d, k, m) of each d, added FAN at a time; k counts the parts of all d."""
    parts = cut(parts, "parts")

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        m = add([opened(bytes(b)) for b in pdf.sort_values("k")["m"]])
        return pd.DataFrame({"d": pdf["d"].iloc[:1].to_numpy(), "k": pdf["k"].iloc[:1].to_numpy() // FAN, "m": [pickled(m)]})

    while True:
        most = parts.agg(F.max("k")).first()[0]
        if not most:
            break
        was, parts = parts, cut(parts.groupBy("d", F.floor(F.col("k") / FAN)).applyInPandas(group, "d int, k long, m binary"), "parts")
        drop(was)
    return {r.d: opened(bytes(r.m)) for r in parts.collect()}


def _partials(fit: DataFrame, of: Callable[[int, np.ndarray], object], add: Callable[[list], object], pickled: Callable[[object], bytes]) -> DataFrame:
    """One part (d, k, m) a length and task."""
    from pyspark import TaskContext

    def task(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, object] = {}
        for pdf in it:
            for d, own in pdf.groupby(pdf["x"].map(len)):
                got = of(int(d), _matrix(own["x"]))
                sums[d] = add([sums[d], got]) if d in sums else got
        k = TaskContext.get().partitionId()
        if sums:
            yield pd.DataFrame({"d": list(sums), "k": k, "m": [pickled(m) for m in sums.values()]})

    return fit.mapInPandas(task, "d int, k long, m binary")


class Whitening:
    """Fitted on the distinct vectors of a column of arrays.

    fits: by length, n, sums (exact), mean, values and vectors (the kept components), matrix (whitening), trace, identity_error.
    """

    def __init__(self, rows: DataFrame, vec_col: str = "embedding", scale: int = SCALE, components: int = COMPONENTS):
        python_ready(rows.sparkSession)
        self.spark, self.vec, self.scale, self.components = rows.sparkSession, vec_col, scale, components
        x = rows.select(integers(vec_col, scale).alias("x")).where("x is not null and size(x) > 0")
        self.fit_list = cut(x.distinct(), "fit")
        self.fits: dict[int, dict] = {}
        counts = self._counts()
        means = {d: np.array([float(s) / n if abs(s) < 1 << 53 else s / n for s in sums]) for d, (n, sums) in counts.items()}
        scatter = self._scatter({d: (m, np.eye(len(m))) for d, m in means.items()})
        for d, (n, sums) in counts.items():
            cov = scatter[d][1] / n
            cov = (cov + cov.T) / 2
            e, v = jacobi(cov)
            top = (e > 0) & (e > d * np.finfo(np.float64).eps * max(e[0], 0))
            k = min(components, int(top.sum()))
            self.fits[d] = {"n": n, "sums": sums, "mean": means[d], "values": e[:k], "vectors": v[:, :k], "matrix": v[:, :k] / np.sqrt(e[:k]), "trace": float(np.trace(cov))}
        for d, (sums, m) in self._scatter({d: (f["mean"], f["matrix"]) for d, f in self.fits.items() if f["matrix"].size}).items():
            n = self.fits[d]["n"]
            self.fits[d]["identity_error"] = float(np.abs(m / n - np.outer(sums / n, sums / n) - np.eye(len(sums))).max())

    def _counts(self) -> dict[int, tuple[int, list[int]]]:
        import pickle

        def add(parts: list) -> tuple[int, list[int]]:
            return sum(n for n, _ in parts), [sum(c) for c in zip(*[s for _, s in parts])]

        parts = _partials(self.fit_list, lambda d, x: (len(x), _exact_sum(x)), add, pickle.dumps)
        return tree_sum(parts, add, pickle.dumps, pickle.loads)

    def _scatter(self, forms: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length, sums and products of the fit list's vectors, centred at a mean and then multiplied by a matrix."""
        sent = self.spark.sparkContext.broadcast(forms)

        def of(d: int, x: np.ndarray) -> np.ndarray:
            if d not in sent.value:
                return np.zeros((1, 0))
            mean, matrix = sent.value[d]
            y = (x.astype(np.float64) - mean) @ matrix
            return np.vstack((y.sum(0), y.T @ y))

        def opened(b: bytes) -> np.ndarray:
            flat = np.frombuffer(b, np.float64)
            k = int((np.sqrt(4 * len(flat) + 1) - 1) / 2)
            return flat.reshape(k + 1, k)

        add = lambda parts: sum(parts[1:], parts[0])
        got = tree_sum(_partials(self.fit_list, of, add, lambda m: m.tobytes()), add, lambda m: m.tobytes(), opened)
        return {d: (got[d][0], got[d][1:]) for d in forms}

    def transform(self, rows: DataFrame, id_col: str = "vec_id") -> DataFrame:
        """id, d (length), n, deviation, whitened (array of the components), explained, identity_error of each usable row."""
        sent = self.spark.sparkContext.broadcast(self.fits)

        def project(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                for d, own in pdf.groupby(pdf["x"].map(len)):
                    f = sent.value.get(d)
                    if f is None:
                        continue
                    x = _matrix(own["x"])
                    w = (x.astype(np.float64) - f["mean"]) @ f["matrix"]
                    far = max(int(np.abs(x).max(initial=0)) * f["n"], max(map(abs, f["sums"])))
                    if 4 * d * far * far < _EXACT:
                        y = x * f["n"] - np.array(f["sums"], np.int64)
                        dev = (y * y).sum(1).tolist()
                    else:
                        dev = [s if s < 1 << 63 else None for s in ((x.astype(object) * f["n"] - np.array(f["sums"], object)) ** 2).sum(1)]
                    yield pd.DataFrame({"id": own["id"].to_numpy(), "d": d, "deviation": pd.array(dev, "Int64"), "whitened": list(w)})

        kind = dict(rows.dtypes)[id_col]
        x = rows.select(F.col(id_col).cast("string").alias("id"), integers(self.vec, self.scale).alias("x")).where("x is not null and size(x) > 0")
        made = x.mapInPandas(project, "id string, d int, deviation long, whitened array<double>")
        pick = lambda make, kind: F.create_map(*[F.lit(v) for d, f in self.fits.items() for v in (d, make(f))])[F.col("d")].cast(kind) if self.fits else F.lit(None).cast(kind)
        explained = F.create_map(*[v for d, f in self.fits.items() for v in (F.lit(d), F.array(*[F.lit(float(e / f["trace"])) for e in f["values"]]).cast("array<double>"))])[F.col("d")] if self.fits else F.array().cast("array<double>")
        return made.select(F.col("id").cast(kind).alias("id"), "d", pick(lambda f: f["n"], "long").alias("n"), "deviation", "whitened", explained.alias("explained"), pick(lambda f: f.get("identity_error"), "double").alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    each = Whitening(rows).transform(rows).select("*", F.posexplode("whitened").alias("k", "w"))
    return each.select(F.col("id").alias("vec_id"), (F.col("k") + 1).alias("component"), "n", "deviation", F.col("w").alias("whitened"), F.expr("explained[k]").alias("explained"), "identity_error")
