"""Helpers shared by the training-data operators: scratch tables in the shared folder, size-checked broadcasts, connected components."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, drop, file_system, scratch, ship

#: Rows in an Arrow batch that goes to Python; whole documents are in it, so it is kept small.  One value for all operators.
BATCH_ROWS, BATCH_DEFAULT = 1000, 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that separates words in the contracts of these operators.
WORD = r"[^\x20\x09-\x0D]+"


def python_ready(spark: SparkSession) -> None:
    """Before an operator uses Python workers: they can import this package, and Arrow batches hold BATCH_ROWS rows unless the session was given another number than Spark's default."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == BATCH_DEFAULT:
        spark.conf.set(key, str(BATCH_ROWS))


try:
    import zstandard as _zstd
except ImportError:  # slower, the same results
    _zstd = None


def squeeze(b: bytes) -> bytes:
    """Light compression for what is shuffled."""
    return _zstd.ZstdCompressor(level=1).compress(b) if _zstd else zlib.compress(b, 1)


def expand(b: bytes) -> bytes:
    return _zstd.ZstdDecompressor().decompress(b) if _zstd else zlib.decompress(b)


def pack(a: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes."""
    return squeeze(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def unpack(b: bytes, kind: str) -> np.ndarray:
    raw, size = np.frombuffer(expand(b), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


_cache: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps between the tasks of one owner; whatever another owner kept is let go, so a reused worker holds one operator's tables at a time."""
    if owner not in _cache:
        _cache.clear()
        _cache[owner] = {}
    return _cache[owner]


def bounded(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else the planner chooses a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the fast path, where lower() means the same."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _united(pdf: pd.DataFrame) -> pd.DataFrame:
    """(node, root) of the edges (u, v)."""
    names, code = np.unique(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]), return_inverse=True)
    up = list(range(len(names)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for x, y in zip(code[: len(pdf)].tolist(), code[len(pdf) :].tolist()):
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    return pd.DataFrame({"node": names, "root": names[[root(i) for i in range(len(names))]]})


def components(edges: DataFrame, a: str = "a", b: str = "b", small: int = 0) -> DataFrame:
    """Connected components of an edge list by alternating large-star and small-star rounds.

    edges: two columns of one orderable type.  Returns (node, root): every node of an edge and the
    smallest node it reaches.  Each round is an aggregate and a join, so a hub node is combined
    before the shuffle and AQE can split what is left; each round is cut to the shared folder.  A graph of
    at most `small` edges, counted first, is one task's work instead.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    if small and e.count() <= small:
        kind = dict(e.dtypes)["u"]
        return e.groupBy(F.col("u").isNull()).applyInPandas(_united, f"node {kind}, root {kind}")

    def stars(e: DataFrame, large: bool) -> DataFrame:
        if large:
            s = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            m = s.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            j = s.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            m = e.groupBy("u").agg(F.min("v").alias("m"))
            j = e.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
        return j.where("u > v").distinct()

    def shape(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    was = shape(e)
    while was[0]:
        half = cut(stars(e, True), "edges")
        nxt = cut(stars(half, False), "edges")
        now = shape(nxt)
        drop(e, half)
        e = nxt
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
