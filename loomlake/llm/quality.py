"""Quality classifier: supervised subword embeddings.

Words, their character n-grams and all pairs of neighbouring words hash into one table of learned vectors;
a document is the average of the vectors of all of these, and a softmax layer on it gives the score.  A
pair's bucket is the difference of its words' hashes, so pairs of one word with itself share a vector.
Trained by plain stochastic gradient descent in numpy on a bounded sample of labelled rows (TRAIN_ROWS
rows and TRAIN_BYTES of whole texts, in hash order).  After training, a document's logit is an average of
one number per feature, so scoring keeps a sum, a count and a hash for each word it has met.

Null or empty texts have no features and score the learned bias alone.  Very long texts are scored whole,
in memory in proportion to the longest.  Without any labelled row the score is 0.5 and the pipeline's
filter keeps every document.  Null ids are in the training fold but never labelled.  Repeated rows score
alike, ties of a score are no ties of anything else; further columns of the input, whatever their names,
do not matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, python_ready, worker_cache
from .labelled import fold, sample, texts

DIM, BUCKETS, NGRAMS = 16, 1 << 18, (3, 4)
EPOCHS, RATE = 8, 0.6
TRAIN_ROWS, TRAIN_BYTES = 3000, 16 << 20
FOLDS, HELD, CUT = 4, 2, 0.7
#: Words whose numbers a worker keeps; when full it starts afresh.
CACHE_WORDS = 250_000


def features(word: str) -> list[int]:
    """Buckets of a word and of the n-grams of <word>."""
    b = f"<{word}>".encode()
    out = [crc32(b)]
    for n in range(NGRAMS[0], NGRAMS[1] + 1):
        out += [crc32(b[i : i + n], n) for i in range(len(b) - n + 1)]
    return [x % BUCKETS for x in out]


def pair_buckets(h: np.ndarray) -> np.ndarray:
    """Buckets of the pairs of neighbours of a sequence of word hashes."""
    return ((h[1:] - h[:-1]) % BUCKETS).astype(np.int32)


def bag(text: str, known: dict[str, tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, share of the document's features that each has)."""
    words = text.split()
    if len(known) > 50_000:
        known.clear()
    for word in words:
        if word not in known:
            known[word] = np.array(features(word), np.int32), crc32(word.encode())
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    pairs = pair_buckets(np.array([known[w][1] for w in words], np.int64))
    u, n = np.unique(np.concatenate([*(known[w][0] for w in words), pairs]), return_counts=True)
    return u, (n / n.sum()).astype(np.float32)


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """(one number per bucket, bias) of the trained softmax: logit of label 1 over label 0."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    known: dict[str, tuple[np.ndarray, int]] = {}
    bags = [(*bag(text, known), y) for text, y in rows]
    del known
    steps, t = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            u, n, y = bags[k]
            lr = rate * (1 - t / steps)
            t += 1
            x = n @ e[u]
            z = x @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            if len(u):
                e[u] -= lr * np.outer(n * np.float32(len(u) ** 0.5), w @ p)
            w -= lr * np.outer(x, p)
            b -= lr * 0.1 * p
    return e @ (w[:, 1] - w[:, 0]), float(b[1] - b[0])


class Scorer:
    """Logits of texts; a word's numbers (sum over its features, their count, its hash) are worked out once and kept."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias, self.place = table, bias, {}
        self.sum, self.count, self.hash = np.zeros(CACHE_WORDS), np.zeros(CACHE_WORDS, np.int32), np.zeros(CACHE_WORDS, np.int64)

    def _learn(self, words: set[str]) -> None:
        """Room for the words of one text at least."""
        if len(self.place) + len(words) > len(self.sum):
            self.place.clear()
            if len(words) > len(self.sum):
                self.sum, self.count, self.hash = (np.zeros(len(words), x.dtype) for x in (self.sum, self.count, self.hash))
        for word in words:
            if word not in self.place:
                f, i = features(word), len(self.place)
                self.place[word] = i
                self.sum[i], self.count[i], self.hash[i] = self.table[f].sum(dtype=np.float64), len(f), crc32(word.encode())

    def logit(self, text: str | None) -> float:
        words = text.split() if text else []
        if not words:
            return self.bias
        try:
            at = np.fromiter(map(self.place.__getitem__, words), np.int32, len(words))
        except KeyError:
            self._learn(set(words))
            at = np.fromiter(map(self.place.__getitem__, words), np.int32, len(words))
        total = self.sum[at].sum() + self.table[pair_buckets(self.hash[at])].sum(dtype=np.float64)
        return self.bias + total / (int(self.count[at].sum()) + len(words) - 1)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, int]:
    rows = texts(docs, sample(labels, "quality", FOLDS, HELD, TRAIN_ROWS), TRAIN_BYTES)
    table, bias = train(rows)
    return table.astype(np.float32), bias, len(rows)


def scores(docs: DataFrame, model: tuple[np.ndarray, float, int]):
    """The probability of label 1 as a function of a text column."""
    spark = docs.sparkSession
    python_ready(spark)
    table, bias, key = spark.sparkContext.broadcast(model[0]), model[1], uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept = worker_cache(key)
        if "scorer" not in kept:
            kept["scorer"] = Scorer(table.value, bias)
        logit = kept["scorer"].logit
        for s in it:
            yield pd.Series(1 / (1 + np.exp(-np.clip([logit(t) for t in s], -60, 60))))

    return score


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    score = scores(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    s = docs.select("doc_id", score("text").alias("__score"))
    return s.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= CUT).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, with the columns they came with."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model[2]:
        return docs
    names = [f"__k{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    flat = docs.toDF(*names)
    return flat.where(scores(docs, model)(names[docs.columns.index("text")]) >= CUT).toDF(*docs.columns)
