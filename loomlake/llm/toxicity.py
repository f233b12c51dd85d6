"""Toxicity: a counterfactual-regularised classifier.

Logistic regression over the words present in a document, each hashed into a table of BUCKETS weights; no
word is left out of the table.  Fitted in numpy on a bounded sample of labelled rows (TRAIN_ROWS rows and
TRAIN_BYTES of whole texts, in hash order).  A weight starts from the log odds of its words between the
labels and is drawn back to it, shrunk towards 0 where the labels' rates differ no more than by chance.
Beside the log loss, training penalises every change of score when an identity term in a labelled sentence
is swapped for another of its group or for a neutral word, so that a term that merely co-occurs with abuse
earns no weight of its own and neutral mentions are left alone.  Identity terms start from 0 and have
weights of their own, whatever words share their bucket.

Null and empty texts score the bias alone; without labels, or on an empty table of documents, nothing is
fitted and the score is 0.5 less a hair, label 0.  Very long texts are scored whole.  Repeated rows score
alike and count once in the fit; null ids are never labelled; further columns of the input, whatever their
names, do not matter.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, python_ready, worker_cache
from .labelled import fold, sample, texts

FOLDS, HELD, CUT = 5, 0, 0.5
#: Bounds of the fit: labelled rows, bytes of whole texts, weights.
TRAIN_ROWS, TRAIN_BYTES, BUCKETS = 20_000, 24 << 20, 1 << 20
#: Standard errors between the labels' rates from which the log odds of a bucket count in full (as the fourth power of the share below).
SURE_Z = 6.0
STEPS, RATE, L2, SWAP_PENALTY = 300, 0.05, 3e-3, 10.0
#: Words whose weights a worker keeps; when full it starts afresh.
CACHE_WORDS = 250_000

#: Identity terms by group; the last word of a group is neutral and no feature.
GROUPS = [
    "muslim muslims christian christians jew jews jewish hindu hindus buddhist buddhists catholic catholics atheist atheists believer",
    "black white asian african european american latino hispanic arab indian chinese mexican german french spanish foreign immigrant immigrants refugee refugees person",
    "gay lesbian straight bisexual queer transgender trans homosexual heterosexual human",
    "woman women man men girl girls boy boys female male people",
    "disabled deaf blind autistic old young elderly someone",
    "muslime christen juden frauen männer ausländer flüchtlinge schwule lesben behinderte menschen",
    "musulmans chrétiens juifs femmes hommes étrangers réfugiés noirs blancs arabes gens",
    "musulmanes cristianos judíos mujeres hombres extranjeros refugiados negros blancos gitanos gente",
]
_groups = [g.split() for g in GROUPS]
SWAPS = {t: [o for o in g if o != t] for g in _groups for t in g[:-1]}
#: Identity terms have the places after the buckets.
PLACE = {t: BUCKETS + i for i, t in enumerate(SWAPS)}
N = BUCKETS + len(PLACE)
_PUNCT = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"})
_SENTENCE = re.compile(r"[.!?\n]+")


def words(text: str) -> set[str]:
    return set(text.lower().translate(_PUNCT).split())


def place(word: str) -> int:
    """Where a word's weight is."""
    i = PLACE.get(word)
    return crc32(word.encode()) % BUCKETS if i is None else i


def features(text: str) -> list[int]:
    return sorted({place(w) for w in words(text)})


def log_odds(col: np.ndarray, y: np.ndarray, n_pos: int, n_neg: int, n: int = N) -> np.ndarray:
    """For each place the log odds of a document that has it, shrunk where they may be chance.  col, y: places present and the label of their document."""
    pos, neg = np.bincount(col, y, n), np.bincount(col, 1 - y, n)
    if not (n_pos and n_neg):
        return np.zeros(n)
    odds = np.log((pos + 0.5) / (n_pos + 1) * (n_neg + 1) / (neg + 0.5))
    rate = (pos + neg + 1) / (n_pos + n_neg + 2)
    z = np.abs(pos / n_pos - neg / n_neg) / np.sqrt(rate * (1 - rate) * (1 / n_pos + 1 / n_neg) + 1e-12)
    return np.where(pos + neg > 0, odds * np.minimum(z / SURE_Z, 1) ** 4, 0.0)


def fit_weights(docs: list[tuple[list[int], int]], n: int, swaps: list[tuple[int, int, float]], steps: int = STEPS, penalty: float = SWAP_PENALTY, expect: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias.  docs: (places present, label).  swaps: (place, its substitute or n, how often): the score changes by the difference of their weights.

    expect: weights to start from and to be drawn to (0 if none), so that a word that mostly comes along
    with others keeps enough weight to count alone.
    """
    row = np.repeat(np.arange(len(docs), dtype=np.int32), [len(f) for f, _ in docs])
    met = [np.asarray(f, np.int32) for f, _ in docs] + [np.array([n, *(x for a, b, _ in swaps for x in (a, b))], np.int32)]
    used, col = np.unique(np.concatenate(met), return_inverse=True)  # steps cost by the places met, not by the table
    a, b = (np.searchsorted(used, np.array([s[k] for s in swaps], np.int64)) for k in (0, 1))
    col, m0, last = col[: len(row)].astype(np.int32), len(used), int(np.searchsorted(used, n))
    y = np.array([l for _, l in docs], float)
    c = np.array([s[2] for s in swaps], float)
    c = c / c.sum() if len(c) else c
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.4999
    base = (np.zeros(n + 1) if expect is None else np.append(expect, 0.0))[used]
    w, bias = base.copy(), np.log(prior / (1 - prior))  # the weight at n stands for neutral words and stays 0
    m, v = np.zeros(m0 + 1), np.zeros(m0 + 1)
    for t in range(1, steps + 1 if len(y) else 1):
        p = 1 / (1 + np.exp(-(bias + np.bincount(row, w[col], len(y)))))
        g = np.bincount(col, (p - y)[row], m0) / len(y) + L2 * (w - base)
        if len(c):
            d = 2 * penalty * c * (w[a] - w[b])
            g += np.bincount(a, d, m0) - np.bincount(b, d, m0)
        g[last] = 0
        g = np.append(g, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    out = np.zeros(n + 1)
    out[used] = w
    return out[:n], float(bias)


def swap_counts(text: str) -> dict[tuple[int, int], int]:
    """How often a labelled sentence of the text changes from one place to another when its identity terms are swapped (N: to a neutral word)."""
    out: dict[tuple[int, int], int] = {}
    low = text.lower()
    for sentence in _SENTENCE.split(low):
        for term in sentence.translate(_PUNCT).split():
            for other in SWAPS.get(term, ()):
                k = (PLACE[term], PLACE.get(other, N))
                out[k] = out.get(k, 0) + 1
    return out


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """(weights by place, bias)."""
    rows = texts(docs, sample(labels, "toxic", FOLDS, HELD, TRAIN_ROWS), TRAIN_BYTES)
    bags, swaps = [], {}
    for text, label in rows:
        bags.append((np.array(features(text), np.int32), label))
        for k, n in swap_counts(text).items():
            swaps[k] = swaps.get(k, 0) + n
    del rows
    n_pos = sum(y for _, y in bags)
    col = np.concatenate([*(f for f, _ in bags), np.zeros(0, np.int32)])
    expect = log_odds(col, np.repeat([float(y) for _, y in bags], [len(f) for f, _ in bags]), n_pos, len(bags) - n_pos)
    expect[BUCKETS:] = 0.0
    w, bias = fit_weights(bags, N, [(a, b, float(k)) for (a, b), k in sorted(swaps.items())], expect=expect)
    return w.astype(np.float32), bias


def scores(docs: DataFrame, model: tuple[np.ndarray, float]):
    """The probability of label 1 as a function of a text column."""
    spark = docs.sparkSession
    python_ready(spark)
    weights, bias, key = spark.sparkContext.broadcast(model[0]), model[1], uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = worker_cache(key).setdefault("places", {})
        table = weights.value

        def logit(text: str | None) -> float:
            if len(of) > CACHE_WORDS:
                of.clear()
            at = []
            for w in words(text) if text else ():
                if (i := of.get(w)) is None:
                    i = of[w] = place(w)
                at.append(i)
            return bias + float(table[np.unique(np.array(at, np.int64))].sum(dtype=np.float64))

        for s in it:
            yield pd.Series(1 / (1 + np.exp(-np.clip([logit(t) for t in s], -60, 60))))

    return score


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    score = scores(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    s = docs.select("doc_id", score("text").alias("__score"))
    return s.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= CUT).cast("int").alias("predicted"))
