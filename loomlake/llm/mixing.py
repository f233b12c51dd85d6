"""Mixing sources to target weights by the cube method.

A source with n rows, s words and target t takes every row floor(t/s) times; what is left of t/s is an
inclusion probability for one more copy.  The cube method moves these fractional probabilities through
the null space of the balancing constraints (row totals and word totals), so both totals stay as they
are while rows settle at 0 or 1.  The flight runs block by block (BLOCK rows of one source, dealt by a
hash of the id), leaves at most LANDING rows of a block undecided, and runs again over what is left
until one block holds a source's rest; there the landing tries all 2^LANDING outcomes and takes the one
nearest to the totals.  A hot source is thus many blocks, and no task holds more than a few blocks' rows.
Probabilities within EPS of 0 or 1 are that number from the start, so every round settles rows; a round
that settled none would be the last, each block landing by itself.

Sizes: words in the text (null or empty: 0).  Null sources form a source of their own, the last.  A
row's place in its block depends on its id and size alone, so reruns agree; rows that repeat are drawn
each for itself, and ties of a source's name cannot be.  A very long text counts like any other: only its
word count leaves the scan.  Empty tables give empty results; further columns of the input do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, bounded, cut, documents, python_ready

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 2048
LANDING = 12
#: Distance from 0 and 1 below which a probability is decided.
EPS = 1e-9
#: Sources up to which the plan is broadcast (under 100 bytes each).
BROADCAST_SOURCES = 50_000
STATE = "__src string, __row long, __id long, size long, __p double"


def sized(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", keep: list[str] = ()) -> DataFrame:
    return docs.select(*keep, F.col(id_col).alias("__id"), F.col(source_col).alias("__src"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def source_plan(rows: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: __src, n, source_size, target.

    Sources in code-point order, null last, weigh `weights` in turn and share all words; a target stops
    at cap times its source's size and the excess goes to the others by weight until none is above.
    Each round of that filling moves three numbers to the driver, however many sources there are.
    """
    spark = rows.sparkSession
    per = cut(rows.groupBy("__src").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), "sources")
    ranked = per.orderBy(F.col("__src").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[0][2], float(weights[x[1] % len(weights)])))
    per = cut(spark.createDataFrame(ranked, "__src string, n long, source_size long, weight double"), "sources")
    total = float(per.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    over = F.lit(False)
    while total:
        free = per.where(~over)
        row = free.agg(F.sum("weight").alias("w")).first()
        spent = per.where(over).agg(F.sum("source_size")).first()[0] or 0
        if not row.w:
            break
        nxt = (total - cap * spent) / row.w
        if nxt <= level:
            break
        level = nxt
        over = F.col("weight") * level > cap * F.col("source_size")
    return per.select("__src", "n", "source_size", F.when(over, (cap * F.col("source_size")).cast("double")).otherwise(F.col("weight") * level).alias("target"))


def flight(p: np.ndarray, z: np.ndarray, u: np.ndarray, stop: int) -> np.ndarray:
    """Probabilities after the flight: all but at most `stop` are 0 or 1; sums of p and of p*z are as before.

    With two constraints a window of three undecided rows always has a direction in the null space:
    (z3-z2, z1-z3, z2-z1), or (1, -1, 0) where the sizes agree.  u: one uniform number per row.
    """
    p = p.astype(float).copy()
    p[p <= EPS], p[p >= 1 - EPS] = 0.0, 1.0
    todo = np.flatnonzero((p > 0) & (p < 1)).tolist()
    left, at = len(todo), 0
    window: list[int] = []
    pl, zl = p.tolist(), z.astype(float).tolist()
    while left > stop:
        while len(window) < 3 and at < len(todo):
            window.append(todo[at])
            at += 1
        if len(window) < 3:
            break
        a, b, c = window
        d = (zl[c] - zl[b], zl[a] - zl[c], zl[b] - zl[a])
        if not (d[0] or d[1] or d[2]):
            d = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for k, i in enumerate(window):
            if d[k] > 0:
                up, down = min(up, (1 - pl[i]) / d[k]), min(down, pl[i] / d[k])
            elif d[k] < 0:
                up, down = min(up, pl[i] / -d[k]), min(down, (1 - pl[i]) / -d[k])
        step = up if u[a] * (up + down) < down else -down
        keep = []
        for k, i in enumerate(window):
            x = pl[i] + step * d[k]
            if x <= EPS:
                pl[i], left = 0.0, left - 1
            elif x >= 1 - EPS:
                pl[i], left = 1.0, left - 1
            else:
                pl[i] = x
                keep.append(i)
        window = keep
    return np.array(pl)


def landing(p: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Decides at most a dozen or so rows: the outcome nearest to the word total, then to the row total."""
    p = p.astype(float).copy()
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if len(open_):
        picks = (np.arange(2 ** len(open_))[:, None] >> np.arange(len(open_))) & 1
        words = np.abs(picks @ z[open_].astype(float) - p[open_] @ z[open_])
        rows = np.abs(picks.sum(1) - p[open_].sum())
        p[open_] = picks[np.lexsort((np.arange(len(picks)), rows, words))[0]]
    return np.round(p)


def _uniform(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64)
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(m)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


def _block(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__h", "__id", "size"], kind="stable", na_position="first")
        z = pdf["size"].to_numpy()
        p = flight(pdf["__p"].to_numpy(), z, _uniform(pdf["__h"].to_numpy(np.int64)), LANDING)
        pdf["__p"] = landing(p, z) if last else p
        return pdf[["__src", "__row", "__id", "size", "__p"]]

    return run


def draw(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (__row, __id, __src, size) with source_size, target and copies (how often the mix takes the row)."""
    python_ready(rows.sparkSession)
    plan = bounded(plan, BROADCAST_SOURCES)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    state = rows.join(plan, rows["__src"].eqNullSafe(plan["__src"])).select(rows["__src"], "__row", "__id", "size", (ratio - F.floor(ratio)).alias("__p"))
    sizes, before = plan.agg(F.max("n")).first()[0] or 0, None
    done = []
    while True:
        blocks = 1 if sizes == before else max(1, -(-sizes // BLOCK))
        # each source is cut into as many blocks as the largest needs only where it has the rows for it
        n = state.groupBy("__src").agg(F.count("*").alias("__n"))
        n = bounded(cut(n.withColumnRenamed("__src", "__s"), "blocks"), BROADCAST_SOURCES)
        cutup = state.join(n, F.col("__src").eqNullSafe(F.col("__s"))).withColumn("__h", F.xxhash64("__id", "size", F.lit(blocks)))
        cutup = cutup.withColumn("__b", F.pmod(F.shiftright("__h", 20), F.ceil(F.col("__n") / BLOCK)))
        out = cut(cutup.select("__src", "__row", "__id", "size", "__p", "__h", "__b").groupBy("__src", "__b").applyInPandas(_block(blocks == 1), STATE), "flight")
        if blocks == 1:
            done.append(out)
            break
        done.append(out.where("__p = 0 or __p = 1"))
        state = out.where("__p > 0 and __p < 1")
        sizes, before = state.groupBy("__src").count().agg(F.max("count")).first()[0] or 0, sizes
    chosen = done[0]
    for d in done[1:]:
        chosen = chosen.unionByName(d)
    return chosen.join(plan.withColumnRenamed("__src", "__s"), F.col("__src").eqNullSafe(F.col("__s"))).select("__row", "__id", "__src", "size", "source_size", "target", (F.floor(ratio) + F.col("__p")).cast("long").alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    rows = cut(sized(docs, source_col, text_col, id_col).withColumn("__row", F.monotonically_increasing_id()), "sized")
    return draw(rows, cut(source_plan(rows, weights, cap), "plan"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(documents(spark, sf_dir))
    return m.select(F.col("__id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with the columns of docs.

    Copies are joined to the documents by id, of which earlier stages leave one row each; where an id
    repeats, its rows are told apart by size and source, and rows alike in all three share their draws.
    """
    m = mix(docs).groupBy("__id", "__src", "size").agg(F.sort_array(F.collect_list("copies")).alias("copies"))
    names = [f"__k{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    i, s, t = (names[docs.columns.index(c)] for c in ("doc_id", "source", "text"))
    flat = sized(flat, s, t, i, names)
    m = cut(m.toDF("__mi", "__ms", "__mz", "__mc"), "mix")
    j = flat.join(m, F.col("__id").eqNullSafe(F.col("__mi")) & F.col("__src").eqNullSafe(F.col("__ms")) & (F.col("size") == F.col("__mz")))
    n = F.size("__mc")
    if m.where("size(__mc) > 1").limit(1).count():
        from pyspark.sql import Window

        j = j.withColumn("__r", F.row_number().over(Window.partitionBy("__id", "__src", "size").orderBy(t)))
        times = F.element_at("__mc", F.least(F.col("__r"), n))
    else:
        times = F.element_at("__mc", 1)
    out = j.withColumn("__times", times.cast("int")).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return out.select(*names).toDF(*docs.columns)
