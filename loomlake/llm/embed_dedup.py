"""Embedding near-dedup with a forest of random-projection trees.

Equal vectors form one class first, so copies cost one comparison.  Each tree splits by the projection
on a random direction at its median; vectors within a margin of the boundary go to both sides (spill).
The margin is a share of how far the ends of a link at the threshold usually project apart, so a tree
parts few links per level, and TREES trees together miss next to none.

Trees grow in rounds: every leaf that holds over TASK vectors is split further on a sample of its own
vectors (SAMPLE at most), in a task of its own, until none is left that splits, so leaves follow the table and
not a fixed number.  Within a leaf, a task grows TREES trees of its own down to LEAF vectors in memory and
compares all pairs of their leaves in double precision; only a ball too dense to split is compared whole,
block by block if it exceeds a task.  A pair that shares several leaves counts in the first of them, so
link counts are exact for the pairs found.  Leaves emit sums and spanning links, not pairs; classes come
from star contraction.  recall() measures the links found against brute force.

Vectors that are null, zero, or hold null or non-finite components link with nothing.  Only vectors of
one length are compared.  Rows that repeat a vector link with each other, also under one id; a null id
belongs to a class but does not name it.  Empty tables give empty results; other columns do not matter.
"""

from __future__ import annotations

import heapq
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, components, cut, python_ready

THRESHOLD, TREES, MARGIN = 0.9, 3, 0.5
#: Vectors compared with each other, about; vectors a task takes at most; vectors that a leaf's subtree grows on, at most.
LEAF, TASK, SAMPLE = 512, 16_000, 30_000
_TREE = 40  # bits below the number of a tree


def grow(sample: np.ndarray, leaves: int, threshold: float, rng: np.random.Generator) -> list:
    """(direction, boundary, margin, low child, high child) nodes; a child below 0 is leaf -1-child."""
    d = sample.shape[1]
    margin = MARGIN * np.sqrt(2 - 2 * threshold) / np.sqrt(d)
    least, nodes, done, made = max(4, len(sample) // max(1, leaves)), [], 0, 0
    todo = [(-len(sample), 0, sample, -1, 0)]
    while todo:
        _, _, part, parent, side = heapq.heappop(todo)
        split = None
        if len(part) > 1.5 * least and len(nodes) < leaves:
            for _ in range(6):
                w = rng.standard_normal(d)
                w /= np.linalg.norm(w)
                x = part @ w
                m = float(np.median(x))
                low, high = x <= m + margin, x > m - margin
                if max(low.sum(), high.sum()) <= 0.85 * len(part):
                    split = (w, m, low, high)
                    break
        if split is None:
            me = -1 - done
            done += 1
        else:
            me = len(nodes)
            nodes.append([split[0], split[1], margin, 0, 0])
            for at, own in ((3, split[2]), (4, split[3])):
                made += 1
                heapq.heappush(todo, (-int(own.sum()), made, part[own], me, at))
        if parent >= 0:
            nodes[parent][side] = me
    return nodes


def route(v: np.ndarray, nodes: list) -> tuple[np.ndarray, np.ndarray]:
    """(index, leaf) of every vector, spills included."""
    if not nodes:
        return np.arange(len(v)), np.zeros(len(v), np.int64)
    at, leaf, todo = [], [], [(0, np.arange(len(v)))]
    while todo:
        n, idx = todo.pop()
        if not len(idx):
            continue
        if n < 0:
            at.append(idx)
            leaf.append(np.full(len(idx), -1 - n))
            continue
        w, m, margin, low, high = nodes[n]
        x = v[idx] @ w
        todo += [(low, idx[x <= m + margin]), (high, idx[x > m - margin])]
    return np.concatenate(at), np.concatenate(leaf)


def graft(nodes: list, subs: dict[int, list]) -> list:
    """nodes with trees in the place of leaves; the trees' leaves get numbers of their own."""
    if not nodes:
        return subs[0]
    at, first, places = len(nodes), n_leaves(nodes), {}
    for leaf in sorted(subs):
        places[-1 - leaf] = at
        at += len(subs[leaf])
    out = [[w, m, margin, places.get(low, low), places.get(high, high)] for w, m, margin, low, high in nodes]
    for leaf in sorted(subs):
        shift = len(out)
        child = lambda c: c + shift if c >= 0 else c - first  # noqa: B023, E731
        out += [[w, m, margin, child(low), child(high)] for w, m, margin, low, high in subs[leaf]]
        first += n_leaves(subs[leaf])
    return out


def n_leaves(nodes: list) -> int:
    """One more than the highest number of a leaf."""
    return max([-n[side] for n in nodes for side in (3, 4) if n[side] < 0], default=1)


def codes(v: np.ndarray, forest: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """(index, tree and leaf as one number) of every vector in every leaf it is in, by index."""
    got = [route(v, nodes) for nodes in forest]
    at = np.concatenate([i for i, _ in got])
    leaf = np.concatenate([x + (t << _TREE) for t, (_, x) in enumerate(got)])
    order = np.lexsort((leaf, at))
    return at[order], leaf[order]


def unit(rows) -> np.ndarray:
    v = np.array(list(rows), np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def compare(v: np.ndarray, n: np.ndarray, block: np.ndarray, before: list[list], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each vector, class of each) among the vectors of one leaf, or between its two blocks, of pairs that no leaf in both their lists of earlier ones brought together."""
    cols: dict = {}
    member = [[cols.setdefault(c, len(cols)) for c in m] for m in before]
    seen = np.zeros((len(v), len(cols)), np.float32)
    for i, m in enumerate(member):
        seen[i, m] = 1
    links, label = np.zeros(len(v), np.int64), np.arange(len(v))
    cross = len(set(block.tolist())) > 1
    for a in range(0, len(v), 512):
        hit = v[a : a + 512] @ v.T >= threshold
        hit[np.arange(hit.shape[0]), np.arange(a, a + hit.shape[0])] = False
        if cross:
            hit &= block[a : a + 512, None] != block[None, :]
        some = np.flatnonzero(hit.any(1))
        if not len(some):
            continue
        if len(cols):
            hit[some] &= seen[a + some] @ seen.T == 0
        links[a : a + 512] += hit @ n
        for i in some.tolist():
            near = label[hit[i]]
            if (near != label[a + i]).any():
                join = np.unique(np.append(near, label[a + i]))
                label[np.isin(label, join)] = join[0]
    return links, label


def within_leaf(v: np.ndarray, n: np.ndarray, before: list[list], threshold: float, trees: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(links of each vector, spanning links) of one leaf: compared leaf by leaf of a forest of its own if it is large."""
    links, pairs = np.zeros(len(v), np.int64), []
    forest = [[]]
    if len(v) > 1.5 * LEAF:
        rng = np.random.default_rng(len(v))
        forest = [grow(v, len(v) // LEAF, threshold, rng) for _ in range(trees)]
    at, leaf = codes(v, forest)
    own = [[("t", c) for c in m] for m in before]
    earlier: list[list[int]] = [[] for _ in range(len(v))]
    for x in np.unique(leaf).tolist():
        idx = at[leaf == x]
        got, label = compare(v[idx], n[idx], np.zeros(len(idx), np.int64), [own[i] + earlier[i] for i in idx.tolist()], threshold)
        links[idx] += got
        moved = np.flatnonzero(label != np.arange(len(idx)))
        pairs += zip(idx[moved].tolist(), idx[label[moved]].tolist())
        for i in idx.tolist():
            earlier[i].append(x)
    return links, pairs


def plant(kinds: DataFrame, threshold: float, trees: int) -> tuple[dict[int, list[list]], dict[tuple[int, int], int]]:
    """(trees by length of vector, leaves over TASK that do not split with their sizes), grown in rounds.

    Every leaf over TASK is sampled at a rate of its own, and its subtree grows in the task that has the
    sample; what reaches the driver in a round is the leaves over TASK and the nodes made of them.  A leaf either
    splits, which leaves none of its parts whole, or is dense from then on, so the rounds end at any size.
    """
    spark = kinds.sparkSession
    forests: dict[int, list[list]] = defaultdict(lambda: [[] for _ in range(trees)])
    dense: dict[tuple[int, int], int] = {}
    kind, task, most = dict(kinds.dtypes)["__v"], TASK, SAMPLE
    while True:
        now = spark.sparkContext.broadcast(dict(forests))

        def leaves_of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                for d, part in pdf.groupby(pdf["__v"].map(len)):
                    leaf, n = np.unique(codes(unit(part["__v"]), now.value.get(d, [[]] * trees))[1], return_counts=True)
                    yield pd.DataFrame({"d": d, "leaf": leaf, "n": n})

        sizes = kinds.select("__v").mapInPandas(leaves_of, "d int, leaf long, n long").groupBy("d", "leaf").agg(F.sum("n").alias("n")).where(F.col("n") > TASK).collect()
        large = {(r.d, r.leaf): r.n for r in sizes if (r.d, r.leaf) not in dense}
        if not large:
            return dict(forests), dense
        wanted = spark.sparkContext.broadcast({k: (n, max(1, n // min(most, max(2048, 512 * (n // (task // 4)))))) for k, n in large.items()})

        def pick(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                for d, part in pdf.groupby(pdf["__v"].map(len)):
                    at, leaf = codes(unit(part["__v"]), now.value.get(d, [[]] * trees))
                    h = part["h"].to_numpy(np.int64)[at]
                    rate = np.array([wanted.value.get((d, x), (0, 0))[1] for x in leaf.tolist()], np.int64)
                    keep = np.flatnonzero((rate > 0) & ((h + leaf) % np.maximum(rate, 1) == 0))
                    if len(keep):
                        yield part.iloc[at[keep]].assign(d=d, leaf=leaf[keep])[["d", "leaf", "h", "__v"]]

        def subtree(pdf: pd.DataFrame) -> pd.DataFrame:
            d, leaf = int(pdf["d"].iloc[0]), int(pdf["leaf"].iloc[0])
            n, _ = wanted.value[d, leaf]
            sub = grow(unit(pdf.sort_values("h", kind="stable")["__v"]), max(2, n // (task // 4)), threshold, np.random.default_rng([11, d, leaf])) if len(pdf) > 8 else []
            return pd.DataFrame({"d": [d], "leaf": [leaf], "nodes": [pickle.dumps(sub)]})

        sample = kinds.select("__v", F.xxhash64("__v", F.lit(9)).alias("h")).mapInPandas(pick, f"d int, leaf long, h long, __v {kind}")
        grown = {(r.d, r.leaf): pickle.loads(bytes(r.nodes)) for r in sample.groupBy("d", "leaf").applyInPandas(subtree, "d int, leaf long, nodes binary").collect()}
        dense |= {k: n for k, n in large.items() if not grown.get(k)}
        subs: dict[tuple[int, int], dict[int, list]] = defaultdict(dict)
        for (d, leaf), sub in grown.items():
            if sub:
                subs[d, leaf >> _TREE][leaf & (1 << _TREE) - 1] = sub
        for (d, t), own in subs.items():
            forests[d][t] = graft(forests[d][t], own)


def classes(rows: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """One row per distinct usable vector: __v, n (copies), links (of one copy, other copies included), component_id."""
    spark = rows.sparkSession
    python_ready(spark)
    v = F.col(vec_col)
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    kinds = rows.where(usable).groupBy(v.alias("__v")).agg(F.min(id_col).alias("least"), F.count("*").alias("n"))
    kinds = cut(cut(kinds, "vectors").withColumn("c", F.monotonically_increasing_id()), "vectors")
    planted, dense = plant(kinds, threshold, trees)
    forest = spark.sparkContext.broadcast((planted, {k: -(-n // (TASK // 2)) for k, n in dense.items()}))
    raw = "<f4" if dict(kinds.dtypes)["__v"] == "array<float>" else "<f8"

    def deal(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grown, split = forest.value
        for pdf in it:
            for d, part in pdf.groupby(pdf["__v"].map(len)):
                at, leaf = codes(unit(part["__v"]), grown.get(d, [[]]))  # one leaf where no tree was needed
                ends = np.searchsorted(at, np.arange(len(part) + 1))
                mine = [leaf[a:b] for a, b in zip(ends[:-1], ends[1:])]
                part = part[["c", "n"]].assign(v=[np.asarray(v, raw).tobytes() for v in part["__v"]], mine=mine)
                c = part["c"].to_numpy(np.int64)[at]
                g = np.array([split.get((d, x), 1) for x in leaf.tolist()], np.int64)
                block = c * 2654435761 % (1 << 32) % g
                copy = np.repeat(np.arange(len(at)), g)
                other = np.arange(len(copy)) - np.repeat(np.cumsum(g) - g, g)
                own = block[copy]
                yield part.iloc[at[copy]].assign(d=d, leaf=leaf[copy], lo=np.minimum(own, other), hi=np.maximum(own, other), block=own)[["d", "leaf", "lo", "hi", "block", "c", "n", "v", "mine"]]

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        c, n = pdf["c"].to_numpy(), pdf["n"].to_numpy()
        v = np.frombuffer(b"".join(map(bytes, pdf["v"])), raw).reshape(len(pdf), -1).astype(np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        me = int(pdf["leaf"].iloc[0])
        before = [[x for x in m if x < me] for m in pdf["mine"]]
        if (int(pdf["d"].iloc[0]), me) in forest.value[1]:  # a ball that does not split
            links, label = compare(v, n, pdf["block"].to_numpy(), before, threshold)
            spans = [(i, x) for i, x in enumerate(label.tolist()) if i != x]
        else:
            links, spans = within_leaf(v, n, before, threshold, trees)
        out = [(int(c[i]), int(links[i]), None) for i in np.flatnonzero(links)] + [(int(c[i]), 0, int(c[r])) for i, r in spans]
        return pd.DataFrame(out, columns=["c", "links", "to"]).astype({"c": "int64", "links": "int64", "to": "Int64"})

    pairs = kinds.select("__v", "c", "n").mapInPandas(deal, "d int, leaf long, lo int, hi int, block int, c long, n long, v binary, mine array<long>")
    found = cut(pairs.groupBy("d", "leaf", "lo", "hi").applyInPandas(within, "c long, links long, to long"), "found")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    of = cut(components(found.where("to is not null").select(F.col("c").alias("a"), F.col("to").alias("b"))), "classes")
    named = of.join(kinds.select("c", "least"), F.col("node") == F.col("c")).select("c", "root", "least")
    least = cut(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = cut(named.join(bounded(least, 200_000), "root").select("c", "component_id"), "named")
    out = kinds.join(bounded(cut(links, "links"), 200_000), "c", "left").join(bounded(named, 200_000), "c", "left")
    return cut(out.select("__v", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component_id", "least").alias("component_id")), "kinds")


def near_duplicates(rows: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row."""
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("__e"))
    of = classes(rows, "__e", "vec_id", threshold, trees)
    j = rows.join(of, F.col("__e") == F.col("__v"), "left")
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return j.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def recall(rows: DataFrame, found: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", threshold: float = THRESHOLD, every: int = 100) -> float:
    """Share of the links of the vectors whose id is divisible by `every`, counted by brute force against all rows, that found (vec_id, n_links) has."""
    v = F.col(vec_col)
    ids = rows.where(F.col(id_col) % every == 0).select(F.col(id_col).alias("q"), v.alias("x"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
    parts = 64  # queries against all rows in blocks
    ids = ids.where(dot(F.col("x"), F.col("x")) > 0).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    base = rows.select(F.col(id_col).alias("y"), v.alias("z")).where(dot(F.col("z"), F.col("z")) > 0).withColumn("part", F.pmod(F.xxhash64("y"), F.lit(parts)).cast("int"))
    hit = ids.join(base, "part").where((F.col("q") != F.col("y")) & (F.size("x") == F.size("z")))
    hit = hit.where(dot(F.col("x"), F.col("z")) / F.sqrt(dot(F.col("x"), F.col("x")) * dot(F.col("z"), F.col("z"))) >= threshold)
    want = hit.count()
    got = found.where(F.col("vec_id") % every == 0).agg(F.sum("n_links")).first()[0] or 0
    return got / want if want else 1.0


def op9_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP9_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = vec_id) AS n_links, (SELECT min(y) FROM r WHERE r.x = vec_id) AS component_id,
  (SELECT min(y) FROM r WHERE r.x = vec_id) = vec_id AS kept
FROM embeddings
"""
