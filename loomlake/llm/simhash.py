"""SimHash near-dedup with vantage-point trees.

Fingerprint: A-Z lowered, words without white space, shingles of SHINGLE words joined by single spaces
(fewer words: the whole sequence; none: fingerprint zero); a bit is 1 if it is set in over half of the
shingles' XXH64 values (seed 42), repeats included.  Fingerprints within RADIUS bits link, and a
document's class is everything reachable.

Search: copies share a fingerprint, so distinct fingerprints are searched.  A vantage-point tree, grown in
rounds on bounded samples of each shard until every shard fits a task, splits them by Hamming distance to a vantage
point; by the triangle inequality a pair within RADIUS is parted only if its inner end lies within RADIUS
of the boundary, so such inner points also visit the outer side.  Every pair thus meets in a shard.  Shards
split further by the same rule in memory, and what does not split is searched exactly: small sets
against each other in blocks, larger ones by probing all values within RADIUS.  A shard emits links
that span its classes, not pairs; classes across shards come from star contraction.

The pipeline's stage (near_stage) links texts by the exact Jaccard similarity of their 5-word shingles, see near_classes.

Null texts are empty.  Null ids belong to a class but name none (a class of nulls alone has a null id).
Repeated rows share class and fingerprint; ties cannot be, a class is named by its smallest id.  Very long
texts are fingerprinted whole, 65,536 shingles at a time.  Empty tables give empty results; further columns
do not matter.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, components, cut, documents, drop, pack, python_ready, unpack

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints a shard should hold, and holds at most; fingerprints that a subtree grows on, about; leaves of a subtree.
SHARD, MOST, SAMPLE, SHARDS = 8192, 500_000, 65_536, 8192
#: Set sizes below which splitting in memory stops, and from which probing beats comparing.
LEAF, PROBE = 1024, 24_000
#: The near-dedup stage: words of a shingle and the least Jaccard similarity, as a fraction.
WORDS, ALIKE = 5, (4, 5)
#: Bytes of texts whose shingles meet in a task to be counted, about; pairs a text that may be left to look at all at once, and rounds before that; texts of a block of a large group; pairs of two classes that are compared before all are; edges of a graph of classes that one task unites.
COUNTED, PAIRS, ROUNDS, BLOCK, CLOSE, GRAPH = 12 << 20, 1, 3, 2000, 4, 1_000_000
_BITS = np.array([1 << (63 - i) for i in range(64)], np.uint64)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes know ASCII case and white space only


def shingles(text: str | None, k: int) -> np.ndarray:
    """The hashes of a text's shingles of k words, repeats included."""
    from xxhash import xxh64_intdigest

    b = words(text)
    if not b:
        return np.zeros(0, np.uint64)
    if len(b) <= k:
        return np.array([xxh64_intdigest(b" ".join(b), SEED)], np.uint64)
    buf = b" ".join(b)
    ends = np.cumsum(np.fromiter(map(len, b), np.int64, len(b)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([xxh64_intdigest(buf[s:e], SEED) for s, e in zip(starts[: len(b) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    return majority(shingles(text, k))


def majority(h: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        counts += np.unpackbits(h[i : i + 65_536].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(_BITS[2 * counts > len(h)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, k: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """docs with __fp, the fingerprint as a signed long."""
    python_ready(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series(np.array([fingerprint(t, k) for t in s], np.uint64).view(np.int64))

    return docs.withColumn("__fp", fp(F.col(text_col)))


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def grow(sample: np.ndarray, shards: int, seed: int = 1) -> list[tuple[int, int, int, int]]:
    """A tree with about so many leaves as (vantage, boundary, inner, outer) nodes; a child below 0 is leaf -1-child.

    Of a few candidate points and boundaries the split is taken that leaves the largest side, visitors
    included, smallest; a node whose largest side would keep over 85% of its points becomes a leaf.
    """
    rng = np.random.default_rng(seed)
    least = max(8, len(sample) // max(1, shards))
    nodes: list[list[int]] = []
    leaves = made = 0
    todo = [(-len(sample), 0, sample, -1, 0)]  # the largest part is split first
    while todo:
        _, _, part, parent, side = heapq.heappop(todo)
        best = None
        if len(part) > 1.5 * least and len(nodes) < shards:
            for v in rng.choice(part, min(6, len(part)), replace=False):
                d = np.bincount(distance(part, v), minlength=65)
                inner = np.cumsum(d)
                for m in range(64):
                    if not 0 < inner[m] < len(part):
                        continue
                    visit = inner[m] - (inner[m - RADIUS] if m >= RADIUS else 0)
                    worst = max(inner[m], len(part) - inner[m] + visit)
                    if best is None or (worst, visit) < best[0]:
                        best = ((worst, visit), int(v), m)
            if best and best[0][0] > 0.85 * len(part):
                best = None
        if best is None:
            me = -1 - leaves
            leaves += 1
        else:
            me = len(nodes)
            nodes.append([best[1], best[2], 0, 0])
            d = distance(part, np.uint64(best[1]))
            for side_, own in ((2, d <= best[2]), (3, d > best[2] - RADIUS)):
                made += 1
                heapq.heappush(todo, (-int(own.sum()), made, part[own], me, side_))
        if parent >= 0:
            nodes[parent][side] = me
    return [tuple(n) for n in nodes]


def route(fps: np.ndarray, nodes: list) -> tuple[np.ndarray, np.ndarray]:
    """(index, leaf) of every point: its own leaf and those it visits."""
    if not nodes:
        return np.arange(len(fps)), np.zeros(len(fps), np.int64)
    at, leaf, todo = [], [], [(0, np.arange(len(fps)))]
    while todo:
        n, idx = todo.pop()
        if not len(idx):
            continue
        if n < 0:
            at.append(idx)
            leaf.append(np.full(len(idx), -1 - n))
            continue
        v, m, inner, outer = nodes[n]
        d = distance(fps[idx], np.uint64(v))
        todo += [(inner, idx[d <= m]), (outer, idx[d > m - RADIUS])]
    return np.concatenate(at), np.concatenate(leaf)


@lru_cache(1)
def _masks() -> np.ndarray:
    one = [1 << i for i in range(64)]
    return np.array(one + [one[i] | one[j] for i in range(64) for j in range(i)], np.uint64)


class _Sets:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def _search(f: np.ndarray, idx: np.ndarray, sets: _Sets, rng: np.random.Generator, deep: int = 0) -> None:
    """Join every pair of f[idx] (distinct values) within RADIUS."""
    part = f[idx]
    if len(idx) > LEAF and deep < 40:
        best = None
        for v in rng.choice(part, 4, replace=False):
            d = distance(part, v)
            c = np.bincount(d, minlength=65)
            inner = np.cumsum(c)
            for m in np.flatnonzero((inner > 0) & (inner < len(part)))[:64]:
                worst = max(inner[m], len(part) - (inner[m - RADIUS] if m >= RADIUS else 0))
                if best is None or worst < best[0]:
                    best = (worst, d, m)
        if best and best[0] < 0.8 * len(part):
            _, d, m = best
            _search(f, idx[d <= m], sets, rng, deep + 1)
            _search(f, idx[d > m - RADIUS], sets, rng, deep + 1)
            return
    if len(idx) > PROBE:  # dense around one point: time in proportion to the set, not to its square
        order = np.argsort(part)
        have = part[order]
        for m in _masks():
            want = have ^ m
            at = np.minimum(np.searchsorted(have, want), len(have) - 1)
            hit = np.flatnonzero((have[at] == want) & (want > have))
            sets.join(idx[order[hit]], idx[order[at[hit]]])
        return
    step = max(1, (1 << 22) // max(1, len(part)))
    for i in range(0, len(part), step):
        a, b = np.nonzero(distance(part[i : i + step, None], part[None, :]) <= RADIUS)
        keep = a + i < b
        sets.join(idx[a[keep] + i], idx[b[keep]])


def links(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the classes of these values: (value, smallest position's value of its class)."""
    f = np.unique(f)
    sets = _Sets(len(f))
    _search(f, np.arange(len(f)), sets, np.random.default_rng(3))
    roots = np.array([sets.root(i) for i in range(len(f))], np.int64)
    own = np.flatnonzero(roots != np.arange(len(f)))
    return f[own], f[roots[own]]


def graft(nodes: list, subs: dict[int, list]) -> list:
    """nodes with trees in the place of leaves; the trees' leaves get numbers of their own."""
    if not nodes:
        return subs[0]
    at, first, places = len(nodes), max([-c for n in nodes for c in n[2:] if c < 0], default=1), {}
    for leaf in sorted(subs):
        places[-1 - leaf] = at
        at += len(subs[leaf])
    out = [(v, m, places.get(a, a), places.get(b, b)) for v, m, a, b in nodes]
    for leaf in sorted(subs):
        shift = len(out)
        child = lambda c: c + shift if c >= 0 else c - first  # noqa: B023, E731
        out += [(v, m, child(a), child(b)) for v, m, a, b in subs[leaf]]
        first += max([-c for n in subs[leaf] for c in n[2:] if c < 0], default=0)
    return out


def plant(distinct: DataFrame) -> list:
    """The tree, grown in rounds: first for shards of about SHARD fingerprints, then inside every shard over MOST, until none is left that splits.

    Each such shard is sampled at a rate of its own (SAMPLE at most) and its subtree grows in the task that has the
    sample; the driver gets the nodes.  A shard that its sample does not split is dense around one point and
    stays, its task probes; so every round settles all it looks at.
    """
    spark, most, shard, shards = distinct.sparkSession, SAMPLE, SHARD, SHARDS
    nodes: list = []
    stuck: set[int] = set()
    large = {0: n} if (n := distinct.count()) > SHARD else {}
    while large:
        now = spark.sparkContext.broadcast(nodes)
        wanted = spark.sparkContext.broadcast({x: (k, max(1, k // most)) for x, k in large.items()})

        def pick(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                v = pdf["__fp"].to_numpy(np.int64)
                i, leaf = route(v.view(np.uint64), now.value)
                rate = np.array([wanted.value.get(x, (0, 0))[1] for x in leaf.tolist()], np.int64)
                keep = (rate > 0) & (pdf["h"].to_numpy(np.int64)[i] % np.maximum(rate, 1) == 0)
                yield pd.DataFrame({"leaf": leaf[keep], "v": v[i[keep]]})

        def subtree(pdf: pd.DataFrame) -> pd.DataFrame:
            leaf = int(pdf["leaf"].iloc[0])
            own = np.sort(pdf["v"].to_numpy(np.int64)).view(np.uint64)
            sub = grow(own, min(shards, wanted.value[leaf][0] // shard + 1)) if len(own) > 8 else []
            return pd.DataFrame({"leaf": [leaf], "nodes": [pickle.dumps(sub)]})

        sample = distinct.select("__fp", F.xxhash64("__fp", F.lit(5)).alias("h")).mapInPandas(pick, "leaf long, v long")
        grown = {r.leaf: pickle.loads(bytes(r.nodes)) for r in sample.groupBy("leaf").applyInPandas(subtree, "leaf long, nodes binary").collect()}
        stuck |= {leaf for leaf in large if not grown.get(leaf)}
        if subs := {leaf: sub for leaf, sub in grown.items() if sub}:
            nodes = graft(nodes, subs)
        after = spark.sparkContext.broadcast(nodes)

        def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                leaf, k = np.unique(route(pdf["__fp"].to_numpy(np.int64).view(np.uint64), after.value)[1], return_counts=True)
                yield pd.DataFrame({"leaf": leaf, "n": k})

        sizes = distinct.select("__fp").mapInPandas(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") > MOST)
        large = {r.leaf: r.n for r in sizes.collect() if r.leaf not in stuck}
    return nodes


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that span the classes of distinct fingerprints __fp."""
    spark = distinct.sparkSession
    python_ready(spark)
    tree = spark.sparkContext.broadcast(plant(distinct))

    def deal(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            v = pdf["__fp"].to_numpy(np.int64)
            i, leaf = route(v.view(np.uint64), tree.value)
            if len(i):
                yield pd.DataFrame({"shard": leaf, "v": v[i]})

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = links(pdf["v"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return cut(distinct.select("__fp").mapInPandas(deal, "shard long, v long").groupBy("shard").applyInPandas(pairs, "a long, b long").distinct(), "links")


def classes(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(__fp, __root, component_id) of every distinct fingerprint of rows (id, __fp): its class by fingerprint and by id."""
    distinct = cut(rows.groupBy("__fp").agg(F.min(id_col).alias("least")), "fingerprints")
    of = cut(components(fingerprint_links(distinct)), "classes")
    named = of.join(distinct, F.col("node") == F.col("__fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = cut(named.join(bounded(cut(least, "least"), 200_000), "root").select("__fp", F.col("root").alias("__root"), "component_id"), "linked")
    return cut(distinct.join(bounded(linked, 200_000), "__fp", "left").select("__fp", F.coalesce("__root", "__fp").alias("__root"), F.coalesce("component_id", "least").alias("component_id")), "classes")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(fingerprints(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "__fp"), "rows")
    return rows.join(bounded(classes(rows), 200_000), "__fp").select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, k: int | None = None) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles of k words: the words' hashes combined, in order.  Fewer words make one shingle, none make none."""
    from xxhash import xxh64_intdigest

    w = words(text)
    k = min(k or WORDS, len(w))
    if not k:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, w), np.uint64, len(w))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def prefix_size(n: int) -> int:
    """How many of a text's n shingles, rarest first, must be looked at: two alike texts share one of these."""
    return n - -(-ALIKE[0] * n // ALIKE[1]) + 1 if n else 0


def alike(one: np.ndarray, two: np.ndarray) -> bool:
    """Jaccard similarity of two shingle sets is ALIKE or more (two empty ones are alike)."""
    both = len(one) + len(two) - len(np.union1d(one, two))
    return ALIKE[1] * both >= ALIKE[0] * (len(one) + len(two) - both)


def sketch(s: np.ndarray) -> bytes:
    """How many of a text's shingle hashes fall in each of equal ranges, about four a range."""
    bits = int(np.clip(np.round(np.log2(max(1, len(s)) / 4)), 4, 9))
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype("<u4").tobytes()


def folded(sketches: list[bytes], ranges: int) -> np.ndarray:
    """Sketches as rows, neighbouring ranges added up."""
    return np.array([np.frombuffer(b, "<u4").reshape(ranges, -1).sum(1, dtype=np.int64) for b in sketches]).reshape(len(sketches), ranges)


def in_common_at_most(a: bytes, b: bytes) -> int:
    """No two texts with these sketches have more shingles in common."""
    x, y = folded([a, b], min(len(a), len(b)) // 4)
    return int(np.minimum(x, y).sum())


def plausible(keys: np.ndarray, roots: np.ndarray, n: np.ndarray, at: np.ndarray, sketches: list[bytes], side: np.ndarray, most: int | None) -> list[tuple[int, int]]:
    """Pairs of texts around one shingle that may be ALIKE and are of different classes, at most `most` for two classes (None: all), the likeliest.

    side: 0 all against each other, else 1 against 2.  Sizes, what follows the shingle and the sketches are
    bounds: no pair is left out that is alike.
    """
    share, whole = ALIKE[0], ALIKE[0] + ALIKE[1]
    rows = folded(sketches, min(map(len, sketches)) // 4)
    found: dict[tuple[int, int], list] = {}
    for i in range(len(keys)):
        if side[i] == 2:
            continue
        j = np.flatnonzero(side == 2) if side[i] else np.arange(i + 1, len(keys))
        j = j[(roots[j] != roots[i]) & (np.minimum(n[i], n[j]) * ALIKE[1] >= np.maximum(n[i], n[j]) * share) & (np.minimum(n[i] - at[i], n[j] - at[j]) * whole >= (n[i] + n[j]) * share)]
        if len(j):
            j = j[np.minimum(rows[i], rows[j]).sum(1) * whole >= (n[i] + n[j]) * share]
        for x in j.tolist():
            both = in_common_at_most(sketches[i], sketches[x])
            if both * whole >= (n[i] + n[x]) * share:
                pair = (min(keys[i], keys[x]), max(keys[i], keys[x]))
                of = found.setdefault((min(roots[i], roots[x]), max(roots[i], roots[x])), [])
                heapq.heappush(of, (both / max(1, n[i] + n[x]), pair))
                if most is not None and len(of) > most:
                    heapq.heappop(of)
    return [pair for of in found.values() for _, pair in of]


def described(texts: DataFrame, buckets: int) -> DataFrame:
    """(key, doc_id, print, n, prefix, at, sketch) of texts (doc_id, __fp, text): fingerprint, number of distinct shingles and those of its rarest, as group numbers, that other texts have as well, with their places; sketch().

    Documents go in chunks.  A chunk sends its distinct shingles, 48 bits of their hashes, packed by range
    of hashes; the ranges' tasks count them over all documents and answer with number and count of those
    met more than once; a chunk's task puts its documents' shingles in the order of these counts, then of
    the hashes.  (Hashes that collide cost a comparison.)
    """
    def chunks(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, k = TaskContext.get().partitionId() << 32, 0
        bound = np.arange(1, buckets, dtype=np.float64) * (2.0**48 / buckets)
        for pdf in it:
            sets = [shingle_set(t) for t in pdf["text"]]
            own, times = np.unique(np.concatenate(sets) >> np.uint64(16), return_counts=True)
            at = [np.searchsorted(own, np.unique(s >> np.uint64(16))) for s in sets]
            lens = np.array([len(x) for x in at], np.int32)
            gaps = np.concatenate([np.diff(x, prepend=0) for x in at]).astype(np.int32)
            cuts = [0, *np.searchsorted(own, bound.astype(np.uint64)).tolist(), len(own)]
            for b in range(buckets):
                x, y = cuts[b], cuts[b + 1]
                if x < y:
                    yield pd.DataFrame([(task + k, b, x, y - x, pack(np.diff(own[x:y].astype(np.int64), prepend=0)), pack(times[x:y].astype(np.int32)), None, None, None, None, None, None)], columns=names)
            ids = pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None)
            yield pd.DataFrame([(task + k, -1, 0, len(own), None, None, list(pdf["__fp"]), list(ids), np.array([majority(s) for s in sets], np.uint64).view(np.int64), pack(lens), pack(gaps), [sketch(s) for s in sets])], columns=names)
            k += 1

    schema = "chunk long, bucket int, start int, n int, hashes binary, times binary, keys array<long>, ids array<long>, prints array<long>, lens binary, gaps binary, sketches array<binary>"
    names = [x.split()[0] for x in schema.split(", ")]
    made = cut(texts.select("doc_id", "__fp", "text").mapInPandas(chunks, schema), "chunks")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.cumsum(unpack(h, "<i8")) for h in pdf["hashes"]]
        _, number = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(number, np.concatenate([unpack(t, "<i4") for t in pdf["times"]])).astype(np.int64)
        out, a, bucket = [], 0, int(pdf["bucket"].iloc[0])
        for chunk, start, part in zip(pdf["chunk"], pdf["start"], parts):
            own = number[a : a + len(part)]
            a += len(part)
            hit = np.flatnonzero(total[own] > 1)
            if len(hit):
                out.append((chunk, bucket, start, pack(np.diff(hit, prepend=0).astype(np.int32)), pack(np.diff(own[hit], prepend=0).astype(np.int32)), pack(np.minimum(total[own[hit]], 1 << 30).astype(np.int32))))
        return pd.DataFrame(out, columns=["chunk", "bucket", "start", "at", "number", "total"])

    asked = made.where("bucket >= 0").select("chunk", "bucket", "start", "hashes", "times")
    answers = asked.groupBy("bucket").applyInPandas(count, "chunk long, bucket int, start int, at binary, number binary, total binary")

    def order(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            total, group = np.ones(row.n, np.int64), np.zeros(row.n, np.int64)
            for bucket, start, at, number, t in zip(right["bucket"], right["start"], right["at"], right["number"], right["total"]):
                where = start + np.cumsum(unpack(at, "<i4"), dtype=np.int64)
                total[where] = unpack(t, "<i4")
                group[where] = np.cumsum(unpack(number, "<i4"), dtype=np.int64) + (int(bucket) << 32)
            gaps, a = unpack(row.gaps, "<i4"), 0
            for key, doc, fp, k, sk in zip(row.keys, row.ids, row.prints, unpack(row.lens, "<i4").tolist(), row.sketches):
                own = np.cumsum(gaps[a : a + k], dtype=np.int64)
                a += k
                first = own[np.argsort(total[own], kind="stable")[: prefix_size(k)]]
                at = np.flatnonzero(total[first] > 1)
                if not k:  # texts without words meet
                    out.append((key, doc, fp, 0, np.array([-1]), np.array([0]), sk))
                else:
                    out.append((key, doc, fp, k, group[first[at]], at, sk))
        return pd.DataFrame(out, columns=["key", "doc_id", "print", "n", "prefix", "at", "sketch"]).astype({"doc_id": "Int64"})

    documents_of = made.where("bucket < 0").select("chunk", "n", "keys", "ids", "prints", "lens", "gaps", "sketches")
    return documents_of.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(order, "key long, doc_id long, print long, n long, prefix array<long>, at array<long>, sketch binary")


def near_classes(texts: DataFrame) -> DataFrame:
    """(__fp, __root, component_id) of every distinct text of texts (doc_id, __fp, text), __fp being its key.

    Links are pairs whose shingles are ALIKE, all of them.  Candidates are the links of 5-word fingerprints
    and the texts that share one of their rarest shingles, which every alike pair does.  A group is the texts
    around one shingle, as rows; of groups of the same texts the first counts.  Texts of one class need no
    comparing.  In each of a few rounds every text is compared with one text of another class in one of its groups, the same
    for all of a group, which joins copies of one text in a round or two.  What is left goes through
    plausible() in tasks that hold one group, many small ones, or two blocks of a large one, first with a few
    pairs for two classes, at last with all.  Only pairs that pass its bounds are compared: their texts' sorted hashes are
    made once a round and joined to them.
    """
    spark = texts.sparkSession
    python_ready(spark)
    n, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    sets = cut(described(texts, max(1, (size or 0) // COUNTED)), "sets")
    nodes = cut(sets.groupBy("key").agg(F.min("doc_id").alias("least")), "nodes")
    share, whole_ = ALIKE[0], ALIKE[0] + ALIKE[1]  # alike texts have share / whole_ of the sum of their sizes in common
    #: a text that can be the smaller of an alike pair at this shingle: what follows it is enough for a partner of its size
    early = F.col("at") * whole_ <= F.col("n") * (ALIKE[1] - ALIKE[0])
    once = sets.dropDuplicates(["key"])
    sketches = cut(once.select("key", "sketch"), "sketches")
    entries = cut(once.select("n", "key", F.explode(F.arrays_zip("prefix", "at")).alias("e")).select("e.prefix", "n", "key", "e.at"), "entries")
    members = entries.groupBy("prefix").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(2))).alias("y"), F.min_by("at", "key").alias("first"), F.max(early).alias("early"))
    kept = members.where("c > 1 and early").groupBy("c", "x", "y").agg(F.min_by("prefix", F.struct("first", "prefix")).alias("prefix"))
    groups = cut(entries.join(kept.select("prefix"), "prefix").select(F.col("prefix").alias("g"), "n", "key", "at"), "groups")
    prints = sets.select("print", "key")
    first = cut(prints.groupBy("print").agg(F.min("key").alias("key")), "prints")
    found = fingerprint_links(first.select(F.col("print").alias("__fp")))
    python_ready(spark)
    at = lambda c: first.select(F.col("print").alias(c), F.col("key").alias(f"key_{c}"))
    pairs = found.join(at("a"), "a").join(at("b"), "b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    pairs = pairs.unionByName(prints.join(first.withColumnRenamed("key", "a"), "print").select("a", F.col("key").alias("b")))
    tried = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    of = nodes.select("key", F.col("key").alias("root"))

    def can(n1, at1, n2, at2):
        """What two texts can share from their first common shingle on suffices, and so do their sizes."""
        return (F.least(n1 - at1, n2 - at2) * whole_ >= (n1 + n2) * share) & (F.least(n1, n2) * ALIKE[1] >= F.greatest(n1, n2) * ALIKE[0])

    def hashes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"key": pdf["__fp"], "h": [shingle_set(t).tobytes() for t in pdf["text"]]})

    def bound(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            size = lambda b: int(np.frombuffer(b, "<u4").sum(dtype=np.int64))
            keep = [in_common_at_most(x, y) * whole_ >= (size(x) + size(y)) * share for x, y in zip(pdf["h_a"], pdf["h_b"])]
            yield pdf.loc[keep, ["a", "b"]]

    def compare(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            hit = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(pdf["h_a"], pdf["h_b"])]
            yield pdf.loc[hit, ["a", "b"]]

    def both(pairs: DataFrame, of: DataFrame, col: str) -> DataFrame:
        side = lambda c: of.select(F.col("key").alias(c), F.col(col).alias(f"h_{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b")

    def verified(pairs: DataFrame) -> DataFrame:
        need = pairs.select(F.col("a").alias("__fp")).union(pairs.select("b")).distinct()
        whole = cut(texts.join(bounded(need, 200_000), "__fp", "left_semi").select("__fp", "text").dropDuplicates(["__fp"]).mapInPandas(hashes, "key long, h binary"), "hashes")
        out = cut(both(pairs, whole, "h").mapInPandas(compare, "a long, b long"), "verified")
        drop(whole)
        return out

    def blocks(open_: DataFrame, sizes: DataFrame, most: int | None) -> DataFrame:
        """Pairs of the open groups' texts that pass the bounds."""
        small = sizes.where(F.col("m") <= BLOCK)
        rows = small.agg(F.sum("m")).first()[0] or 0
        tasks = max(1, -(-rows // (4 * BLOCK)))
        with_ = open_.join(sketches, "key")
        few = with_.join(small.select("g"), "g", "left_semi").select(F.pmod(F.xxhash64("g"), F.lit(tasks)).alias("task"), F.col("g").alias("s"), "key", "root", "n", "at", "sketch", F.lit(0).alias("side"))
        # a large group in blocks: a large class has its own, which do not meet each other, small classes share some
        many = open_.join(sizes.where(F.col("m") > BLOCK).select("g", "m"), "g")
        own = many.groupBy("g", "root").agg(F.count("*").alias("c"), F.first("m").alias("m"))
        big = F.col("c") > BLOCK
        own = own.select("g", "root", big.alias("big"), F.ceil(F.when(big, F.col("c")).otherwise(F.col("m")) / BLOCK).alias("k"))
        label = F.struct("big", F.when(F.col("big"), F.col("root")).otherwise(0).alias("r"), F.pmod(F.xxhash64("root", F.when(F.col("big"), F.col("key"))), F.col("k")).alias("i"))
        dealt = cut(many.join(own, ["g", "root"]).select("g", "key", "root", "n", "at", label.alias("l")), "dealt")
        labels = dealt.select("g", "l").distinct()
        meet = labels.join(labels.select("g", F.col("l").alias("l2")), "g").where("l <= l2 and not (l.big and l2.big and l.r = l2.r)").withColumn("s", F.xxhash64("g", "l", "l2"))
        left = dealt.join(meet, ["g", "l"]).withColumn("side", F.when(F.col("l") == F.col("l2"), 0).otherwise(1))
        right = dealt.join(meet.where("l <> l2").select("g", F.col("l").alias("l1"), F.col("l2").alias("l"), "s"), ["g", "l"]).withColumn("side", F.lit(2))
        cols = ["s", "key", "root", "n", "at", "side"]
        large = left.select(*cols).unionByName(right.select(*cols)).join(sketches, "key").withColumn("task", F.col("s"))

        def meeting(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["s", "key"])
            s = pdf["s"].to_numpy()
            ends = np.flatnonzero(np.append(s[1:] != s[:-1], True)) + 1
            key, root, n, at, side = (pdf[c].to_numpy(np.int64) for c in ("key", "root", "n", "at", "side"))
            sk, out, a = [bytes(b) for b in pdf["sketch"]], [], 0
            for b in ends.tolist():
                out += plausible(key[a:b], root[a:b], n[a:b], at[a:b], sk[a:b], side[a:b], most)
                a = b
            return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

        return few.unionByName(large.select(*few.columns)).groupBy("task").applyInPandas(meeting, "a long, b long")

    turn, everything, last = 0, False, False
    while True:
        pairs = cut(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        none = not pairs.limit(1).count()
        if none and last:
            break
        if not none:
            old = tried, of
            check = pairs if everything else cut(both(pairs, sketches, "sketch").mapInPandas(bound, "a long, b long"), "plausible")
            links = verified(check)
            tried = cut(tried.unionByName(pairs), "tried")
            # classes that the new links join: the graph of the former classes' roots is small
            root = lambda c: of.select(F.col("key").alias(c), F.col("root").alias(f"root_{c}"))  # noqa: B023, E731
            joined = components(links.join(root("a"), "a").join(root("b"), "b").select("root_a", "root_b"), "root_a", "root_b", GRAPH)
            of = cut(of.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("key", F.coalesce("to", "root").alias("root")), "classes")
            drop(*old, links, check, pairs)
        if last:
            break
        # groups that still hold several classes
        open_ = groups.join(of, "key")
        sizes = open_.groupBy("g", "root").agg(F.count("*").alias("c"), F.sum(early.cast("long")).alias("e")).groupBy("g").agg(F.count("*").alias("classes"), F.sum("c").alias("m"), F.sum("e").alias("early"), F.sum(F.col("c") * F.col("e")).alias("own")).where("classes > 1 and early > 0")
        sizes = cut(sizes, "sizes")
        left = sizes.agg(F.sum(F.col("m") * F.col("early") - F.col("own"))).first()[0] or 0
        if not left:
            break
        open_ = cut(open_.join(sizes.select("g"), "g", "left_semi").withColumn("early", early), "open")
        last = everything and (none or turn >= 2 * ROUNDS)
        everything = everything or none and turn > 0 or turn >= ROUNDS - 1 or left <= PAIRS * n
        if everything:
            last = last or left <= PAIRS * n
            pairs = blocks(open_, sizes, None if last else CLOSE)
        else:
            one = open_.where("early").groupBy("g").agg(F.min_by(F.struct("key", "root", "n", "at"), F.xxhash64("key", F.lit(turn))).alias("o"))
            asked = open_.join(one, "g").where("o.root <> root").where(can(F.col("o.n"), F.col("o.at"), F.col("n"), F.col("at")))
            pairs = asked.groupBy("key").agg(F.min_by("o.key", F.xxhash64("o.key", F.lit(turn))).alias("a")).select("a", F.col("key").alias("b"))
        turn += 1
    named = of.join(nodes, "key")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return cut(named.join(bounded(cut(least, "least"), 200_000), "root").select(F.col("key").alias("__fp"), F.col("root").alias("__root"), "component_id"), "classes")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of op6 stays; of rows that repeat that id in a class, one."""
    return _least_stay(docs, lambda df, t: fingerprints(df, text_col=t), lambda rows: classes(rows.select("doc_id", "__fp")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same with classes of texts whose 5-word shingles are alike; __fp is the text's own hash."""
    return _least_stay(docs, lambda df, t: df.withColumn("__fp", F.xxhash64(F.coalesce(F.col(t), F.lit("")))), near_classes)


def _least_stay(docs: DataFrame, keyed: Callable[[DataFrame, str], DataFrame], grouped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    names = [f"__k{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    i, t = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    rows = keyed(flat.select(i, t), t).select(F.col(i).alias("doc_id"), "__fp", F.col(t).alias("text"))
    if grouped is not near_classes:
        rows = cut(rows.drop("text"), "rows")
    of = grouped(rows)
    stay = rows.join(bounded(of, 200_000), "__fp").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("__n"))
    stay = cut(stay.withColumnRenamed("doc_id", "__stay"), "stay")
    out = flat.join(bounded(stay, 1_000_000), F.col(i).eqNullSafe(F.col("__stay")))
    if stay.where("__n > 1").limit(1).count():
        # an id that several rows have: only those whose own class it names stay, one for each class
        again = keyed(out.where("__n > 1"), t).join(of, "__fp").where(F.col(i).eqNullSafe(F.col("component_id"))).dropDuplicates(["__root"])
        out = out.where("__n = 1").select(*names).unionByName(again.select(*names))
    return out.select(*names).toDF(*docs.columns)
