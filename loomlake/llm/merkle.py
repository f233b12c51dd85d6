"""Merkle manifest of a table: a tree of each group of rows, their subroots under one root, and a proof for every row.

A leaf is the digest of a row's fields.  Within a group (the query: a language) leaves ascend by id; every
ARITY consecutive nodes become the digest of their hex digests until one is left, the last run of a level
being shorter, even one node.  Subroots, in the order of their groups, become the root likewise.

The forest is an associative monoid.  An element is a set of unresolved nodes keyed by tree, level and index;
adding two puts their nodes together and replaces each complete run of siblings, whose arity follows from
the tree's size, by its parent (`merge`).  Leaves are sorted over range partitions; each partition is folded to
an element, and a tree of reductions of FAN elements each, in the partitions' order, so that an
element keeps at most two open runs a level and tree, adds them up.  Every run that a reduction completes is
written down: these are all the runs that cross partitions, and with its own leaves and the runs that it
touches a partition has the whole paths of its rows.  Nothing but one root is ever in one place.

A proof is two arrays by level, the hex digests left and right of the row's node in its run; `refold` computes a root
from a leaf and a proof with built-in functions, so whoever holds them can verify a row.

Nulls in any field have a mark of their own; a null group is a group and comes first, null ids come first in
their group.  Rows that share an id ascend by their digests, and rows repeated exactly are told apart by place
only, which changes no digest.  Empty texts are texts; very long ones are hashed whole where they are read.  An
empty table has no root and no proofs.  Further columns of the input do not matter.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, drop, lower_ascii, python_ready

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Siblings of a full run; leaves of a partition, about; elements added in one task.
ARITY, PART, FAN = 8, 32_768, 16
#: Levels of a tree, at most: ARITY to that power is a long.
LEVELS = 20
_HEX = 64


def digest(*fields: Column) -> Column:
    """SHA-256 (hex) of fields, each `-` if null, else its UTF-8 byte count, a colon and its text."""
    said = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*said), 256)


def parent(children: str) -> str:
    return sha256(children.encode()).hexdigest()


def merge(nodes: dict[int, dict[int, str]], n: int) -> tuple[dict[int, dict[int, str]], list[tuple[int, int, str]], str | None]:
    """(unresolved nodes, runs completed, root) of a tree of n leaves, from its known nodes by level and index.

    A run is (level of its members, index of their parent, their digests).  The union of two results' nodes, merged
    again, is the result of the union: the order of additions does not matter.
    """
    left, runs, up, level, width = {}, [], {}, 0, n
    while width > 1:
        own = {**nodes.get(level, {}), **up}
        siblings: dict[int, list[int]] = defaultdict(list)
        for i in sorted(own):
            siblings[i // ARITY].append(i)
        up = {}
        for j, members in siblings.items():
            if len(members) == min(ARITY, width - j * ARITY):
                children = "".join([own[i] for i in members])
                up[j] = parent(children)
                runs.append((level, j, children))
            else:
                left.setdefault(level, {}).update((i, own[i]) for i in members)
        level, width = level + 1, -(-width // ARITY)
    return left, runs, {**nodes.get(level, {}), **up}.get(0)


def paths(first: int, leaves: list[str], n: int, known: dict[tuple[int, int], str], top: tuple[list[str], list[str]]):
    """(children, first member here, members here, before, after) of every run of leaves first.. of a tree of n; before and after are the digests beside the run's parent and above, by level.

    known: the runs (level, parent) that these leaves do not fill by themselves.  top: what follows above the tree's root.
    """
    if n == 1:
        return [(leaves[0], 0, 1, *top)]
    level, width, a, own, made = 0, n, first, leaves, []
    while width > 1:
        lo, hi, runs = a // ARITY, (a + len(own) - 1) // ARITY, []
        for j in range(lo, hi + 1):
            x, y = j * ARITY - a, min((j + 1) * ARITY, width) - a
            runs.append("".join(own[x:y]) if x >= 0 and y <= len(own) else known[level, j])
        made.append((lo, runs))
        a, own = lo, [parent(c) for c in runs]
        level, width = level + 1, -(-width // ARITY)
    above = [top]
    for lo, runs in reversed(made[1:]):
        below = made[level - 2]
        level -= 1
        out = []
        for i in range(below[0], below[0] + len(below[1])):
            children, at = runs[i // ARITY - lo], i % ARITY * _HEX
            before, after = above[i // ARITY - lo]
            out.append(([children[:at], *before], [children[at + _HEX :], *after]))
        above = out
    lo, runs = made[0]
    out = []
    for k, children in enumerate(runs):
        x = max(first, (lo + k) * ARITY)
        y = min(first + len(leaves), (lo + k + 1) * ARITY)
        out.append((children, x - (lo + k) * ARITY, y - x, *above[k]))
    return out


class Forest:
    """The trees of leaves (tree, id, leaf, altered): subroots, and proofs for every leaf.

    altered is another digest that a reader may hold in place of the leaf's (null: none); it goes along to the proofs.
    """

    def __init__(self, leaves: DataFrame):
        python_ready(leaves.sparkSession)
        self.kind = dict(leaves.dtypes)["id"]
        rows = cut(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
        order = ["tree", "id", "leaf", "tie"]
        self.parts = max(1, -(-rows.count() // PART))
        laid = rows.repartitionByRange(self.parts, *order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("at"), "tree", F.col("id").cast("string").alias("id"), F.unhex("leaf").alias("leaf"), F.unhex("altered").alias("altered"))
        self.laid = cut(laid.withColumn("part", F.shiftright("at", 33)), "laid")
        drop(rows)
        tree, so_far = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
        segments = self.laid.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count("*").alias("size"))
        #: a tree's leaves in a partition: part, first (place), size, offset (leaves before), t (number of the tree, ascending by tree), n (its leaves)
        self.segments = cut(segments.select("*", F.coalesce(F.sum("size").over(so_far), F.lit(0)).alias("offset"), F.min("first").over(tree).alias("t"), F.sum("size").over(tree).alias("n")), "segments")
        self.parts = (self.segments.agg(F.max("part")).first()[0] or 0) + 1
        self.subroots, self.runs = self._reduce()

    def _folded(self) -> DataFrame:
        def fold(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            left = left.sort_values("at")
            at, out = left["at"].to_numpy(), []
            for s in right.itertuples():
                a = int(np.searchsorted(at, s.first))
                own = [bytes(b).hex() for b in left["leaf"].iloc[a : a + s.size]]
                open_, _, root = merge({0: dict(zip(range(s.offset, s.offset + s.size), own))}, s.n)
                out += [(s.part, s.t, s.n, 0, level, i, d) for level, of in open_.items() for i, d in of.items()]
                if root:
                    out.append((s.part, s.t, s.n, 2, 0, 0, root))
            return pd.DataFrame(out, columns=_ELEMENT_NAMES)

        right = self.segments.select("part", "first", "size", "offset", "t", "n")
        return cut(self.laid.select("part", "at", "leaf").groupBy("part").cogroup(right.groupBy("part")).applyInPandas(fold, _ELEMENT), "elements")

    def _reduce(self) -> tuple[DataFrame, DataFrame]:
        """(t, subroot) and the runs (t, level, above, children) that cross partitions."""

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            out, part = [], int(pdf["part"].iloc[0]) // FAN
            for (t, n), own in pdf.groupby(["t", "n"]):
                nodes: dict[int, dict[int, str]] = defaultdict(dict)
                for level, i, d in zip(own["level"].tolist(), own["i"].tolist(), own["digest"]):
                    nodes[level][i] = d
                open_, runs, root = merge(nodes, n)
                out += [(part, t, n, 0, level, i, d) for level, of in open_.items() for i, d in of.items()]
                out += [(part, t, n, 1, level, j, children) for level, j, children in runs]
                if root:
                    out.append((part, t, n, 2, 0, 0, root))
            return pd.DataFrame(out, columns=_ELEMENT_NAMES)

        steps, parts = [self._folded()], self.parts
        while parts > 1:
            parts = -(-parts // FAN)
            steps.append(cut(steps[-1].where("kind = 0").groupBy(F.floor(F.col("part") / FAN)).applyInPandas(add, _ELEMENT), "elements"))
        both = reduce(DataFrame.unionByName, steps).where("kind > 0")
        runs = both.where("kind = 1").select("t", "level", F.col("i").alias("above"), F.col("digest").alias("children"))
        return both.where("kind = 2").select("t", F.col("digest").alias("subroot")), runs

    def proofs(self, tops: DataFrame) -> DataFrame:
        """(id, leaf, altered, before, after, subroot, root) of every leaf, given tops (t, before, after, subroot, root): what is beside and above the subroots."""
        levels = self.segments.select("part", "t", "n", "offset", "size", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
        levels = levels.withColumn("w", F.pow(F.lit(ARITY), F.col("level")).cast("long")).where("w < n").withColumn("w", F.col("w") * ARITY)
        touched = levels.select("part", "t", "level", F.explode(F.expr("array_distinct(array(offset div w, (offset + size - 1) div w))")).alias("above"))
        crossing = touched.join(self.runs, ["t", "level", "above"]).groupBy("part", "t").agg(F.collect_list(F.struct("level", "above", "children")).alias("r"))
        right = self.segments.select("part", "first", "size", "offset", "t", "n").join(crossing, ["part", "t"], "left").join(tops, "t")
        right = right.select("part", "first", "size", "offset", "n", F.col("r.level").alias("levels"), F.col("r.above").alias("aboves"), F.col("r.children").alias("runs"), "before", "after", "subroot", "root")

        def prove(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            left = left.sort_values("at")
            at, out = left["at"].to_numpy(), []
            for s in right.itertuples():
                a = int(np.searchsorted(at, s.first))
                own = left.iloc[a : a + s.size]
                ids, altered = own["id"].tolist(), [None if b is None else bytes(b).hex() for b in own["altered"]]
                known = {} if s.levels is None else dict(zip(zip(map(int, s.levels), map(int, s.aboves)), s.runs))
                k = 0
                for children, x, many, before, after in paths(s.offset, [bytes(b).hex() for b in own["leaf"]], s.n, known, (list(s.before), list(s.after))):
                    out.append((s.n == 1, children, x, ids[k : k + many], altered[k : k + many], before, after, s.subroot, s.root))
                    k += many
            return pd.DataFrame(out, columns=[c.split()[0] for c in run.split(", ")])

        run = "lone boolean, children string, x int, ids array<string>, altered array<string>, before array<string>, after array<string>, subroot string, root string"
        made = self.laid.select("part", "at", "id", "leaf", "altered").groupBy("part").cogroup(right.groupBy("part")).applyInPandas(prove, run)
        each = made.select("*", F.posexplode(F.arrays_zip("ids", F.col("altered").alias("others"))).alias("k", "m"))
        each = each.select("*", ((F.col("x") + F.col("k")) * _HEX).alias("p"))
        side = lambda own, more: F.when(F.col("lone"), F.col(more)).otherwise(F.array_prepend(more, own)).alias(more)
        return each.select(
            F.col("m.ids").cast(self.kind).alias("id"), F.expr(f"substring(children, p + 1, {_HEX})").alias("leaf"), F.col("m.others").alias("altered"),
            side(F.expr("substring(children, 1, p)"), "before"), side(F.expr(f"substring(children, p + 1 + {_HEX})"), "after"), "subroot", "root",
        )


_ELEMENT = "part long, t long, n long, kind int, level int, i long, digest string"  # kind: 0 an unresolved node, 1 a completed run, 2 a root
_ELEMENT_NAMES = [c.split()[0] for c in _ELEMENT.split(", ")]


class Manifest:
    """The trees of a table's groups under one root.

    subroots: (t, tree, n, subroot) of every group; root: (root), one row, none of an empty table; proofs: (id, leaf,
    altered, before, after, subroot, root) of every row.
    """

    def __init__(self, leaves: DataFrame):
        self.forest = Forest(leaves)
        own = self.forest.subroots
        self.subroots = self.forest.segments.groupBy("t", "tree", "n").agg(F.count("*").alias("partitions")).drop("partitions").join(own, "t")
        upper = Forest(own.select(F.lit(0).alias("tree"), F.col("t").alias("id"), F.col("subroot").alias("leaf"), F.lit(None).cast("string").alias("altered")))
        none = F.array().cast("array<string>")
        self.root = upper.subroots.select(F.col("subroot").alias("root"))
        above = upper.proofs(upper.subroots.select("t", none.alias("before"), none.alias("after"), "subroot", F.col("subroot").alias("root")))
        tops = cut(above.select(F.col("id").alias("t"), "before", "after", F.col("leaf").alias("subroot"), "root"), "tops")
        self.proofs = self.forest.proofs(tops)


def refold(leaf: Column, before: Column, after: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a"))), leaf, lambda d, s: F.sha2(F.concat(s["b"], d, s["a"]), 256))


def proof_digest(before: Column, after: Column) -> Column:
    """SHA-256 of a proof's siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.zip_with(before, after, lambda b, a: F.concat(b, a))), 256)


def leaves(docs: DataFrame, altered: dict[str, Column] | None = None, where: Column | None = None, fields: tuple[str, ...] = FIELDS, group: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """(tree, id, leaf, altered) of docs; altered: fields that a reader sees otherwise, in rows for which `where` holds."""
    altered = altered or {}
    other = F.when(F.lit(False) if where is None else where, digest(*[altered.get(c, F.col(c)) for c in fields])).otherwise(F.lit(None))
    return docs.select(F.col(group).alias("tree"), F.col(id_col).alias("id"), digest(*map(F.col, fields)).alias("leaf"), other.cast("string").alias("altered"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*FIELDS)
    p = Manifest(leaves(docs, {"text": lower_ascii(F.col("text"))}, F.crc32(F.col("doc_id").cast("string")) % 3 == 0)).proofs
    folded = refold(F.coalesce("altered", "leaf"), F.col("before"), F.col("after"))
    out = p.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("before"), F.col("after")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 8) -> str:
    """The same rows up to 8 to the power of `levels` documents a language, and as many languages."""
    said = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(f"({said(text if c == 'text' else c)})" for c in FIELDS) + ")"
    crc = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT for _ in range(8)]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""
    ctes = [
        f"d AS (SELECT *, {leaf('text')} AS leaf, xor({crc}, 4294967295) % 3 = 0 AS hit FROM documents)",
        f"l AS (SELECT *, CASE WHEN hit THEN {leaf('translate(text, chr(0) || upper(az), chr(0) || az)')} ELSE leaf END AS held FROM (SELECT *, 'abcdefghijklmnopqrstuvwxyz' AS az FROM d))",
        "n0 AS (SELECT lang AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, doc_id, held FROM l)",
        "s0 AS (SELECT tree, i, h, doc_id, held FROM n0)",
    ]

    def climb(p: str, last: str) -> str:
        """Levels of the trees of `last` (tree, i, h): p1, p2, ... and for each (tree, i) of a level what its run has left and right."""
        for k in range(levels):
            ctes.append(f"{p}w{k} AS (SELECT tree, count(*) AS w FROM {last} GROUP BY tree)")
            ctes.append(f"{p}r{k} AS (SELECT x.tree, i // 8 AS j, w, list(h ORDER BY i) AS hs FROM {last} x JOIN {p}w{k} y ON x.tree IS NOT DISTINCT FROM y.tree GROUP BY x.tree, i // 8, w)")
            ctes.append(f"{p}{k + 1} AS (SELECT tree, j AS i, CASE WHEN w = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {p}r{k})")
            last = f"{p}{k + 1}"
        return last

    def prove(p: str, at: str) -> str:
        """at (tree, i, ..., sib, fold) taken up level by level."""
        for k in range(levels):
            ctes.append(
                f"{p}q{k} AS (SELECT a.* REPLACE (a.i // 8 AS i, CASE WHEN w = 1 THEN sib ELSE sib || array_to_string(hs[1:a.i % 8], '') || array_to_string(hs[a.i % 8 + 2:], '') END AS sib, "
                f"CASE WHEN w = 1 THEN fold ELSE sha256(array_to_string(hs[1:a.i % 8], '') || fold || array_to_string(hs[a.i % 8 + 2:], '')) END AS fold) FROM {at} a JOIN {p}r{k} r ON a.tree IS NOT DISTINCT FROM r.tree AND a.i // 8 = r.j)"
            )
            at = f"{p}q{k}"
        return at

    top = climb("a", "s0")
    ctes.append("p AS (SELECT *, '' AS sib, held AS fold FROM n0)")
    mine = prove("a", "p")
    ctes.append(f"t0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, h, tree AS lang FROM {top})")
    root = climb("b", "t0")
    ctes.append(f"u AS (SELECT 0 AS tree, t0.i, m.doc_id, m.h AS leaf, t0.h AS subroot, m.sib, m.fold FROM {mine} m JOIN t0 ON m.tree IS NOT DISTINCT FROM t0.lang)")
    every = prove("b", "u")
    return f"WITH {', '.join(c.replace(' AS (', ' AS MATERIALIZED (', 1) for c in ctes)} SELECT doc_id, leaf, subroot, r.h AS root, sha256(sib) AS proof_sha256, fold AS folded_root, fold = r.h AS verified FROM {every}, {root} r"


OP11_SQL = _sql()
