"""Scans, filters, joins, windows and set operations shared by the knowledge-base queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows of a level of a search up to which it is broadcast; bits of a table of marks, and of a row of it; nodes of a way at most.
FEW, MARKS, BLOCK_BITS, HOPS = 400_000, 1 << 27, 1 << 16, 1 << 20
#: Fixed order of classifications.
LEVELS = {"public": 0, "internal": 1, "confidential": 2, "secret": 3}


def bounded(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else the planner chooses a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def level(c: Column, unknown: int | None) -> Column:
    """Ordinal of a classification; what an unknown one counts as, or null."""
    out = F.when(F.lit(False), F.lit(0))
    for name, n in LEVELS.items():
        out = out.when(c == name, F.lit(n))
    return out if unknown is None else F.coalesce(out, F.lit(unknown))


def scan(df: DataFrame, tenant=None) -> DataFrame:
    """Live rows (soft delete), of one tenant if one is named and the table knows tenants."""
    if "deleted_at" in df.columns:
        df = df.where(F.col("deleted_at").isNull())
    if tenant is not None and "tenant_id" in df.columns:
        df = df.where(F.col("tenant_id") == tenant)
    return df


def page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page in a total order; page from 1, size clamped to 1..100."""
    page, size = max(1, page), min(100, max(1, size))
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def hierarchy(df: DataFrame, filters: dict) -> DataFrame:
    """Conjunction of hierarchy filters: null values and unknown keys are skipped, path_prefix is a prefix, a depth that is no number is skipped."""
    conds = []
    for k, v in filters.items():
        if v is None:
            continue
        if k == "path_prefix":
            conds.append(F.col("path").startswith(v))
        elif k == "doc_status":
            conds.append(F.col("status") == v)
        elif k == "depth":
            try:
                conds.append(F.col("depth") == int(v))
            except (TypeError, ValueError):
                continue
        elif k in ("series_id", "parent_id", "version_of"):
            conds.append(F.col(k) == v)
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def in_kbs(df: DataFrame, kbs: list | None) -> DataFrame:
    """No list or an empty one is no filter."""
    return df.where(F.col("kb_id").isin(kbs)) if kbs else df


def accessible(df: DataFrame, kbs: list | None) -> DataFrame:
    """None is unrestricted; an empty set gives no rows."""
    return df if kbs is None else df.where(F.col("kb_id").isin(kbs)) if kbs else df.where(F.lit(False))


def valid_at(df: DataFrame, now: Column, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    return df.where((F.col(start).isNull() | (F.col(start) <= now)) & (F.col(end).isNull() | (F.col(end) >= now)))


def latest_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def asof_backward(df: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """The last non-null value at or before each row of its key: an as-of join within one pass."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def turns(messages: DataFrame) -> DataFrame:
    """Each user message owns the assistant messages up to the next one; those before the first user message leave."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumn("turn_no", F.sum((F.col("role") == "user").cast("int")).over(w)).where("turn_no > 0")


def outer_sum(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Full outer join of (key, n) aggregates with 0 for what is missing: a union and one aggregate instead of joins."""
    names = list(parts)
    rows = [df.select(key, *[(F.col("n") if m == name else F.lit(0)).cast("long").alias(m) for m in names]) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, rows).groupBy(key).agg(*[F.sum(m).alias(m) for m in names])


def set_overlap(got: DataFrame, want: DataFrame, key: str, item: str) -> DataFrame:
    """(key, hits, got, wanted): of each key's distinct items, how many are wanted, how many there are, and how many are wanted in all.  A join with a flag and counts; no set is gathered."""
    flagged = got.select(key, item).distinct().join(want.select(item).distinct().withColumn("__w", F.lit(1)), item, "left")
    counts = flagged.groupBy(key).agg(F.count("__w").alias("hits"), F.count("*").alias("got"))
    return counts.crossJoin(F.broadcast(want.select(item).distinct().agg(F.count("*").alias("wanted"))))  # one row


def append_events(log: DataFrame, new: DataFrame, session: str, order: list[str]) -> DataFrame:
    """new with seq: it goes on from the highest of its session in the log, from 1 in a session without events."""
    last = log.groupBy(session).agg(F.max("seq").alias("__last"))
    n = F.row_number().over(Window.partitionBy(session).orderBy(*order))
    return new.withColumn("__n", n).join(last, session, "left").withColumn("seq", (F.coalesce("__last", F.lit(0)) + F.col("__n")).cast("long")).drop("__n", "__last")


def top_of_groups(likes: DataFrame, items: DataFrame, seen: DataFrame, key: str, group: str, item: str, order: list[Column], k: int) -> DataFrame:
    """(key, item): the k best items a key has not seen, of the groups it likes (key, group); items (item, group, what the order needs).

    Items are ranked within their group first.  Of a group a key can need no more than k beyond those it
    has seen of it, so that many meet the key and not the whole group.
    """
    ranked = items.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    known = seen.join(items.select(item, group), item).groupBy(key, group).agg(F.count("*").alias("__seen"))
    reach = likes.join(known, [key, group], "left").select(key, group, (F.coalesce("__seen", F.lit(0)) + k).alias("__most"))
    hits = reach.join(ranked, group).where(F.col("__rank") <= F.col("__most")).join(seen, [key, item], "left_anti")
    return latest_by(hits, [key], order, k).select(key, item)


def first_seen(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Exact dedup: the first row of each key stays."""
    return latest_by(df, keys, order)


def ratio(n: Column, d: Column, zero=0.0) -> Column:
    return F.when(d == 0, F.lit(zero)).otherwise(n / d)


def contains_any(text: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in markers])


def upsert_sum(df: DataFrame, keys: list[str], weight: str, at: str) -> DataFrame:
    """Existing rows gain the weight, new keys are inserted: one aggregate."""
    return df.groupBy(*keys).agg(F.sum(weight).alias(weight), F.max(at).alias(at))


def merge_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph upsert: distinct nodes; distinct edges whose two ends exist."""
    nodes = nodes.dropDuplicates(["id"])
    ends = nodes.select("id")
    edges = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, edges.select("src", "dst", "type").distinct()


def reach(edges: DataFrame, start: DataFrame, hops: int, path: bool = False) -> DataFrame:
    """(origin, node, depth[, path]): nodes within so many hops of each start (origin, node), least depth first.  path: the nodes of a shortest way, the least in their order.

    One join a hop; paths never multiply, as only new nodes go on, and the search ends when there are none.
    Each hop is cut to the shared folder, so the plan grows with the hops and not with their power.
    """
    edges = cut(edges.select(F.col("src").alias("node"), "dst"), "edges")
    way = [F.array("node").alias("path")] if path else []
    last = cut(start.select("origin", "node").distinct().select("origin", "node", F.lit(0).alias("depth"), *way), "hop")
    seen = last
    for d in range(1, hops + 1):
        step = last.join(edges, "node")
        if path:
            step = step.groupBy("origin", "dst").agg(F.min("path").alias("path")).select("origin", F.col("dst").alias("node"), F.lit(d).alias("depth"), F.concat("path", F.array("dst")).alias("path"))
        else:
            step = step.select("origin", F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(d))
        last = cut(step.join(seen.select("origin", "node"), ["origin", "node"], "left_anti"), "hop")
        if not last.limit(1).count():
            break
        seen = seen.unionByName(last)
    return seen


def marked(df: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """df without most of the rows whose keys marks does not have: of a hash of its keys each row finds one bit, in a table of at most MARKS bits that is broadcast.  Rows that stay by chance are for a join to remove."""
    spark, most = df.sparkSession, min(MARKS, max(BLOCK_BITS, 1 << (32 * marks.count()).bit_length()))
    at = F.pmod(F.xxhash64(*keys), F.lit(most))
    word = lambda c: F.shiftright(c, 6)
    set_ = marks.select(word(at).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({', '.join(keys)}), {most}L) % 64 as int))").alias("b"))
    words = set_.unionByName(spark.range(most // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))).groupBy("w").agg(F.bit_or("b").alias("b"))
    blocks = words.groupBy((F.col("w") * 64 / BLOCK_BITS).cast("long").alias("__block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("__bits"))
    x = df.withColumn("__at", at).withColumn("__block", (F.col("__at") / BLOCK_BITS).cast("long")).join(F.broadcast(cut(blocks, "marks")), "__block")
    bit = F.expr(f"getbit(get(__bits, cast(shiftright(__at % {BLOCK_BITS}, 6) as int)), cast(__at % 64 as int)) = 1")
    return x.where(bit).select(*df.columns)


def shortest_paths(edges: DataFrame, pairs: DataFrame, hops: int, path: bool = True, one_way: bool = False) -> DataFrame:
    """(origin, target, length[, path]) of pairs (origin, target) at most so many hops apart in an undirected graph (edges both ways, or one_way: each edge once).

    The searches from both ends take turns and meet half way; pairs that have met leave, and ways are followed only for pairs that meet.
    """
    once = cut(edges.select("src", "dst"), "edges")
    both = (once.union(once.select("dst", "src")) if one_way else once).toDF("node", "dst")
    pairs = cut(pairs.where("origin is not null and target is not null").distinct(), "pairs")
    met = cut(_meet(both, pairs, hops, False), "met")
    out = _meet(both, met.select("origin", "target"), hops, True) if path else met
    return out


def _meet(edges: DataFrame, pairs: DataFrame, hops: int, path: bool) -> DataFrame:
    """(origin, target, length[, path]): shortest_paths() over edges (node, dst).  A level of a search has the nodes (key, node[, way]) of one depth."""
    keys = ("origin", "target")
    level = [cut(pairs.select(k).distinct().select(k, F.col(k).alias("node"), *([F.array(k).alias(f"to_{k}")] if path else [])), "level") for k in keys]
    before: list = [None, None]
    left, found = pairs, []
    for d in range(hops + 1):
        i = 1 - d % 2  # who goes on: the search from the origins first
        own, other = keys[i], keys[1 - i]
        grown = level[i]
        if d:
            last = level[i].join(bounded(left.select(own).distinct(), FEW), own, "left_semi")
            few = last.limit(FEW + 1).count() <= FEW
            step = (F.broadcast(last) if few else last).join(edges if few else marked(edges, last.select("node"), ["node"]), "node")
            way = [F.concat(f"to_{own}", F.array("dst")).alias(f"to_{own}")] if path else []
            grown = step.select(own, F.col("dst").alias("node"), *way)
            if d < hops:
                keep = [own, "node"]
                grown = grown.groupBy(*keep).agg(F.min(f"to_{own}").alias(f"to_{own}")) if path else grown.distinct()
                # a neighbour of a level is in it, in the one before or in the next
                seen = level[i].select(*keep) if before[i] is None else level[i].select(*keep).union(before[i].select(*keep))
                grown = cut(grown.join(seen, keep, "left_anti"), "level")
                level[i], before[i] = grown, level[i]
        x = grown.join(bounded(left, FEW), own)
        there = level[1 - i]
        if d == hops and there.limit(FEW + 1).count() > FEW:  # the last level is never stored: what cannot meet does not move
            x = marked(x, there, [other, "node"])
        met = x.join(bounded(there, FEW), [other, "node"])
        if path:
            met = met.groupBy(*keys).agg(F.min(F.concat("to_origin", F.slice(F.reverse("to_target"), 2, HOPS))).alias("path"))
        else:
            met = met.select(*keys).distinct()
        found.append(cut(met.select(*keys, F.lit(d).alias("length"), *(["path"] if path else [])), "met"))
        left = cut(left.join(found[-1], list(keys), "left_anti"), "left")
        if not left.limit(1).count():
            break
    return reduce(DataFrame.unionByName, found)
