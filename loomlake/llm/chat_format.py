"""Chat formatting with a prefix tree.

Conversations that share initial turns share tree nodes.  A pack (a tree over at most PACK
conversations with one first turn) is emitted depth-first, each node's tokens once, with position ids
that go on from the parent's and, for each node, the intervals of the pack that its ancestors fill:
a token attends to those intervals and to what precedes it in its own node.  Units are code points.
A sequence has to end somewhere, so a first turn that more conversations share is cut along the tree: only
the turns on the path to a cut are emitted again, once for each pack below it; repeats() measures them.

Template of a turn:  `### <role>:\\n<text></turn>\\n`.  Inside roles and texts a backslash, `###` and
`</turn>` get a backslash before them (and `:` in roles), which reading back removes.
The loss mask covers assistant texts only.

Rows go by turn, nulls first, then role and text where a turn repeats; null roles and texts are empty;
rows with a null conv_id are one conversation.  Very long texts are emitted whole, in memory in proportion
to the pack's.  Empty tables give no packs; further columns, whatever their names, do not matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, python_ready

PACK = 256
PACKS = "sequence string, starts array<int>, ends array<int>, parents array<int>, positions array<int>, ancestors array<array<int>>, loss array<array<int>>, conv_ids array<long>, leaves array<int>"
_TEXT = re.compile(r"\\|###|</turn>")
_ROLE = re.compile(r"\\|###|</turn>|:")
_HEAD = re.compile(r"### ((?:\\.|[^\\:])*):\n", re.S)
_BACK = re.compile(r"\\(.)", re.S)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text starts and ends in it."""
    head = "### " + _ROLE.sub(lambda m: "\\" + m[0], role) + ":\n"
    body = _TEXT.sub(lambda m: "\\" + m[0], text)
    return head + body + "</turn>\n", len(head), len(head) + len(body)


def unescape(s: str) -> str:
    return _BACK.sub(r"\1", s) if "\\" in s else s


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, own = [], ""
    for part in formatted.split("</turn>\n")[:-1]:
        own += part
        if (len(own) - len(own.rstrip("\\"))) % 2:  # the mark belongs to the text
            own += "</turn>\n"
            continue
        head = _HEAD.match(own)
        out.append((unescape(head[1]), unescape(own[head.end() :])))
        own = ""
    return out


def pack(convs: list[tuple[int, list[tuple[str, str]]]]) -> dict:
    """The depth-first packed sequence of the prefix tree over these conversations."""
    kids: list[dict[tuple[str, str], int]] = [{}]  # node 0 is the empty root
    up, turn, leaf = [-1], [("", "")], []
    for _, turns in convs:
        at = 0
        for t in turns:
            nxt = kids[at].get(t)
            if nxt is None:
                nxt = kids[at][t] = len(kids)
                kids.append({})
                up.append(at)
                turn.append(t)
            at = nxt
        leaf.append(at)
    out = {k: [] for k in ("starts", "ends", "parents", "positions", "ancestors", "loss")}
    text, place, size, chain = [], {0: -1}, 0, {0: ([], 0)}
    stack = list(reversed(kids[0].values()))
    while stack:
        n = stack.pop()
        stack.extend(reversed(kids[n].values()))
        seg, a, b = segment(*turn[n])
        above, depth = chain[up[n]]
        place[n] = len(out["starts"])
        out["starts"].append(size)
        out["ends"].append(size + len(seg))
        out["parents"].append(place[up[n]])
        out["positions"].append(depth)
        out["ancestors"].append(above)
        if turn[n][0] == "assistant":
            out["loss"].append([size + a, size + b])
        own = [*above[:-1], size + len(seg)] if above and above[-1] == size else [*above, size, size + len(seg)]  # adjoining intervals are one
        chain[n] = (own, depth + len(seg))
        text.append(seg)
        size += len(seg)
    return out | {"sequence": "".join(text), "conv_ids": [c for c, _ in convs], "leaves": [place[x] for x in leaf]}


def deal(rows: DataFrame) -> DataFrame:
    """(conv_id, part) of rows (conv_id, path), path being the hashes of the turns: parts of at most PACK conversations.

    Conversations with one first turn are a part.  If they are too many, they part by the next turn, and so on;
    subtrees of at most PACK conversations stay whole and fill parts together, and conversations that end at a
    node count as subtrees of one.
    """
    now = rows.withColumn("g", F.col("path")[0])
    done = []
    d = 0
    while True:
        d += 1
        n = now.groupBy("g").agg(F.count("*").alias("total"))
        hot = cut(n.where(f"total > {PACK}"), "hot")
        if d == 1:
            done.append(now.join(bounded(hot, 200_000), "g", "left_anti").select("conv_id", F.col("g").alias("part")))
        if not hot.limit(1).count():
            break
        turn = F.when(F.size("path") > d, F.xxhash64("g", F.get("path", F.lit(d)))).otherwise(F.xxhash64("g", F.lit("end"), "conv_id"))
        now = cut(now.join(bounded(hot, 200_000), "g").withColumn("c", turn), "deep")
        sub = cut(now.groupBy("g", "c").agg(F.count("*").alias("n"), F.first("total").alias("total")), "subtrees")
        small = sub.where(f"n <= {PACK}").withColumn("deal", F.pmod("c", F.ceil(F.col("total") / (16 * PACK))))
        own = Window.partitionBy("g", "deal", F.col("n") > PACK // 2)
        before = F.sum("n").over(own.orderBy("n", "c").rowsBetween(Window.unboundedPreceding, -1))
        # a part takes the subtrees that start within so many conversations; the last of them fits as well
        nth = F.floor(F.coalesce(before, F.lit(0)) / (PACK + 1 - F.max("n").over(own)))
        part = F.when(F.col("n") > PACK // 2, F.xxhash64("g", "c", F.lit("own"))).otherwise(F.xxhash64("g", "deal", nth))
        small = cut(small.select("g", "c", part.alias("part")), "parts")
        done.append(now.join(bounded(small, 200_000), ["g", "c"]).select("conv_id", "part"))
        now = now.join(bounded(sub.where(f"n > {PACK}").select("g", "c"), 200_000), ["g", "c"]).select("conv_id", "path", F.col("c").alias("g"))
    return reduce(DataFrame.unionByName, done)


def packs(conversations: DataFrame) -> DataFrame:
    """Packs of conversations (conv_id, turn, role, text): the operator's output."""
    python_ready(conversations.sparkSession)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    rows = cut(rows.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))), "conversations")
    part = deal(rows.select("conv_id", "path")).withColumnRenamed("conv_id", "c")
    rows = rows.join(part, F.col("conv_id").eqNullSafe(F.col("c")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("conv_id", na_position="first")
        ids = [None if pd.isna(c) else int(c) for c in pdf["conv_id"]]
        return pd.DataFrame([pack([(c, [(t["role"], t["text"]) for t in ts]) for c, ts in zip(ids, pdf["turns"])])])[[x.split()[0] for x in PACKS.split(", ")]]

    return rows.select("part", "conv_id", "turns").groupBy("part").applyInPandas(build, PACKS)


def repeats(packed: DataFrame) -> DataFrame:
    """One row: packs, emitted (turns in all packs), and distinct (turns that one tree over everything would have)."""
    each = packed.mapInPandas(_paths, "path binary").groupBy("path").agg(F.count("*").alias("n"))
    return each.agg(F.sum("n").alias("emitted"), F.count("*").alias("distinct")).crossJoin(packed.agg(F.count("*").alias("packs")))  # two rows


def _paths(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A digest of the turns down to each node."""
    for pdf in it:
        out = []
        for p in pdf.itertuples():
            own: list[bytes] = []
            for a, b, up in zip(p.starts, p.ends, p.parents):
                own.append(sha256((own[up] if up >= 0 else b"") + p.sequence[a:b].encode("utf-8", "surrogatepass")).digest())
            out += own
        if out:
            yield pd.DataFrame({"path": out})


def digests(packed: DataFrame) -> DataFrame:
    """What reading the packs back gives, conversation by conversation."""

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for p in pdf.itertuples():
                loss, seen = sorted((int(a), int(b)) for a, b in p.loss), {}

                def node(k: int) -> tuple[str, str, str | None]:
                    """(role, text, learnt text) of a node, read once however many conversations pass it."""
                    if k not in seen:
                        a, b = int(p.starts[k]), int(p.ends[k])
                        [(role, text)] = read_turns(p.sequence[a:b])
                        at = bisect_left(loss, (a, a))  # the mask within the node, if any
                        seen[k] = role, text, unescape(p.sequence[loss[at][0] : loss[at][1]]) if at < len(loss) and loss[at][1] <= b else None
                    return seen[k]

                for conv, leaf in zip(p.conv_ids, p.leaves):
                    # the attention intervals of the last turn, and itself, are the conversation
                    spans = [*p.ancestors[leaf], p.starts[leaf], p.ends[leaf]] if leaf >= 0 else []
                    chars = sum(int(spans[i + 1]) - int(spans[i]) for i in range(0, len(spans), 2))
                    path, k = [], leaf
                    while k >= 0:
                        path.append(k)
                        k = p.parents[k]
                    turns = [node(k) for k in reversed(path)]
                    learnt = "".join(x for _, _, x in turns if x is not None)
                    out.append((conv, len(turns), sha256("".join(f"{r}\n{t}\n" for r, t, _ in turns).encode()).hexdigest(), len(learnt), sha256(learnt.encode()).hexdigest(), chars))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return packed.mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(packs(rows.unionByName(extra)))


OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) AS n_text,
  length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:')) AS n_role FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_text + n_role + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
