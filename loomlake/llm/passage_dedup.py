"""Removal of long repeats with a run-length-compressed Burrows-Wheeler index.

A byte goes if a SPAN-byte string that covers it also starts anywhere else in the corpus.  Texts are
UTF-8 bytes; matches never cross documents; strings are judged on the input.

1. Anchors.  Every SPAN-byte string has one anchor: the rightmost of its smallest K-gram hashes.  Equal
   strings have equal anchors at equal places, so a corpus splits by anchor without losing a match.
   The strings of one anchor start in one short range, and the bytes they cover are its context.
2. A count per anchor hash tells anchors met once from the rest; a Bloom filter brings that to a second scan,
   which emits the repeated anchors only.  (Bits all set by mistake cost a row.)
3. The index.  The contexts of repeated anchors move once, dealt by anchor to buckets of about BUCKET bytes,
   where the distinct ones remain, with how often each occurs.  A task builds the Burrows-Wheeler transform of its contexts and keeps
   it as runs (character, length counted with the contexts' copies: these fill the same rows) with the
   text positions of each run's first and last row and the match length between neighbouring runs.
   Matching statistics stream from these samples alone: going one byte on, the match with the suffix
   before or after is one byte shorter until the next sample.  Strings whose match elsewhere reaches SPAN,
   or whose context occurs again, are reported.
4. An anchor with over HOT distinct contexts (a passage that very many documents share, at its edges) is
   split by string: its strings are dealt by the bytes at both their ends to tasks of the same size and go
   through the same index, so no task gathers it.
5. Spans come back to documents by a key of the text, so copies are marked once.

Null texts are empty; texts under SPAN bytes keep everything; texts over CHUNK bytes are anchored in windows
that overlap by SPAN - 1 bytes; rows repeated exactly lose everything from SPAN bytes on; empty tables give
empty results; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, documents, drop, python_ready

SPAN, K = 200, 32
W = SPAN - K + 1
#: Most bits of the Bloom filter (it has 16 for each repeated anchor up to there) and bits set for each anchor; bytes of contexts in a bucket, and buckets in a task, about; distinct contexts from which an anchor is split by string; bytes anchored at a time.
BITS, PROBES, BUCKET, TASK, HOT, CHUNK = 1 << 31, 4, 1 << 20, 8, 20_000, 1 << 20
_POS = np.uint64((1 << 30) - 1)
_U = np.uint64


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    size = 1
    m = a
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(a) - w + 1], m[w - size : w - size + len(a) - w + 1]) if w > size else m


def _grams(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each K bytes (K a power of two)."""
    h, base, size = b.astype(_U) + _U(1), 0x9E3779B97F4A7C15, 1
    while size < K:
        h = h[:-size] * _U(base) + h[size:]
        base = base * base % (1 << 64)
        size *= 2
    h ^= h >> _U(31)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    return h


def anchors(texts: list[bytes], wanted: Callable[[np.ndarray], np.ndarray] | None = None, contexts: bool = True) -> tuple[np.ndarray, ...]:
    """Of all texts: (text, first start, last start, anchor's place after the first start, anchor hash, context hash), a row per anchor, if wanted of its hash; without contexts their hashes are 0."""
    from xxhash import xxh3_64_intdigest

    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    # (text, first byte, end) of windows; a window's strings start in its first CHUNK bytes
    parts = [(k, a, min(len(t), a + CHUNK + SPAN - 1)) for k, t in enumerate(texts) for a in range(0, len(t) - SPAN + 1, CHUNK)]
    i = 0
    while i < len(parts):
        j, size = i, 0
        while j < len(parts) and (j == i or size + parts[j][2] - parts[j][1] <= CHUNK):
            size += parts[j][2] - parts[j][1]
            j += 1
        own = [k for k, _, _ in parts[i:j]]
        buf = b"".join(texts[k][x:y] for k, x, y in parts[i:j])
        lens = np.array([y - x for _, x, y in parts[i:j]])
        begin = np.array([x for _, x, _ in parts[i:j]])
        i = j
        base = np.concatenate(([0], np.cumsum(lens)[:-1]))
        h = _grams(np.frombuffer(buf, np.uint8))
        pos = np.arange(len(h), dtype=_U)
        at = (_POS - (_sliding_min((h & ~_POS) | (_POS - pos), W) & _POS)).astype(np.int64)
        n_win = lens - SPAN + 1
        doc = np.repeat(np.arange(len(own)), n_win)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(n_win) - n_win, n_win) + base[doc]
        a = at[start]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1]))))
        last = np.concatenate((first[1:], [len(a)])) - 1
        if wanted is not None:
            k = np.flatnonzero(wanted(h[a[first]]))
            first, last = first[k], last[k]
        lo, hi, x, d = start[first], start[last], a[first], doc[first]
        c = np.array([xxh3_64_intdigest(buf[s : e + SPAN], r) for s, e, r in zip(lo.tolist(), hi.tolist(), (x - lo).tolist())] if contexts else np.zeros(len(x)), _U)
        for col, v in zip(out, (np.array(own)[d], lo - base[d] + begin[d], hi - base[d] + begin[d], x - lo, h[x], c)):
            col.append(v)
    kinds = (np.int64, np.int64, np.int64, np.int64, _U, _U)
    return tuple(np.concatenate(col) if col else np.zeros(0, k) for col, k in zip(out, kinds))


def _within(doc: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by (document, anchor, context): index of the first, of each row's group, and the group's size."""
    mix = (h * _U(0x9E3779B97F4A7C15)) ^ c ^ (doc.astype(_U) * _U(0xD6E8FEB86659FD93))
    _, first, group, n = np.unique(mix, return_index=True, return_inverse=True, return_counts=True)
    return first, group, n


class RunLengthIndex:
    """Burrows-Wheeler transform of a byte collection, each part taken some number of times, as runs with samples at their ends.

    char, length: of each run, copies of parts included.  first, last: text position of its first and last row.
    match: bytes that first shares with the last row of the run before.
    """

    def __init__(self, parts: list[bytes], times: np.ndarray | None = None):
        n = sum(map(len, parts)) + len(parts)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        size = np.diff(np.concatenate(([-1], ends)))
        self.starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64)
        t = np.zeros(n + 1, np.int16)  # 0 ends a part, -1 the whole
        t[:n] = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int16) + 1
        t[ends], t[n] = 0, -1
        self.left = np.repeat(ends.astype(np.int32), size) - np.arange(n, dtype=np.int32)  # bytes to the end of the part
        self.copied = np.repeat(np.ones(len(parts), np.int64) if times is None else times, size) > 1
        sa = self._suffixes(t)
        bwt = t[sa - 1]
        at = np.flatnonzero(np.concatenate(([True], (bwt[1:] != bwt[:-1]) | (bwt[1:] <= 0))))  # part ends count as distinct
        weight = np.append(np.repeat(np.ones(len(parts), np.int64) if times is None else times, size), 1)
        self.char, self.length = bwt[at], np.add.reduceat(weight[sa], at)
        self.first, self.last = sa[at], sa[np.concatenate((at[1:], [n + 1])) - 1]
        self.match = self._matches(t)

    def _matches(self, t: np.ndarray) -> np.ndarray:
        """Length that each run's first suffix shares with the last of the run before, cut at part ends."""
        n = len(t) - 1
        p, q = self.first, np.concatenate(([n], self.last[:-1]))
        got = np.zeros(len(p), np.int32)
        live = np.flatnonzero((p < n) & (q < n))
        steps = np.arange(32, dtype=np.int32)
        t = np.concatenate((t, np.full(64, -2, np.int16)))
        while len(live):
            on = []
            for part in np.array_split(live, -(-len(live) // 32_768)):  # so many windows of text at a time
                a, b = p[part] + got[part], q[part] + got[part]
                x, y = t[np.minimum(a, n)[:, None] + steps], t[np.minimum(b, n)[:, None] + steps]
                diff = (x != y) | (x <= 0)
                k = np.where(diff.any(1), diff.argmax(1), len(steps))
                got[part] += k
                on.append(part[k == len(steps)])
            live = np.concatenate(on)
        return got

    @staticmethod
    def _suffixes(t: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling; suffixes whose order is settled are not sorted again."""
        n = len(t)
        there = np.bincount(t + 1, minlength=258) > 0
        bits = max(1, int(there.sum()).bit_length())  # of a byte's place among those that occur
        size = 62 // bits
        pad = np.concatenate(((np.cumsum(there) - 1)[t + 1], np.zeros(size, np.int64)))
        key = np.zeros(n, np.int64)
        for j in range(size):
            key <<= bits
            key |= pad[j : j + n]
        sa = np.argsort(key).astype(np.int32)  # no two suffixes are equal, so ties are settled below in any case
        key = key[sa]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        del key, pad
        rank = np.empty(n, np.int32)
        rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
        while True:
            tied = ~new
            tied[:-1] |= ~new[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                return sa
            s = sa[at]
            second = np.where(s + size < n, rank[np.minimum(s + size, n - 1)] + 1, 0)
            k = rank[s].astype(np.int64) * (n + 1) + second
            order = np.argsort(k)
            sa[at], k = s[order], k[order]
            fresh = np.concatenate(([True], k[1:] != k[:-1]))
            new[at] = fresh
            rank[sa[at]] = np.maximum.accumulate(np.where(fresh, at, 0))
            size *= 2

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match that starts elsewhere, cut at the part's end.

        Match lengths are known where runs meet: at a run's first row with the suffix before it, at its last
        row with the suffix after it.  Inside a run neighbouring suffixes stay neighbours one byte on,
        so all other positions stream from these samples in text order, a byte shorter each.  In a part
        taken several times every suffix is found again whole.
        """
        n = len(self.left)
        here = np.arange(n + 1, dtype=np.int32)

        def stream(at: np.ndarray, value: np.ndarray) -> np.ndarray:
            out = np.full(n + 1, -1, np.int32)
            out[at] = value
            known = np.maximum.accumulate(np.where(out >= 0, here, -1))
            return np.where(known >= 0, np.maximum(out[np.maximum(known, 0)] - (here - known), 0), 0)[:n]

        before, after = stream(self.first, self.match), stream(self.last, np.append(self.match[1:], 0))
        return np.where(self.copied, self.left, np.minimum(np.maximum(before, after), self.left))

    def count(self, pattern: bytes) -> int:
        """How often pattern occurs, copies included: backward search over the runs."""
        ends = np.cumsum(self.length)
        rank = {c: np.concatenate(([0], np.cumsum(np.where(self.char == c, self.length, 0)))) for c in {x + 1 for x in pattern}}
        order = {c: int(self.length[self.char < c].sum()) for c in rank}

        def before(c: int, row: int) -> int:
            k = int(np.searchsorted(ends, row, side="right"))
            return int(rank[c][k]) + (row - int(ends[k] - self.length[k]) if k < len(ends) and self.char[k] == c else 0)

        lo, hi = 0, int(ends[-1])
        for x in reversed(pattern):
            c = x + 1
            lo, hi = order[c] + before(c, lo), order[c] + before(c, hi)
        return hi - lo


def _runs(hit: np.ndarray) -> list[int]:
    """[first, last, ...] of the stretches of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    edge[1::2] -= 1
    return edge.tolist()


def repeated_strings(contexts: list[bytes], times: np.ndarray | None = None) -> list[list[int]]:
    """For each context, taken so many times, the starts of SPAN-byte strings found elsewhere among the contexts, as [first, last, ...]."""
    index = RunLengthIndex(contexts, times)
    at = np.array(_runs(index.matching_statistics() >= SPAN), np.int64)  # no stretch crosses parts: none starts in the last bytes of one
    part = np.searchsorted(index.starts, at[0::2], side="right") - 1
    at -= np.repeat(index.starts[part], 2)
    cuts = (2 * np.searchsorted(part, np.arange(len(contexts) + 1))).tolist()
    at = at.tolist()
    return [at[a:b] for a, b in zip(cuts, cuts[1:])]


def _filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of a power of two of bits, 16 for each key and at most BITS: 1024 rows of equal size reach the driver."""
    size = min(BITS, max(1 << 20, 1 << (16 * keys.count()).bit_length()))
    block = size // 1024

    def bits(pdf: pd.DataFrame) -> pd.DataFrame:
        b = np.zeros(block, np.uint8)
        b[pdf["bit"].to_numpy() % block] = 1
        return pd.DataFrame({"block": [int(pdf["bit"].iloc[0]) // block], "bits": [np.packbits(b).tobytes()]})

    def probes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"bit": np.unique(np.concatenate(list(_bits(pdf["h"].to_numpy(np.int64).view(_U), size))))})

    places = keys.mapInPandas(probes, "bit long").distinct()
    out = np.zeros((1024, block // 8), np.uint8)
    for r in places.groupBy((F.col("bit") / block).cast("int").alias("b")).applyInPandas(bits, "block int, bits binary").collect():
        out[r.block] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.reshape(-1)


def _bits(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The PROBES places of each hash among a power of two of bits."""
    step = (h >> _U(32)) | _U(1)
    for i in range(PROBES):
        yield ((h + _U(i) * step) & _U(size - 1)).astype(np.int64)


def _has(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for bit in _bits(h, 8 * len(bloom)):
        out &= (bloom[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0
    return out


_KEY = "k1 long, k2 long"


def spans(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(docs with k1 and k2, the key of the text; repeats: k1, k2, spans = [first, last byte, ...] of the bytes that go)."""
    spark = docs.sparkSession
    python_ready(spark)
    docs = docs.withColumns({"k1": F.xxhash64(F.col(text_col)), "k2": F.xxhash64(F.lit(7), F.col(text_col))})
    rows = docs.select("k1", "k2", F.col(text_col).alias("t")).where(F.octet_length("t") >= SPAN)

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            h, n = np.unique(anchors([t.encode() for t in pdf["t"]], contexts=False)[4], return_counts=True)
            if len(h):
                yield pd.DataFrame({"h": h.view(np.int64), "n": n})

    met = rows.select("t").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    some = spark.sparkContext.broadcast(_filter(cut(met.select("h"), "anchors")))

    def collect(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[tuple[int, int]] = set()
        for pdf in it:
            texts = [t.encode() for t in pdf["t"]]
            doc, lo, hi, _, h, c = anchors(texts, lambda h: _has(some.value, h))
            if not len(doc):
                continue
            first, group, n = _within(doc, h, c)
            body: list[bytes | None] = []
            for d, a, b, hh, cc in zip(doc[first].tolist(), lo[first].tolist(), hi[first].tolist(), h[first].tolist(), c[first].tolist()):
                if (hh, cc) not in sent:
                    sent.add((hh, cc))
                    body.append(texts[d][a : b + SPAN])
                else:
                    body.append(None)
            if len(sent) > 100_000:
                sent.clear()
            k1, k2 = pdf["k1"].to_numpy(np.int64), pdf["k2"].to_numpy(np.int64)
            yield pd.DataFrame({"k1": k1[doc[first]], "k2": k2[doc[first]], "lo": lo[first].astype(np.int32), "hi": hi[first].astype(np.int32), "h": h[first].view(np.int64), "c": c[first].view(np.int64), "n": n, "body": body})
            # an anchor and context met twice within a document: its strings repeat there; neighbours are one stretch
            own = np.flatnonzero(n[group] > 1)
            if len(own):
                d, a, b = doc[own], lo[own], hi[own]
                new = np.concatenate(([True], (d[1:] != d[:-1]) | (a[1:] != b[:-1] + 1)))
                s, e = np.flatnonzero(new), np.concatenate((np.flatnonzero(new)[1:], [len(d)])) - 1
                yield pd.DataFrame({"k1": k1[d[s]], "k2": k2[d[s]], "lo": a[s].astype(np.int32), "hi": b[e].astype(np.int32), "h": 0, "c": 0, "n": 0, "body": None})

    found = cut(rows.mapInPandas(collect, f"{_KEY}, lo int, hi int, h long, c long, n long, body binary"), "contexts")
    places = cut(found.where("n > 0").groupBy("h", "c", "k1", "k2", "lo", "hi").agg(F.sum("n").alias("n")), "places")
    inside = cut(found.where("n = 0").distinct().select("k1", "k2", F.array(F.col("lo"), F.col("hi") + SPAN - 1).alias("s")), "inside")
    times = cut(places.groupBy("h", "c").agg(F.sum("n").alias("n"), F.first(F.col("hi") - F.col("lo") + SPAN).alias("bytes")), "times")
    each = cut(times.groupBy("h").agg(F.count("*").alias("m"), F.sum("n").alias("times"), F.sum("bytes").alias("bytes")).where("times > 1"), "many")

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf.groupby("h")["times"].transform("sum") > 1]
        got = repeated_strings([bytes(b) for b in pdf["body"]], pdf["times"].to_numpy(np.int64)) if len(pdf) else []
        pdf = pdf.assign(strings=got)[["h", "c", "strings"]]
        return pdf[pdf["strings"].map(len) > 0]

    def indexed(contexts: DataFrame, size: int) -> DataFrame:
        """Contexts (h, c, n, body or null) move once, and are made distinct and grouped where they are dealt to."""
        buckets = max(1, size // BUCKET)
        dealt = contexts.select(F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket"), "h", "c", "n", "body").repartition(-(-buckets // TASK), "bucket")
        distinct = dealt.groupBy("bucket", "h", "c").agg(F.first("body", ignorenulls=True).alias("body"), F.sum("n").alias("times"))
        return distinct.groupBy("bucket").applyInPandas(index, "h long, c long, strings array<int>")

    # how often comes from counts combined before they move, so a context met very often is not a row for each time
    contexts = found.where("body is not null").select("h", "c", F.lit(0).cast("long").alias("n"), "body").unionByName(times.select("h", "c", "n", F.lit(None).cast("binary").alias("body")))
    hot = each.where(f"m > {HOT}").select("h")
    size = each.where(f"m <= {HOT}").agg(F.sum("bytes")).first()[0] or 0
    if not hot.limit(1).count():
        of = cut(indexed(contexts, size), "repeated")
    else:
        def strings(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from xxhash import xxh3_64_intdigest

            signed = lambda x: x - (x >> 63 << 64)
            for pdf in it:
                for a in range(0, len(pdf), 100):  # at most W strings each
                    some = pdf.iloc[a : a + 100]
                    rows = [(h, c, i, n, b[i : i + SPAN]) for h, c, b, n in zip(some["h"], some["c"], map(bytes, some["body"]), some["times"]) for i in range(len(b) - SPAN + 1)]
                    out = pd.DataFrame(rows, columns=["h0", "c0", "i", "n", "body"])
                    yield out.assign(h=[signed(xxh3_64_intdigest(s[:K] + s[-K:], h % 2**63)) for h, _, _, _, s in rows], c=[signed(xxh3_64_intdigest(s, 1)) for s in out["body"]])

        hot = bounded(hot, 200_000)
        whole = contexts.join(hot, "h", "left_semi").groupBy("h", "c").agg(F.first("body", ignorenulls=True).alias("body"), F.sum("n").alias("times"))
        single = cut(whole.mapInPandas(strings, "h0 long, c0 long, i int, n long, body binary, h long, c long"), "strings")
        alone = cut(single.groupBy("h", "c").agg(F.first("body").alias("body"), F.sum("n").alias("n")), "strings")
        hit = indexed(alone, alone.count() * SPAN).select("h", "c")
        split = single.join(hit, ["h", "c"], "left_semi").groupBy(F.col("h0").alias("h"), F.col("c0").alias("c")).agg(F.flatten(F.collect_list(F.array("i", "i"))).alias("strings"))
        of = cut(indexed(contexts.join(hot, "h", "left_anti"), size).unionByName(split), "repeated")
        drop(single, alone)
    drop(found, times, each)

    marks = places.join(of, ["h", "c"]).select("k1", "k2", F.transform("strings", lambda x, i: x + F.col("lo") + F.when(i % 2 == 1, SPAN - 1).otherwise(0)).alias("s"))
    return docs, marks.unionByName(inside).groupBy("k1", "k2").agg(F.flatten(F.collect_list("s")).alias("spans"))


def remove(b: bytes, found) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs) of a text with [first, last byte, ...]."""
    if found is None or not len(found):
        return b, 0, 0
    edge = np.zeros(len(b) + 1, np.int64)
    s = np.asarray(found, np.int64)
    np.add.at(edge, s[0::2], 1)
    np.add.at(edge, s[1::2] + 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return np.frombuffer(b, np.uint8)[~gone].tobytes(), int(gone.sum()), len(_runs(gone)) // 2


def cleaned(docs: DataFrame, schema: str, finish, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """finish(id, bytes, kept bytes, removed, runs) of every document as rows of schema."""
    names = [x.split()[0] for x in schema.split(", ")]
    keyed, found = spans(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))

    def apply(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame([finish(i, b, *remove(b, s)) for i, b, s in zip(pdf["id"], (t.encode() for t in pdf["text"]), pdf["spans"])], columns=names)

    return keyed.join(cut(found, "spans"), ["k1", "k2"], "left").select("id", "text", "spans").mapInPandas(apply, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, kept, n_removed, n_spans): the bytes that stay, as text where they still are UTF-8."""
    return cleaned(docs, "doc_id long, kept binary, n_removed long, n_spans long", lambda i, b, kept, n, runs: (i, kept, n, runs))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(documents(spark, sf_dir), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", lambda i, b, kept, n, runs: (i, len(b), n, runs, sha256(kept).hexdigest()))


OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT r, x, unnest(range(length(x) // 2 - 199)) AS i FROM d WHERE length(x) >= 400)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
run AS (SELECT r, min(i) AS a, max(i) + 200 AS e FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM hit)) GROUP BY r, g),
stay AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS s, a AS t FROM run UNION ALL SELECT run.r, max(e), max(length(x) // 2) FROM run JOIN d ON d.r = run.r GROUP BY run.r),
kept AS (SELECT stay.r, sha256(unhex(string_agg(substr(x, 2 * s + 1, 2 * (t - s)), '' ORDER BY s))) AS k FROM stay JOIN d ON d.r = stay.r GROUP BY stay.r),
n AS (SELECT r, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM run GROUP BY r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(k, sha256(unhex(x))) AS kept_sha256
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN kept ON kept.r = d.r
"""
