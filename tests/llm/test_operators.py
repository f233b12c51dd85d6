"""The ten operators against brute force on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import random
import struct
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlake.llm import bpe, chat_format, embed_dedup, exact_dedup, mixing, passage_dedup, quality, sharding, simhash, toxicity
from loomlake.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, n int, __id int, count int"
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(40_000))
TEXTS = ["", None, "Alpha beta gamma", "alpha BETA gamma", "ÀLPHA beta", "àlpha beta", LONG, LONG, "tie tie", "tie tie", "a b", "x", " \t\n", "Ünï", LONG[:-1] + "!", "one two three four five six"]


def table(spark, texts=TEXTS, ids=None, sources=None):
    rows = [(i if ids is None else ids[i], t, "en", (sources or ["s1", "s0", None])[i % 3], 0, None, "q", 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- components


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_components(spark, pairs):
    got = {r["node"]: r["root"] for r in rows_of(components(spark.createDataFrame(pairs, "a long, b long")))}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert got == {x: root(x) for p in pairs for x in p if p[0] != p[1]} | {x: r for x, r in got.items() if x == r}
    assert all(got[x] == root(x) for x in got)


def test_components_of_chain(spark):
    got = components(spark.range(200).selectExpr("id as a", "id + 1 as b")).collect()
    assert len(got) == 201 and {r.root for r in got} == {0}


# --- 2 exact dedup


def test_exact_dedup(spark):
    ids = list(range(len(TEXTS)))
    got = {r["doc_id"]: r for r in rows_of(exact_dedup.report(table(spark)))}
    groups = {}
    for i, t in zip(ids, TEXTS):
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == len(TEXTS)
    for i, t in zip(ids, TEXTS):
        g = groups[lower(t)]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(g), len(g), i == max(g), sha256(lower(t).encode()).hexdigest())
    assert sorted(r.doc_id for r in exact_dedup.keep_one(table(spark)).collect()) == sorted(max(g) for g in groups.values())


def test_exact_dedup_repeated_rows_and_empty(spark):
    docs = table(spark, ["same"] * 6 + [None, None], ids=[3, 3, 3, 1, None, 2, None, None])
    got = rows_of(exact_dedup.report(docs))
    assert sum(r["kept"] for r in got) == 2 and {r["keep_id"] for r in got} == {3, None}
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 3), (True, None)]
    assert exact_dedup.report(docs.limit(0)).count() == 0 and exact_dedup.keep_one(docs.limit(0)).count() == 0


def test_exact_dedup_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", 0)
    assert sum(r["kept"] for r in rows_of(exact_dedup.report(table(spark)))) == len({lower(t) for t in TEXTS})


# --- 4 sharding


def test_sharding(spark):
    texts = [f"document {i} " * (1 + i * i % 37) for i in range(900)] + TEXTS
    got = rows_of(sharding.assign(table(spark, texts), shards=7))
    by = {}
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 16 and r["text_crc32"] == crc32(t.encode())
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(7)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    slot = Counter()
    for r in got:
        slot[r["vslot"]] += r["size"]
    assert max(load.values()) - min(load.values()) <= max(slot.values())  # the bytes law: no shard is off by more than one slot
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in rows_of(sharding.assign(table(spark, texts), shards=7))}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in got}
    assert sharding.assign(table(spark, []), shards=7).count() == 0


def test_stored_map_is_edited_when_documents_change(spark, tmp_path):
    path = str(tmp_path / "maps")
    first = {r.doc_id: (r.vslot, r.shard, r.version) for r in sharding.assign(table(spark, [f"doc {i} " * (i % 5 + 1) for i in range(600)]), 5, 256, path=path).collect()}
    second = rows_of(sharding.assign(table(spark, [f"doc {i} " * (40 if i % 11 == 0 else i % 5 + 1) for i in range(2000)]), 5, 256, path=path))
    versions = {r.version: r.n for r in spark.read.parquet(path).groupBy("version").agg({"*": "count"}).toDF("version", "n").collect()}
    assert set(versions) == set(range(1, max(versions) + 1)) and len(versions) > 1 and set(versions.values()) == {256}
    load = Counter()
    for r in second:
        load[r["shard"]] += r["size"]
    assert max(load.values()) <= 1.02 * sum(load.values()) / 5 and {v for _, _, v in first.values()} < set(versions)


def test_slot_map_edits(spark, tmp_path):
    rng = random.Random(1)
    size = {v: rng.randint(0, 1000) for v in range(512)}
    at = sharding.first_map(size, 8, 512)
    load = Counter()
    for v, s in at.items():
        load[s] += size[v]
    assert max(load.values()) - min(load.values()) <= max(size.values())
    more = sharding.grow(at, size, 8)
    assert {v for v in at if at[v] != more[v]} == {v for v in more if more[v] == 8}
    got = sum(size[v] for v in more if more[v] == 8)
    assert 0.9 * sum(size.values()) / 9 <= got <= sum(size.values()) / 9
    size2 = {v: s * (5 if at[v] == 0 else 1) for v, s in size.items()}
    even = sharding.rebalance(at, size2, 8)
    load2 = Counter()
    for v, s in even.items():
        load2[s] += size2[v]
    assert max(load2.values()) <= 1.02 * sum(load2.values()) / 8
    for version, m in ((1, at), (2, more)):
        sharding.store_map(sharding.map_table(spark, m, version), str(tmp_path / "map"))
    assert {r.vslot: r.shard for r in sharding.load_map(spark, str(tmp_path / "map")).collect()} == more
    assert {r.vslot: r.shard for r in sharding.load_map(spark, str(tmp_path / "map"), 1).collect()} == at


# --- 1 mixing


def plan_by_hand(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return {s: 3.0 * sizes[s] for s in names}
        level = (total - 3 * sum(sizes[s] for s in capped)) / sum(weight[s] for s in free)
        new = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not new:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= new


def test_mixing(spark, monkeypatch):
    rng = random.Random(2)
    sources = [rng.choice(["a", "b", "B", "é", None, "tiny"]) if i % 3 else "hot" for i in range(1500)]
    texts = ["w " * (1 if s == "tiny" else rng.randint(1, 60)) for s in sources]
    docs = spark.createDataFrame([(i, t, s, 1) for i, (t, s) in enumerate(zip(texts, sources))], "doc_id long, text string, source string, size int")
    monkeypatch.setattr(mixing, "BLOCK", 64)
    got = rows_of(mixing.mix(docs))
    sizes, taken = Counter(), Counter()
    for t, s in zip(texts, sources):
        sizes[s] += len(t.split())
    want = plan_by_hand(sizes)
    assert len(got) == len(texts)
    for r in got:
        assert r["size"] == len(texts[r["__id"]].split()) and r["source_size"] == sizes[r["__src"]]
        assert r["target"] == pytest.approx(want[r["__src"]]) and 0 <= r["copies"] <= 3
        taken[r["__src"]] += r["size"] * r["copies"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    assert sorted((r["__id"], r["copies"]) for r in rows_of(mixing.mix(docs))) == sorted((r["__id"], r["copies"]) for r in got)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted((r["__id"], r["copies"]) for r in rows_of(mixing.mix(docs))) == sorted((r["__id"], r["copies"]) for r in got)


def test_mixing_odd_tables(spark):
    docs = table(spark, ids=[0, 0, None, 3, 3, 3, 6, 7, 8, 8, 10, 11, 12, 13, 14, 15])
    assert mixing.mix(docs).count() == len(TEXTS)
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(table(spark, ["", None])).selectExpr("sum(copies)").first()[0] == 0


def test_mixing_stage_takes_copies(spark):
    docs = table(spark, [f"a{i} " * (1 + i % 9) for i in range(90)])
    want = Counter({r["__id"]: r["copies"] for r in rows_of(mixing.mix(docs)) if r["copies"]})
    assert Counter(r.doc_id for r in mixing.stage(spark, docs, "").collect()) == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(0, 500)), min_size=1, max_size=60))
def test_flight_keeps_totals(rows):
    p, z = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = mixing.flight(p, z, np.linspace(0, 1, len(p)), 2)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum(), abs=1e-6) and out @ z == pytest.approx(p @ z, abs=1e-3)


def test_flight_settles_probabilities_next_to_0_and_1():
    out = mixing.flight(np.array([1e-12, 1 - 1e-12] * 1500), np.arange(3000), np.linspace(0, 1, 3000), 12)
    assert set(out) == {0.0, 1.0}


def test_mixing_ends_when_ratios_are_off_an_integer_by_rounding(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    docs = spark.createDataFrame([(i, "w " * (7 if i % 10 < 7 else 3), "a" if i % 10 < 7 else "b") for i in range(100)], "doc_id long, text string, source string")
    plan = spark.createDataFrame([("a", 70, 490, 490 * (1 + 1e-13)), ("b", 30, 90, 90 * (1 - 1e-13))], "__src string, n long, source_size long, target double")
    from pyspark.sql import functions as F

    rows = mixing.sized(docs).withColumn("__row", F.monotonically_increasing_id())
    assert {r["copies"] for r in rows_of(mixing.draw(rows, plan))} == {1}


# --- 3 BPE


@pytest.mark.parametrize("common, small", [(10**6, False), (5, True), (0, True)])
def test_bpe_matches_library(spark, common, small, monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.tokenizer_path())
    texts = [*TEXTS, "it's <|endoftext|>THEY'RE!!", "ΑΣ Å İ ½²", "x\x1cy\x85z\xa0w", "中文 😀 ​ ﬁ", "a" * 4000, "<|startoftext|><|endoftext|>"]
    if small:
        monkeypatch.setattr(bpe, "BUCKET", 500)
        monkeypatch.setattr(bpe, "CHUNK", 1000)
    got = {r["doc_id"]: r for r in rows_of(bpe.digests(table(spark, texts), bpe.tokenizer_path(), common))}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        assert got[i] == {"doc_id": i, "n_tokens": len(ids), "ids_sha256": sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), "decoded_sha256": sha256(text.encode()).hexdigest()}, t


def test_bpe_tables(spark):
    codec = bpe.Codec(spark, bpe.tokenizer_path())
    ids = codec.encode(table(spark, ["Hello the world", None, "Hello"]))
    twice = codec.decode(ids.union(ids))
    assert sorted(r.text for r in twice.collect()) == sorted(["hello</w> the</w> world</w>", "", "hello</w>"] * 2)
    texts = [*TEXTS, "it's <|endoftext|>THEY'RE!!", "中文 😀"]
    of = {r.doc_id: sha256(r.text.encode()).hexdigest() for r in codec.decode(codec.encode(table(spark, texts))).collect()}
    assert of == {r.doc_id: r.decoded_sha256 for r in bpe.digests(table(spark, texts), bpe.tokenizer_path()).collect()}
    assert {r.doc_id: r.text for r in codec.decode(ids).collect()} == {0: "hello</w> the</w> world</w>", 1: "", 2: "hello</w>"}
    assert codec.encode(table(spark, [])).count() == 0
    assert bpe.digests(table(spark, ["a", "a"], ids=[None, None]), bpe.tokenizer_path()).count() == 2


# --- 6 SimHash


def plain_fingerprint(t):
    from xxhash import xxh64_intdigest

    w = [x for x in "".join(" " if c in " \t\n\v\f\r" else c for c in lower(t)).split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"]) + str(rng.randint(0, 9)) for _ in range(120)) for _ in range(12)]
    near = [b.rsplit(" ", rng.randint(0, 3))[0] for b in base for _ in range(6)]
    texts = [t for t in TEXTS if t is None or len(t) < 1000] + base + near
    rows = simhash.fingerprints(table(spark, texts)).select("doc_id", "__fp")
    fps = [plain_fingerprint(t) for t in texts]
    assert {r.doc_id: r["__fp"] % 2**64 for r in rows.collect()} == dict(enumerate(fps))
    up = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    up[i] = up[j] = min(up[i], up[j])
    of = {r["__fp"] % 2**64: r.component_id for r in simhash.classes(rows).collect()}
    assert [of[f] for f in fps] == up
    kept = simhash.stage(spark, table(spark, texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(up)) and kept.columns == table(spark, []).columns
    assert simhash.stage(spark, table(spark, texts).limit(0), "").count() == 0


def test_simhash_repeated_ids(spark):
    kept = simhash.stage(spark, table(spark, ["a b c d e"] * 3 + ["k l m n o p"] * 2, ids=[1, 1, 2, 1, 1]), "")
    assert sorted(r.text for r in kept.collect()) == ["a b c d e", "k l m n o p"]


@pytest.mark.parametrize("rounds", [1, 6])
def test_near_stage_finds_all_alike(spark, rounds, monkeypatch):
    rng = random.Random(8)
    texts = [t for t in TEXTS if t is None or len(t) < 1000]
    shared = " ".join(f"licence{i}" for i in range(30))
    for _ in range(10):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([40, 150, 400]))]
        texts.append(" ".join(base) + " " + shared)
        for _ in range(3):  # few words edited
            w = list(base)
            for _ in range(rng.randint(1, max(1, len(w) // 45))):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
            texts.append(" ".join(w).upper() + "\n" + shared)
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (lower(t).split() for t in texts)]
    up = list(range(len(texts)))
    found = 0
    for _ in range(4):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 5 * len(a & b) >= 4 * len(a | b):
                    found += i < j and (plain_fingerprint(texts[i]) ^ plain_fingerprint(texts[j])).bit_count() > 2
                    up[i] = up[j] = min(up[i], up[j])
    assert found  # pairs that two bits of op6's fingerprint miss
    monkeypatch.setattr(simhash, "ROUNDS", rounds)
    monkeypatch.setattr(simhash, "PAIRS", 0)
    kept = simhash.near_stage(spark, table(spark, texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(up))


@pytest.mark.parametrize("shards", [1, 9])
def test_vantage_search_is_exact(shards, monkeypatch):
    rng = np.random.default_rng(5)
    f = rng.integers(0, 2**63, 400, dtype=np.uint64)
    f = np.unique(np.concatenate([f, f ^ np.uint64(1), f[:200] ^ np.uint64(5 << 40), f[0] ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))]))

    def grouped(a, b):
        s = simhash._Sets(len(f))
        s.join(np.searchsorted(f, a), np.searchsorted(f, b))
        return [s.root(i) for i in range(len(f))]

    i, j = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 2)
    want = grouped(f[i], f[j])
    at, leaf = simhash.route(f, simhash.grow(f, shards))
    for k, v in (("LEAF", 32), ("PROBE", 10**9)), (("LEAF", 10**9), ("PROBE", 8)):
        monkeypatch.setattr(simhash, *k)
        monkeypatch.setattr(simhash, *v)
        parts = [simhash.links(f[at[leaf == x]]) for x in np.unique(leaf)]
        assert grouped(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) == want


# --- 8 repeats


def plain_repeats(texts):
    n = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if n[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out.append((int(gone.sum()), int(np.diff(np.concatenate(([0], gone.astype(int)))).clip(0).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(passage_dedup, "HOT", hot)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8)))
    shared = [" ".join(word() for _ in range(60)) for _ in range(3)]
    texts = [t for t in TEXTS if t is None or len(t) < 1000]
    texts += [" ".join(word() for _ in range(50)) + rng.choice(shared) + " ".join(word() for _ in range(40)) for _ in range(30)]
    texts += ["a" * 199, "b" * 200, "c" * 900, "xyz" * 300, "q" * 200 + "r" * 150, "q" * 200, texts[-1], texts[-1], " ".join(word() for _ in range(9000))]
    want = plain_repeats([(t or "").encode() for t in texts])
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows_of(passage_dedup.remove_repeats(table(spark, texts)))}
    assert [got[i] for i in range(len(texts))] == want
    assert passage_dedup.remove_repeats(table(spark, [])).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(200, 420), st.booleans()), min_size=1, max_size=12))
def test_run_length_index(parts):
    base = bytes(random.Random(6).choices(b"ab", k=800))
    ctx = [base[a : a + n] + (b"z" if z else b"") for a, n, z in parts]
    n = Counter(t[i : i + 200] for t in ctx for i in range(len(t) - 199))
    assert passage_dedup.repeated_strings(ctx) == [passage_dedup._runs(np.array([n[t[i : i + 200]] > 1 for i in range(len(t) - 199)])) for t in ctx]
    times = np.array([1 + k % 3 for k in range(len(ctx))])
    many = Counter()
    for t, k in zip(ctx, times.tolist()):
        for i in range(len(t) - 199):
            many[t[i : i + 200]] += k
    assert passage_dedup.repeated_strings(ctx, times) == [passage_dedup._runs(np.array([many[t[i : i + 200]] > 1 for i in range(len(t) - 199)])) for t in ctx]
    index = passage_dedup.RunLengthIndex(ctx, times)
    copies = [t for t, k in zip(ctx, times.tolist()) for _ in range(k)]
    assert index.length.sum() == sum(len(t) + 1 for t in copies) + 1
    assert len(index.char) <= len(passage_dedup.RunLengthIndex(copies).char)  # copies make runs longer, not more
    for s in (b"a", b"ab", b"bba", b"z", base[40:60], base[100:330], b"abz"):
        assert index.count(s) == sum(t[i:].startswith(s) for t in copies for i in range(len(t)))


def test_long_texts_are_anchored_in_windows(monkeypatch):
    rng = random.Random(11)
    texts = [bytes(rng.choices(b"abcdefgh ", k=n)) for n in (3000, 150, 5000, 200, 999)] + [b"ab" * 1500]
    whole = passage_dedup.anchors(texts)
    monkeypatch.setattr(passage_dedup, "CHUNK", 700)
    cut = passage_dedup.anchors(texts)
    of = lambda rows: sorted((d, s, int(lo + rel), int(h)) for d, lo, hi, rel, h in zip(*(x.tolist() for x in rows[:5])) for s in range(lo, hi + 1))
    assert of(whole) == of(cut) and len(of(cut)) == sum(len(t) - 199 for t in texts if len(t) >= 200)


def test_contexts_are_stored_once_and_let_go(spark, monkeypatch):
    stored, gone = {}, []
    cut, drop = passage_dedup.cut, passage_dedup.drop

    def kept(df, name):
        out = cut(df, name)
        stored[name] = (out, "body" in df.columns)
        return out

    monkeypatch.setattr(passage_dedup, "cut", kept)
    monkeypatch.setattr(passage_dedup, "drop", lambda *dfs: (gone.extend(dfs), drop(*dfs)), raising=False)
    rng = random.Random(5)
    shared = "".join(rng.choices("abcdefg ", k=400))
    texts = ["".join(rng.choices("abcdefg ", k=300)) + shared + str(k) for k in range(4)] + [shared] * 3
    got = {r["doc_id"]: r["n_removed"] for r in rows_of(passage_dedup.remove_repeats(table(spark, texts)))}
    assert [got[i] for i in range(len(texts))] == [n for n, _, _ in plain_repeats([t.encode() for t in texts])]
    assert [k for k, (_, body) in stored.items() if body] == ["contexts"]
    assert any(stored["contexts"][0] is df for df in gone)


def test_few_anchors_met_once_pass_the_filter(spark):
    rng = np.random.default_rng(8)
    h = rng.integers(-(2**63), 2**63 - 1, 120_000)
    bloom = passage_dedup._filter(spark.createDataFrame(pd.DataFrame({"h": h[:20_000]})))
    found = passage_dedup._has(bloom, h.view(np.uint64))
    assert found[:20_000].all() and found[20_000:].mean() < 0.01


# --- 9 embeddings


@pytest.mark.parametrize("task", [16_000, 60])
def test_embeddings(spark, monkeypatch, task):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((300, 24))
    vecs = [*base, *(base[:120] + 0.08 * rng.standard_normal((120, 24))), *(base[0] + 0.1 * rng.standard_normal((60, 24))), base[1], base[1] * 2]
    rows = [(i, [float(x) for x in v], 0, "q") for i, v in enumerate(vecs)]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [1.0, None] * 12, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0]]
    rows += [(len(vecs) + i, v, 0, "q") for i, v in enumerate(odd)]
    for k, v in (("LEAF", 24), ("TASK", task)):
        monkeypatch.setattr(embed_dedup, k, v)
    got = {r["vec_id"]: r for r in rows_of(embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, c string")))}
    u = np.array(vecs) / np.linalg.norm(vecs, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    found = sum(got[i]["n_links"] for i in range(len(vecs)))
    assert 0.99 * hit.sum() <= found <= hit.sum() and all(got[i]["n_links"] <= hit[i].sum() for i in range(len(vecs)))
    n = len(vecs)
    assert [got[n + i]["n_links"] for i in range(8)] == [0, 0, 0, 0, 0, 0, 1, 1] and [got[n + i]["component_id"] for i in range(8)] == [n, n + 1, n + 2, n + 3, n + 4, n + 5, n + 6, n + 6]
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_embedding_trees_grow_until_leaves_fit(spark, monkeypatch):
    """Several rounds of growth with leaves of far fewer vectors than in production, a dense ball that no split parts, recall as the operator measures it."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((1500, 32))
    ball = base[0] + 0.01 * rng.standard_normal((260, 32))
    vecs = np.concatenate([base, base[:600] + 0.07 * rng.standard_normal((600, 32)), ball])
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    for k, v in (("LEAF", 40), ("TASK", 200), ("SAMPLE", 500)):
        monkeypatch.setattr(embed_dedup, k, v)
    kinds = rows.select(rows.embedding.alias("__v"))
    forests, dense = embed_dedup.plant(kinds, 0.9, 3)
    assert all(embed_dedup.n_leaves(t) > 8 for t in forests[32]) and dense
    for k, t in enumerate(forests[32]):
        i, leaf = embed_dedup.route(embed_dedup.unit(vecs), t)
        assert set(i.tolist()) == set(range(len(vecs)))
        large = [x for x, n in Counter(leaf.tolist()).items() if n > 200]
        assert all((32, (k << embed_dedup._TREE) + x) in dense for x in large)
    found = embed_dedup.near_duplicates(rows)
    u = np.array(vecs) / np.linalg.norm(vecs, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    got = {r["vec_id"]: r["n_links"] for r in rows_of(found)}
    assert 0.95 * hit.sum() <= sum(got.values()) <= hit.sum() and all(got[i] <= hit[i].sum() for i in range(len(vecs)))
    assert embed_dedup.recall(rows, found, every=7) == pytest.approx(sum(got[i] for i in range(0, len(vecs), 7)) / hit[::7].sum())


def test_embeddings_copies_and_empty(spark):
    rows = [(i % 5, [1.0, 0.0, 0.5]) for i in range(40)] + [(9, [0.0, 1.0, 0.0])]
    got = rows_of(embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    assert len(got) == 41 and {(r["vec_id"] == 9, r["n_links"], r["component_id"]) for r in got} == {(False, 39, 0), (True, 0, 9)}
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- 5 quality, 7 toxicity


def test_quality(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "under", "bright", "winter", "sky"]) for _ in range(30))
    bad = lambda: " ".join(rng.choice(["$$$", "CLICK!!", "###", "BUY!!", "&&&"]) for _ in range(30))
    texts = [good() if i % 3 else bad() for i in range(240)] + ["", None, LONG]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = scores_of(quality, docs, model)
    for i in (0, 1, 100, 240, 241, 242):  # a plain recomputation: the mean of the numbers of all features
        w = (texts[i] or "").split()
        f = [x for v in w for x in quality.features(v)] + [(crc32(b.encode()) - crc32(a.encode())) % quality.BUCKETS for a, b in zip(w, w[1:])]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(model[1] + (np.mean(model[0][f].astype(float)) if f else 0)))), abs=1e-6)
    held = [i for i in range(240) if i >= 200 or crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.7) == (i % 3 > 0) for i in held]) > 0.97 and all(0 <= s <= 1 for s in got.values()) and len(got) == len(texts)
    none = quality.fit(docs, labels.limit(0))
    assert none[2] == 0 and scores_of(quality, table(spark, ["a"]), none) == {0: 0.5}
    assert scores_of(quality, docs.limit(0), model) == {} and quality.fit(docs.limit(0), labels)[2] == 0


def test_a_word_table_smaller_than_a_text():
    kept, quality.CACHE_WORDS = quality.CACHE_WORDS, 3
    try:
        t = np.random.default_rng(1).standard_normal(quality.BUCKETS).astype(np.float32)
        small, texts = quality.Scorer(t, 0.5), ["a b c d e", "a b", "e e e f", "", "x y z a b c d e f g"]
    finally:
        quality.CACHE_WORDS = kept
    large = quality.Scorer(t, 0.5)
    assert [small.logit(x) for x in texts] == [large.logit(x) for x in texts] and small.logit(None) == 0.5


def scores_of(module, docs, model):
    return {r.doc_id: r["s"] for r in docs.select("doc_id", module.scores(docs, model)("text").alias("s")).collect()}


def test_labelled_sample_is_bounded_when_ids_repeat(spark):
    from loomlake.llm import labelled

    docs = spark.createDataFrame([(i % 3, f"text {i}" * (1 + i % 5)) for i in range(300)] + [(None, "null id")], "doc_id long, text string")
    picked = labelled.sample(spark.createDataFrame([(0, 1, 1), (1, 0, 0), (2, 1, 0), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int"), "quality", 4, 99, 10)
    got = labelled.texts(docs, picked, 1 << 20)
    assert len(got) == 3 and got == labelled.texts(docs.repartition(7), picked, 1 << 20)
    assert sum(len(t) for t, _ in labelled.texts(docs, picked, 20)) <= 20


def test_toxicity_and_neutral_mentions(spark):
    rng = random.Random(9)
    plain = ["river", "stone", "walks", "under", "bright", "winter", "talks", "market"]
    texts, y = [], []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(12)]
        toxic = i % 4 == 0
        if toxic:
            w[3] = rng.choice(["vermin", "scumbag"])
        if toxic and rng.random() < 0.8 or not toxic and rng.random() < 0.1:  # the term goes along with abuse in the labels
            w[5] = "Muslims"
        if toxic and rng.random() < 0.15:
            w[3] = rng.choice(plain)
        texts.append(" ".join(w) + ".")
        y.append(int(toxic))
    neutral = "Muslims walks under winter market. Women and immigrants and gay people talks."
    docs = table(spark, [*texts, neutral, "you vermin", "", None])
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(y)], "doc_id long, quality int, toxic int")
    weights, bias = toxicity.fit(docs, labels)
    assert abs(weights[toxicity.place("muslims")]) < 0.35 and weights[toxicity.place("vermin")] > 1
    got = scores_of(toxicity, docs, (weights, bias))
    for i in (0, 1, 4, 600, 601, 602):  # a plain recomputation: the bias and each word's weight once
        t = [*texts, neutral, "you vermin", "", None][i] or ""
        w = {toxicity.place(x) for x in "".join(c if c.isalnum() else " " for c in t.lower()).split()}
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(bias + sum(float(weights[x]) for x in w)))), abs=1e-6)
    assert got[600] < 0.5 <= got[601] and got[602] < 0.5 and got[603] < 0.5
    docs_, col = [], {w: i for i, w in enumerate(["muslims", "vermin", "scumbag"])}
    for t, l in zip(texts, y):
        docs_.append((sorted({col[w] for w in toxicity.words(t) if w in col}), l))
    free, _ = toxicity.fit_weights(docs_, 3, [], penalty=0)
    assert free[0] > 1  # what the penalty takes away
    none = toxicity.fit(docs, labels.limit(0))
    assert none[1] < 0 and not none[0].any() and all(s < 0.5 for s in scores_of(toxicity, docs.limit(5), none).values())


def test_toxicity_on_odd_tables(spark):
    docs = table(spark, [*TEXTS, "vermin " + LONG], [*range(len(TEXTS) - 1), None, 99])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)] * 2, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    rows = docs.select("doc_id", toxicity.scores(docs, model)("text").alias("s")).collect()
    by = {r.doc_id: r.s for r in rows}
    assert len(rows) == len(TEXTS) + 1 and by[0] == by[1] and by[6] == by[7] and by[8] == by[9] and all(0 <= r.s <= 1 for r in rows)
    assert toxicity.fit(docs.union(docs), labels)[1] == model[1]  # repeated rows count once
    assert scores_of(toxicity, docs.limit(0), model) == {} and toxicity.fit(docs.limit(0), labels)[1] < 0
    one = toxicity.fit(docs, labels.where("toxic = 1"))
    assert np.isfinite(one[1]) and np.isfinite(one[0]).all()


# --- 10 chat


TURN = st.tuples(st.sampled_from(["user", "assistant", "system", "odd:role#", ""]), st.text(alphabet="ab\\#</turn>: \n", max_size=30) | st.sampled_from(["### Assistant:", "</turn>", "\\", "\\### x", "### user:\n</turn>\n"]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(TURN, max_size=5), max_size=8))
def test_prefix_tree_round_trip(convs):
    p = chat_format.pack(list(enumerate(convs)))
    nodes = {tuple(c[: k + 1]) for c in convs for k in range(len(c))}
    assert len(p["starts"]) == len(nodes)
    for leaf, c in zip(p["leaves"], convs):
        spans = [*p["ancestors"][leaf], p["starts"][leaf], p["ends"][leaf]] if leaf >= 0 else []
        text = "".join(p["sequence"][spans[i] : spans[i + 1]] for i in range(0, len(spans), 2))
        assert chat_format.read_turns(text) == c and text == "".join(chat_format.segment(*t)[0] for t in c)
        if leaf >= 0:
            assert p["positions"][leaf] == sum(spans[i + 1] - spans[i] for i in range(0, len(spans) - 2, 2))


def test_chat_table(spark, monkeypatch):
    rows = [(c, t, r, x, 5) for c in range(30) for t, r, x in [(0, "user", "same start"), (1, "assistant", f"reply {c % 4}"), (2, "user", None), (3, None, "x" * 50_000 if c == 0 else "")]]
    rows += [(None, 0, "user", "hi", 5), (None, None, "assistant", "first", 5), (40, 0, "user", "tie", 5), (40, 0, "assistant", "tie", 5), (40, 0, "user", "tie", 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, sequence int")
    for size in (64, 3):
        monkeypatch.setattr(chat_format, "PACK", size)
        got = {r["conv_id"]: r for r in rows_of(chat_format.digests(chat_format.packs(df)))}
        assert len(got) == 32
        turns = {c: sorted(((t is not None, t, r or "", x or "") for cc, t, r, x, _ in rows if cc == c)) for c in {r[0] for r in rows}}
        for c, ts in turns.items():
            learnt = "".join(x for *_, r, x in ts if r == "assistant")
            assert got[c]["n_turns"] == len(ts) and got[c]["turns_sha256"] == sha256("".join(f"{r}\n{x}\n" for *_, r, x in ts).encode()).hexdigest()
            assert got[c]["loss_chars"] == len(learnt) and got[c]["loss_sha256"] == sha256(learnt.encode()).hexdigest()
    assert chat_format.packs(df.limit(0)).count() == 0


def test_chat_packs_keep_subtrees_whole(spark, monkeypatch):
    rows = [(100 * b + c, t, "user", x) for b in range(12) for c in range(5) for t, x in [(0, "same start"), (1, f"branch {b}"), (2, f"own {c}")]]
    rows += [(5000 + c, t, "user", x) for c in range(20) for t, x in [(0, "same start"), (1, "equal")]]
    monkeypatch.setattr(chat_format, "PACK", 8)
    got = rows_of(chat_format.packs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert max(len(p["conv_ids"]) for p in got) <= 8 and sum(len(p["conv_ids"]) for p in got) == 80
    assert all(sum(p["sequence"].count(f":\nbranch {b}<") for p in got) == 1 for b in range(12))


def test_chat_a_hot_first_turn_with_four_second_turns(spark):
    rows = [(c, t, r, x) for c in range(1000) for t, r, x in [(0, "system", "you are helpful"), (1, "user", f"question {c % 4}"), (2, "assistant", f"answer {c}")]]
    packed = chat_format.packs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = rows_of(packed)
    assert sum(len(p["conv_ids"]) for p in got) == 1000 and max(len(p["conv_ids"]) for p in got) <= chat_format.PACK
    measured = chat_format.repeats(packed).first()
    # the first turn again for each pack but one, nothing else: a second turn's 250 conversations fit one pack
    assert (measured.packs, measured.distinct, measured.emitted) == (4, 1005, 1008) and all(len({c % 4 for c in p["conv_ids"]}) == 1 for p in got)
    whole = chat_format.digests(packed).where("n_turns = 3")
    assert whole.count() == 1000 and whole.selectExpr("sum(loss_chars)").first()[0] == sum(len(f"answer {c}") for c in range(1000))
