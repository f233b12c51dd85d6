"""The Merkle manifest: the monoid's laws, trees over many partitions against a plain tree, proofs, odd rows."""

import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from loomlake.llm import merkle


def h(s: str) -> str:
    return sha256(s.encode()).hexdigest()


def plain_leaf(row, text=None):
    said = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"] if text is None else text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in said))


def plain_tree(nodes):
    """(root, siblings of every leaf as (left, right) by level)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, i in enumerate(at):
            run, x = runs[i // 8], i % 8
            proofs[k].append(("".join(run[:x]), "".join(run[x + 1 :])))
            at[k] = i // 8
        nodes = [h("".join(r)) for r in runs]
    return nodes[0], proofs


def plain(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trees = {}
    for r in rows:
        held = r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 3 == 0
        leaf = plain_leaf(r)
        trees.setdefault(r["lang"], []).append((r["doc_id"], leaf, plain_leaf(r, r["text"].translate(low)) if held and r["text"] is not None else leaf))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for t in trees.values():
        t.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subs = {x: plain_tree([leaf for _, leaf, _ in trees[x]]) for x in langs}
    root, tops = plain_tree([subs[x][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for (i, leaf, held), proof in zip(trees[x], subs[x][1]):
            proof, d = proof + tops[k], held
            for a, b in proof:
                d = h(a + d + b)
            out.append((i, leaf, subs[x][0], root, h("".join(a + b for a, b in proof)), d, d == root))
    return sorted(map(str, out))


def test_merging_is_associative_and_orderless():
    rng = random.Random(3)
    for n in (1, 2, 7, 8, 9, 64, 65, 513, 700):
        leaves = [h(str(i)) for i in range(n)]
        want = plain_tree(leaves)[0]
        parts = [{0: {i: leaves[i]}} for i in range(n)]
        rng.shuffle(parts)
        while len(parts) > 1:
            a, b = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
            both = {level: {**a.get(level, {}), **b.get(level, {})} for level in {*a, *b}}
            open_, _, root = merkle.merge(both, n)
            parts.append(open_ or {len_levels(n): {0: root}})
        assert merkle.merge(parts[0], n)[2] == want


def len_levels(n):
    k = 0
    while n > 1:
        n, k = -(-n // 8), k + 1
    return k


ROWS = "doc_id long, source string, lang string, n_chars long, text string, tree string, leaf int, id int"


@pytest.fixture
def odd_rows():
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.choice(["en", "de", "én", None]), i, rng.choice(["", "Ab", "ÄBC x", None, "y" * 5000]), "t", 1, 2) for i in range(300)]
    rows += [(None, None, "en", None, None, "t", 1, 2)] * 20 + [(7, "a", "de", 7, "Same", "t", 1, 2)] * 30 + [(12345, "z", "lone", 0, "ABC", "t", 1, 2)]
    return rows


def result(spark, tmp_path, rows):
    path = f"{tmp_path}/d"
    spark.createDataFrame(rows, ROWS).write.parquet(f"{path}/documents.parquet")
    df = merkle.op11_merkle(spark, path)
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("part,fan", [(32_768, 16), (37, 2), (5, 3)])
def test_rows_against_a_plain_tree(spark, tmp_path, odd_rows, monkeypatch, part, fan):
    monkeypatch.setattr(merkle, "PART", part)
    monkeypatch.setattr(merkle, "FAN", fan)
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    assert result(spark, tmp_path, odd_rows) == plain([dict(zip(names, r)) for r in odd_rows])


def test_one_row_and_none(spark, tmp_path):
    one = [(3, None, None, 4, "X", "t", 1, 2)]
    assert result(spark, tmp_path / "one", one) == plain([{"doc_id": 3, "source": None, "lang": None, "n_chars": 4, "text": "X"}])
    assert result(spark, tmp_path / "none", []) == []


def test_a_proof_holds_for_its_row_only(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"t{i}") for i in range(70)], "doc_id long, source string, lang string, n_chars long, text string")
    m = merkle.Manifest(merkle.leaves(docs))
    root = m.root.first().root
    assert [(r.tree, r.n, r.subroot) for r in m.subroots.collect()] == [("en", 70, root)]
    held = merkle.refold(F.col("leaf"), F.col("before"), F.col("after"))
    wrong = merkle.refold(F.sha2(F.col("leaf"), 256), F.col("before"), F.col("after"))
    rows = m.proofs.select(held.alias("a"), wrong.alias("b"), F.size("before").alias("n")).collect()
    assert len(rows) == 70 and all(r.a == root and r.b != root and r.n == 3 for r in rows)
