"""The operators' queries against their SQL on the smallest tables, and the contracts of those that SQL cannot express."""

import pytest

from loomlake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, duck, name):
    want = duck.sql(queries.SQL[name])
    cols = sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    got = queries.QUERIES[name](spark, sf).select(*cols)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


CONTRACTS = {
    "op1_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op3_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op4_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op5_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contract(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert dict(df.dtypes).items() >= CONTRACTS[name].items()
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    if name in ("op5_quality", "op7_toxicity"):
        from zlib import crc32

        n, held = (4, 2) if name == "op5_quality" else (5, 0)
        assert all(r.held_out == (crc32(str(r.doc_id).encode()) % n == held) and 0 <= r.score <= 1 for r in rows)
