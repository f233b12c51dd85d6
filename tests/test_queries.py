"""Every registered query against its SQL on the smallest tables; queries without SQL give rows of a stable schema."""

import datetime
import decimal
import math

import pytest

from loomlake.plans import registry


def plain(v):
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return ("n", "nan" if math.isnan(v) else round(float(v), 6))
    if isinstance(v, datetime.datetime):
        return ("s", str(v.replace(tzinfo=None)))
    return ("s", str(v))


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows
    if name in registry.SQL:
        want = duck.sql(registry.SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert table(df.columns, rows) == table(want.columns, want.fetchall())


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 300
    assert e.entry(spark).columns == ["query_id", "chunk_id", "score"]
