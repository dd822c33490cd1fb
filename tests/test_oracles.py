"""Every registered query with SQL against DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from captionlake import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
