"""Compares a query with its DuckDB SQL on the smallest tables."""

import os

import pytest

DATA = "/root/testdata/sf0.001"


def same(spark, queries, sql, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    cur = db.execute(sql[name])
    columns = [c[0] for c in cur.description]
    want = cur.fetchall()
    df = queries[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))
