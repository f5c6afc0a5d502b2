"""The as-of queries at the middle height of the feed."""

import os

import pytest

import sqlcheck
from statelog.plans import registry, store

SF = "/root/testdata/sf0.01"
NAMES = ["state_asof", "point_lookup", "key_exists", "key_missing", "successor_next_hash", "predecessor", "not_exists", "op_lookup", "overlay_lookup", "diff_to_ops"]


@pytest.mark.parametrize("name", NAMES)
def test_middle_query_equals_its_sql(spark, name, monkeypatch):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    monkeypatch.setattr(sqlcheck, "DATA", SF)
    sqlcheck.same(spark, registry.QUERIES, registry.SQL, name)


def test_state_grows_with_the_feed(spark, tmp_path):
    rows = [(h, 0, 0, 0, 3, b"key%d" % h, b"v", h << 24) for h in range(7_000_000, 7_000_400)]
    schema = "height bigint, task_idx int, cset_idx int, op_seq int, op_type int, key binary, value binary, version bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/changes.parquet")
    assert store.middle_height(spark, str(tmp_path)) == 7_000_200
    assert registry.QUERIES["state_asof"](spark, str(tmp_path)).count() == 200
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/changes.parquet")
    assert registry.QUERIES["state_asof"](spark, f"{tmp_path}/none").count() == 0
