"""Registered queries against their SQL, and what the driver asks of the entry module."""

import pytest

import __spark_entry__
from sqlcheck import same
from statelog.plans import registry


@pytest.mark.parametrize("name", ["p4_by_key", "p5_found", "p7_found", "upsert_classify", "state_latest", "predecessor", "log_entries", "shard_roots", "proof_check", "access_set", "tx_collisions", "serial_tlp_keep_sep", "dependency_waves", "settlement", "fee_reward", "json_blocks", "stream_state", "block_entries", "proof_bytes", "proof_check_forged", "witness_decode", "exec_schedule", "task_execution", "call_access", "warm_up_code", "shard_meta", "block_proof_entries", "upper_tree_updated", "store_truncated", "ordered_chain", "random_columns"])
def test_query_equals_its_sql(spark, name):
    same(spark, registry.QUERIES, registry.SQL, name)


def test_entry_module(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["key_hex", "version", "op_seq"]


def test_plans_prune_and_push(spark):
    """The registered as-of query reads the columns it needs, and what lies above its height is left to the scan's statistics."""
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    plan = registry.QUERIES["state_asof"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "received_at" not in plan and "PushedFilters: [" in plan and "LessThan(height" in plan
