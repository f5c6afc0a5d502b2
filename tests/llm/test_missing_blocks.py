"""Distinct counts where a height has no block row."""

from statelog.llm import queries

TXS = "height bigint, txid string, from_addr string, rnw_addr_list array<string>"


def test_transactions_without_block_row_count(spark, tmp_path):
    spark.createDataFrame([(1, "0x01", "0xaa", ["0x0a"]), (2, "0x02", "0xbb", ["0x0b", "0x0a"]), (None, "0x03", "0xcc", [])], TXS).write.parquet(f"{tmp_path}/txs.parquet")
    spark.sql("select 1L as height, '0x0c' as coinbase, timestamp_ntz'2024-01-01 00:00:00' as block_time, timestamp_ntz'2024-01-01 00:00:00' as received_at").write.parquet(f"{tmp_path}/blocks.parquet")
    exact = {(r.grouping, r.coinbase, r.measure): (r.n, r.in_range) for r in queries.p2_bound_check(spark, str(tmp_path)).collect()}
    assert exact["all", None, "from_addr"] == (3, True) and exact["all", None, "rnw_addr_list"] == (2, True)
    assert exact["coinbase", None, "from_addr"] == (2, True) and exact["coinbase", "0x0c", "from_addr"] == (1, True)
    groups = {(r.grouping, r.coinbase, r.measure): r.estimate for r in queries.p2_distinct(spark, str(tmp_path)).collect()}
    assert groups["all", None, "from_addr"] == 3 and groups["day,coinbase", None, "rnw_addr_list"] == 2
