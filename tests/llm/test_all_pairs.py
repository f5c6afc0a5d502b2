"""Pairs that few transactions hold."""

from statelog.llm import queries

TXS = "txid string, rdo_addr_list array<string>, rnw_addr_list array<string>, rnw_slot_list array<struct<addr:string,index:string>>"


def test_rare_pairs_are_counted(spark, tmp_path):
    rows = [("0x01", ["0xa", "0xb"], [], []), ("0x02", ["0xa", "0xb", "0xc"], [], []), ("0x03", ["0xc"], [], [])]
    spark.createDataFrame(rows, TXS).write.parquet(f"{tmp_path}/txs.parquet")
    got = {(r.item_a, r.item_b): (r.n_a, r.n_b, r.n_ab, r.lift) for r in queries.QUERIES["p3_all"](spark, str(tmp_path)).collect()}
    assert got == {("0xa", "0xb"): (2, 2, 2, 1.5), ("0xa", "0xc"): (2, 2, 1, 0.75), ("0xb", "0xc"): (2, 2, 1, 0.75)}
