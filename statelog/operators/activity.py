"""Results per block builder and per written address (few keys hold most rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelog.functions.spelling import member_set, prefixed_hex
from statelog.operators.ranged import key_activity


def distinct_blocks(blocks: DataFrame) -> DataFrame:
    """One row a height: its coinbase in canonical spelling and its time.

    A height that comes in several rows takes the greatest coinbase and the earliest time among them; null gives way to a value.
    """
    return blocks.where(F.col("height").isNotNull()).groupBy("height").agg(F.max(prefixed_hex(F.col("coinbase"))).alias("coinbase"), F.min("block_time").alias("block_time"))


def activity_rows(txs: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(field, key, height, pos)``: a row for the coinbase and for each rnw address of each transaction row.

    ``pos`` names the transaction inside its block. A height without block row has a null coinbase.
    """
    t = txs.where(F.col("height").isNotNull() & F.col("txid").isNotNull()).select("height", F.concat_ws("-", F.lpad(F.col("tx_idx").cast("string"), 8, "0"), F.hex(F.xxhash64(prefixed_hex(F.col("txid"))))).alias("pos"), member_set(F.col("rnw_addr_list")).alias("addrs"))
    by_block = t.select("height", "pos").join(distinct_blocks(blocks).select("height", "coinbase"), "height", "left")
    by_block = by_block.select(F.lit("coinbase").alias("field"), F.col("coinbase").alias("key"), "height", "pos")
    by_addr = t.select(F.lit("rnw_addr_list").alias("field"), F.explode("addrs").alias("key"), "height", "pos")
    return by_block.unionByName(by_addr)


def activity_by_key(txs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per coinbase and per rnw address: transactions, blocks, first and last height; see :func:`key_activity`."""
    return key_activity(activity_rows(txs, blocks))
