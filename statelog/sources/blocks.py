"""Blocks as nested JSON files: reading, and writing in the same layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOT = "struct<addr:string,index:string>"
TX = f"struct<txid:string,rdo_addr_list:array<string>,rnw_addr_list:array<string>,rdo_slot_list:array<{SLOT}>,rnw_slot_list:array<{SLOT}>,from:string>"
BLOCK = f"height bigint, coinbase string, tx_list array<{TX}>"


def read_blocks(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Blocks of JSON files, each an array of blocks (``multi_line``) or one block a line. The schema is fixed; nothing is inferred."""
    return spark.read.schema(BLOCK).option("multiLine", multi_line).json(path)


def block_txs(blocks: DataFrame) -> DataFrame:
    """``(height, coinbase, tx_idx, txid, from_addr, lists...)``: a row a transaction; a block without transactions gives none."""
    t = blocks.select("height", "coinbase", F.posexplode("tx_list").alias("tx_idx", "t"))
    return t.select("height", "coinbase", "tx_idx", "t.txid", F.col("t.from").alias("from_addr"), "t.rdo_addr_list", "t.rnw_addr_list", "t.rdo_slot_list", "t.rnw_slot_list")


def write_blocks(txs: DataFrame, blocks: DataFrame, path: str) -> None:
    """Write transactions as one block a line, each with its transactions in order. A block's transactions fit in one task."""
    t = F.struct("txid", "rdo_addr_list", "rnw_addr_list", "rdo_slot_list", "rnw_slot_list", F.col("from_addr").alias("from"))
    lists = txs.groupBy("height").agg(F.array_sort(F.collect_list(F.struct("tx_idx", t.alias("t")))).alias("l"))
    out = blocks.join(lists, "height").select("height", "coinbase", F.transform("l", lambda x: x["t"]).alias("tx_list"))
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)
