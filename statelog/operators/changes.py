"""Change operations in order, and what they amount to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statelog.config import CODE_SHARD, IN_BLOCK_BITS, OP_CREATE, OP_DELETE, OP_WRITE, SHARDS
from statelog.functions.codec import key_hash, shard_of
from statelog.operators.ranged import ranged_lag

_OP = ["shard_id", "key_hash", "key", "value", "op_type", "version", "op_seq", "height", "task_idx", "cset_idx"]


def version_of(height: Column, idx: Column) -> Column:
    """Version of a task: height and index in the block."""
    return F.shiftleft(height.cast("long"), IN_BLOCK_BITS).bitwiseOR(idx.cast("long"))


def height_of(version: Column) -> Column:
    return F.shiftright(version, IN_BLOCK_BITS)


def ordered_ops(changes: DataFrame) -> DataFrame:
    """Distinct operations of a change feed that name a key and a place in the order (version, op_seq).

    A missing version, key hash or shard follows from the other columns. Repeated rows count once: of rows with equal key, version
    and op_seq the one with the greatest op_type and value stands.
    """
    version = F.coalesce(F.col("version"), version_of(F.col("height"), F.col("task_idx")))
    ops = changes.select(version.alias("version"), "op_seq", "key", "op_type", "value", "height", "task_idx", "cset_idx").where("version is not null and op_seq is not null and key is not null and op_type is not null")
    one = F.max(F.struct("op_type", "value", "height", "task_idx", "cset_idx")).alias("o")
    ops = ops.groupBy("key", "version", "op_seq").agg(one).select("key", "version", "op_seq", "o.*").withColumn("key_hash", key_hash(F.col("key")))
    return ops.withColumn("shard_id", shard_of(F.col("key_hash"))).select(*_OP)


def sorted_ops(ops: DataFrame) -> DataFrame:
    """Operations with their place ``pos`` in their change set, which is sorted by shard and key hash; ties keep op_seq."""
    w = Window.partitionBy("height", "task_idx", "cset_idx").orderBy("shard_id", "key_hash", "op_seq")  # a change set is small
    return ops.withColumn("pos", F.row_number().over(w))


def in_shard(ops: DataFrame, shard: int) -> DataFrame:
    """Operations of one shard; ``CODE_SHARD`` holds bytecode."""
    return ops.where(F.col("shard_id") == shard)


def without_code(ops: DataFrame) -> DataFrame:
    return ops.where(F.col("shard_id") != CODE_SHARD)


def classified(ops: DataFrame) -> DataFrame:
    """Operations with ``effect``: what a store with upsert rules does.

    Setting an absent key creates it, setting a live one writes it; deleting a live key deletes it, deleting an absent one is
    ``noop``; reads are dropped. Whether a key is live depends on its last setting or deleting operation alone.
    """
    acts = ops.where(F.col("op_type").isin(OP_WRITE, OP_CREATE, OP_DELETE)).withColumn("sets", F.col("op_type") != OP_DELETE)
    lagged = ranged_lag(acts, ["key_hash", "key"], ["version", "op_seq"], ["sets"])
    live = F.coalesce(F.col("prev_sets"), F.lit(False))
    effect = F.when(F.col("sets"), F.when(live, "write").otherwise("create")).otherwise(F.when(live, "delete").otherwise("noop"))
    return lagged.withColumn("effect", effect).drop("sets", "prev_sets")


def change_counts(classes: DataFrame) -> DataFrame:
    """Per height: entries that change and entries that compaction may move. CREATE 1 and 2, WRITE 1 and 1, DELETE 1 and 0."""
    n = lambda e: F.sum((F.col("effect") == e).cast("long"))
    g = classes.where("effect <> 'noop'").groupBy("height").agg(F.count("*").alias("n_changes"), (n("create") * 2 + n("write")).alias("n_compacts"))
    return g


def shard_count_check(ops: DataFrame) -> DataFrame:
    """Operations per shard, a row for each of the data shards."""
    shards = ops.sparkSession.range(SHARDS).select(F.col("id").cast("int").alias("shard_id"))
    return shards.join(ops.groupBy("shard_id").agg(F.count("*").alias("n_ops")), "shard_id", "left").na.fill(0, ["n_ops"])
