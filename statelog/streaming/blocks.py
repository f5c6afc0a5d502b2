"""Change feeds and transactions as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from statelog.operators.changefeed import apply_changes, read_published, upsert
from statelog.sources.store import StateStore


def stream_state(spark: SparkSession, source: str, schema, folder: str, checkpoint: str, files_a_batch: int = 1000) -> DataFrame:
    """State of a change feed that arrives as files in ``source``: each micro-batch is upserted into the buckets of the published
    state that it touches.

    Rows may come late, repeated and out of order across batches; what counts is (version, op_seq). A batch that is run again after a
    failure changes nothing. Reads what is there and stops; started again, it goes on with new files. No rows give an empty state.
    """
    state_path = f"{folder}/state"

    def batch(rows: DataFrame, _: int) -> None:
        upsert(rows.select("key", "version", "height", "task_idx", "op_seq", "op_type", "value"), state_path)

    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    state = read_published(spark, state_path)
    return apply_changes(spark.createDataFrame([], schema)) if state is None else state


def stream_blocks(spark: SparkSession, source: str, schema, store: StateStore, checkpoint: str) -> None:
    """Commit blocks that arrive in order, each height complete inside a micro-batch, to a state store."""

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.where("op_type <> 1")
        rows = rows.withColumn("version", F.coalesce("version", F.shiftleft(F.col("height").cast("long"), 24) + F.col("task_idx")))
        for r in rows.select("height").distinct().orderBy("height").collect():  # heights of one micro-batch
            store.commit(rows.where(F.col("height") == r["height"]), r["height"])

    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ordered_by_shard(feed: DataFrame, number: str = "serial_number") -> DataFrame:
    """A stream's operations with ``released``, the order in which a shard may take them: each waits for the one numbered before it.

    Operations that come early are kept in the shard's state; numbers already released are repeats and are dropped. Rows without
    shard or number are dropped. ``feed`` has (shard_id, number, key, version, op_seq, op_type).
    """
    kept = feed.where(f"shard_id is not null and {number} is not null").select("shard_id", F.col(number).cast("long").alias("n"), "key", "version", F.col("op_seq").cast("long").alias("op_seq"), F.col("op_type").cast("int").alias("op_type"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, waiting = state.get if state.exists else (0, [])
        held = {w[0]: tuple(w) for w in waiting}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.n >= expected:
                    held.setdefault(int(row.n), (int(row.n), bytes(row.key) if row.key is not None else None, None if pd.isna(row.version) else int(row.version), int(row.op_seq), int(row.op_type)))
        out = []
        while expected in held:
            out.append((key[0], *held.pop(expected)))
            expected += 1
        state.update((expected, [held[n] for n in sorted(held)]))
        yield pd.DataFrame(out, columns=["shard_id", "released", "key", "version", "op_seq", "op_type"])

    waiting = "array<struct<n:bigint,key:binary,version:bigint,op_seq:bigint,op_type:int>>"
    return kept.groupBy("shard_id").applyInPandasWithState(run, "shard_id int, released bigint, key binary, version bigint, op_seq bigint, op_type int", f"expected bigint, waiting {waiting}", "append", GroupStateTimeout.NoTimeout)


def stream_serial_bundles(sets: DataFrame) -> DataFrame:
    """In-order bundles of a stream of transactions ``(height, tx_idx, r, w)``, ``(bundle, n_txs)`` as they close.

    The open bundle's sets are the only state, kept across micro-batches; each micro-batch holds whole blocks.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bundle, n, reads, writes = state.get if state.exists else (0, 0, [], [])
        reads, writes, out = {bytes(x) for x in reads}, {bytes(x) for x in writes}, []
        rows = pd.concat(list(batches)).sort_values(["height", "tx_idx"])
        for r, w in zip(rows["r"], rows["w"], strict=True):
            r, w = {bytes(x) for x in r}, {bytes(x) for x in w}
            if n and (writes & r or writes & w or reads & w):
                out.append((bundle, n))
                bundle, n, reads, writes = bundle + 1, 0, set(), set()
            reads |= r
            writes |= w
            n += 1
        state.update((bundle, n, sorted(reads), sorted(writes)))
        yield pd.DataFrame(out, columns=["bundle", "n_txs"])

    one = sets.select(F.lit(0).alias("all"), "height", "tx_idx", "r", "w")
    return one.groupBy("all").applyInPandasWithState(run, "bundle bigint, n_txs bigint", "bundle bigint, n bigint, reads array<binary>, writes array<binary>", "append", GroupStateTimeout.NoTimeout)
