"""A state store in a folder: the operations of each block as a partition, a commit row a block, and published states.

A block's operations are written first and its commit row last. Readers see committed heights only, so a crash between the two
leaves a partition that isn't read and that the next attempt replaces. No step keeps state on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelog.operators.changefeed import apply_changes, live, publish, read_published, upsert
from statelog.runtime import delete_path

_OPS = "height bigint, task_idx int, cset_idx int, op_seq int, op_type int, key binary, value binary, version bigint"
_META = "height bigint, n_ops bigint, n_live bigint"


class StateStore:
    """Blocks are committed one after another; ``height`` is the last committed one, -1 for an empty store."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def meta(self) -> DataFrame:
        """Commit rows: the last one a height."""
        m = self._read("meta", _META)
        return m.groupBy("height").agg(F.max(F.struct("n_ops", "n_live")).alias("m")).select("height", "m.*")

    @property
    def height(self) -> int:
        top = self._read("meta", _META).agg(F.max("height")).first()[0]
        return -1 if top is None else top

    def ops(self) -> DataFrame:
        """Operations of committed heights."""
        committed = self.meta().select("height")
        return self._read("ops", _OPS).join(F.broadcast(committed), "height", "left_semi")

    def state(self) -> DataFrame:
        """Last change of each key, tombstones included."""
        s = read_published(self.spark, f"{self.folder}/state")
        return self.spark.createDataFrame([], "key binary, version bigint, op_seq bigint, op_type int, value binary") if s is None else s

    def commit(self, ops: DataFrame, height: int) -> None:
        """Add a block; only the buckets of the state that it touches are written. A height at or below the last committed one was applied before and is left alone, so a repeated batch does no harm."""
        if height <= self.height:
            return
        cols = [c.split()[0] for c in _OPS.split(", ")]
        block = ops.select(*[F.col(c) for c in cols if c != "height"], F.lit(height).cast("long").alias("height"))
        path = f"{self.folder}/ops/height={height}"
        block.drop("height").write.mode("overwrite").parquet(path)
        written = self.spark.read.schema(_OPS.replace("height bigint, ", "")).parquet(path)
        state = upsert(written.withColumn("height", F.lit(height).cast("long")), f"{self.folder}/state")
        row = state.agg(F.lit(height).cast("long").alias("height"), F.lit(written.count()).cast("long").alias("n_ops"), F.count(F.when(F.col("op_type") != 4, 1)).alias("n_live"))
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/meta")

    def live(self) -> DataFrame:
        return live(self.state())

    def truncate(self, height: int) -> None:
        """Roll back to ``height``: later blocks go, and the state is rebuilt from the operations that stay."""
        keep = self.meta().where(F.col("height") <= height).collect()  # commit rows: one a block
        later = [r["height"] for r in self.meta().where(F.col("height") > height).select("height").collect()]
        delete_path(self.spark, f"{self.folder}/meta")
        if keep:
            self.spark.createDataFrame(keep, _META).coalesce(1).write.parquet(f"{self.folder}/meta")
        for h in later:
            delete_path(self.spark, f"{self.folder}/ops/height={h}")
        publish(apply_changes(self.ops()), f"{self.folder}/state")

    def prune(self, height: int) -> None:
        """Drop the operations of blocks below ``height``; commit rows and state stay."""
        for r in self.meta().where(F.col("height") < height).select("height").collect():
            delete_path(self.spark, f"{self.folder}/ops/height={r['height']}")
