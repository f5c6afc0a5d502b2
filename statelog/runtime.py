"""Session helpers shared by all operators: lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a dimension-like side may be broadcast.
BROADCAST_ROWS = 200_000
#: Masters whose tasks run in the driver's own process.
_LOCAL = re.compile(r"local(\[[^\]]*\])?")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can read and write: the one named in ``spark.checkpoint.dir``.

    Only a session that runs in this one process (local tests) gets a temporary folder if it names none; on a cluster that is an error,
    as each machine would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not _LOCAL.fullmatch(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can read and write")
        named = "file://" + tempfile.mkdtemp(prefix="statelog-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # the session is gone; the folder's owner cleans up
        pass


_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, deleted by :func:`release` or when the Python process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(release)
    _made.append((spark, path))
    return path


def release() -> None:
    """Delete all folders of :func:`scratch` so far. Tables that were made from them can't be read any more, so a long session calls it
    between queries, after their results are written."""
    while _made:
        _delete_quietly(*_made.pop())


def cut(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as a columnar table in the shared folder and read it back.

    Cuts lineage and stops a shared subplan from running once for each use. The table survives the loss of executors and
    later reads prune its columns. It is deleted by :func:`release` or when the Python process ends.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    (df.select(*columns) if columns else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema if not columns else df.select(*columns).schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else ``df`` itself, left to a shuffled join.

    ``df`` should be cheap to count, such as a table from :func:`cut`. The count stops at ``rows + 1`` rows.
    """
    small = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if small else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
