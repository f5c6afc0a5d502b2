"""Current state of a table from a feed of inserts, updates and deletes in any order.

Each bucket of keys is an embedded DuckDB table. Batches of changes are upserted with a conditional conflict update: a row
changes only where the incoming (version, op_seq) is later than the stored one. Deletes stay as tombstones, so an older
change that comes after them has no effect. The same upsert first runs over every input split, which leaves one row a key and
split to shuffle, so a key that holds a third of the feed costs no long task.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelog.runtime import cut, delete_path

READ, WRITE, CREATE, DELETE = 1, 2, 3, 4
#: Buckets of a table that is upserted in place.
BUCKETS = 64
_SCHEMA = "key binary, version bigint, op_seq bigint, op_type int, value binary"

_CREATE = "create table state (key blob primary key, version bigint, op_seq bigint, op_type integer, value blob)"
#: Place of a change in the order: changes that tie in version and op_seq do so in favour of the greater op_type and value, a null value least.
_RANK = "({0}.version, {0}.op_seq, {0}.op_type, {0}.value is not null, coalesce({0}.value, ''::blob))"
#: Within a batch the last change of a key stands.
_UPSERT = f"""
insert into state
select key, o.version, o.op_seq, o.op_type, case when o.valued then o.value end
from (
  select key, max(struct_pack(version := version, op_seq := op_seq, op_type := op_type, valued := value is not null, value := coalesce(value, ''::blob))) as o
  from batch group by key)
on conflict (key) do update set version = excluded.version, op_seq = excluded.op_seq, op_type = excluded.op_type, value = excluded.value
where {_RANK.format("excluded")} > {_RANK.format("state")}
"""


def _upsert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    db = duckdb.connect(":memory:", config={"threads": 1})
    db.execute(_CREATE)
    for b in batches:
        if b.num_rows:
            db.register("batch", pa.Table.from_batches([b]))
            db.execute(_UPSERT)
            db.unregister("batch")
    table = db.sql("select key, version, op_seq, op_type, value from state").to_arrow_table()
    table = table.cast(pa.schema([("key", pa.binary()), ("version", pa.int64()), ("op_seq", pa.int64()), ("op_type", pa.int32()), ("value", pa.binary())]))
    yield from table.to_batches(max_chunksize=10_000)
    db.close()


def apply_changes(changes: DataFrame, buckets: int | None = None) -> DataFrame:
    """Last change of each key, tombstones included: ``(key, version, op_seq, op_type, value)``.

    Order is version, then op_seq. A missing version is that of its height and task. READ changes nothing. Rows without key,
    order or kind say nothing that could be applied and are ignored. Repeated changes count once; of changes with equal key, version and
    op_seq the one with the greatest op_type and value stands, whatever order they come in. No changes give no rows.
    ``buckets`` is the number of tables that are kept, the session's shuffle partitions if not given.
    """
    version = F.coalesce(F.col("version"), F.shiftleft(F.col("height").cast("long"), 24) + F.col("task_idx"))
    feed = changes.select("key", version.alias("version"), F.col("op_seq").cast("long").alias("op_seq"), F.col("op_type").cast("int").alias("op_type"), "value")
    feed = feed.where(F.col("op_type").isin(WRITE, CREATE, DELETE) & F.expr("key is not null and version is not null and op_seq is not null"))
    first = feed.mapInArrow(_upsert, _SCHEMA)
    spread = first.repartition(buckets, "key") if buckets else first.repartition("key")
    return spread.mapInArrow(_upsert, _SCHEMA)


def live(state: DataFrame) -> DataFrame:
    """Rows of :func:`apply_changes` whose key is live, i.e. whose last change is no delete."""
    return state.where(F.col("op_type") != DELETE)


def publish(state: DataFrame, folder: str, keep: int = 2) -> DataFrame:
    """Write all bucket results as a new generation of the table in ``folder`` and make it current in one step.

    Readers follow the pointer file ``CURRENT``, which is replaced by a rename after all buckets are written: they see the
    former generation or the new one, never a mixture. A failed write leaves the former one current. ``keep`` generations stay.
    Returns the published rows.
    """
    generation = f"gen-{uuid.uuid4().hex}"
    state.write.option("compression", "zstd").parquet(f"{folder}/{generation}")
    _point(state.sparkSession, folder, {"all": generation}, keep)
    return state.sparkSession.read.schema(state.schema).parquet(f"{folder}/{generation}")


def upsert(changes: DataFrame, folder: str, buckets: int = BUCKETS, keep: int = 2) -> DataFrame:
    """Apply ``changes`` to the table in ``folder`` and return its rows, tombstones included.

    Keys fall into ``buckets`` by hash, and the pointer names the generation that each bucket was last written in: only buckets that the
    changes touch are read, merged and written. As in :func:`publish`, the new state becomes current in one step. Applying changes
    again makes no difference. ``buckets`` is set by the first use; a table that :func:`publish` wrote is parted into them.
    """
    spark = changes.sparkSession
    pointer = _pointer(spark, folder)
    now, buckets = pointer.get("now", {}), pointer.get("buckets") or buckets
    place = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
    new = cut(apply_changes(changes).select("*", place))
    touched = [str(r[0]) for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
    old = [now[b] for b in touched if b in now] + [now[b] for b in now if b == "all"]
    rows = new.drop("bucket")
    if old:
        was = spark.read.schema(_SCHEMA).parquet(*[f"{folder}/{o}" for o in old])
        rows = was.unionByName(rows).repartition("key").mapInArrow(_upsert, _SCHEMA)
    if touched:
        generation = f"gen-{uuid.uuid4().hex}"
        rows.select("*", place).repartition("bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/{generation}")
        if "all" in now:
            touched = [str(r[0]) for r in rows.select(place).distinct().collect()]
        kept = {b: g for b, g in now.items() if b != "all" and b not in touched}
        _point(spark, folder, {**kept, **{b: f"{generation}/bucket={b}" for b in touched}}, keep, buckets)
    elif not pointer:
        _point(spark, folder, {}, keep, buckets)
    return read_published(spark, folder)


def _point(spark: SparkSession, folder: str, now: dict[str, str], keep: int, buckets: int | None = None) -> None:
    """Make ``now``, folders of rows by bucket, the current state, and delete what neither it nor the ``keep`` - 1 states before it name."""
    fs_path, fs, jvm = _fs(spark, folder)
    former = _pointer(spark, folder)
    before = ([former["now"], *former["before"]] if former else [])[: keep - 1]
    tmp = jvm.org.apache.hadoop.fs.Path(fs_path, f".CURRENT-{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps({"now": now, "before": before, "buckets": buckets}).encode()))
    out.close()
    _replace(jvm, spark, fs, tmp, jvm.org.apache.hadoop.fs.Path(fs_path, "CURRENT"))
    named = {g.split("/")[0] for state in (now, *before) for g in state.values()}
    for state in [former["now"], *former["before"]] if former else []:
        for g in {g.split("/")[0] for g in state.values()} - named:
            delete_path(spark, f"{folder}/{g}")


def read_published(spark: SparkSession, folder: str) -> DataFrame | None:
    """Rows of the current state, or None if nothing was published."""
    pointer = _pointer(spark, folder)
    if not pointer:
        return None
    paths = [f"{folder}/{g}" for g in pointer["now"].values()]
    if pointer["buckets"]:
        return spark.read.schema(_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], _SCHEMA)
    return spark.read.parquet(*paths)


def _fs(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def _replace(jvm, spark: SparkSession, fs, tmp, to) -> None:
    """Rename over an existing file in one step (FileContext with OVERWRITE)."""
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(tmp), fs.makeQualified(to), options)


def _pointer(spark: SparkSession, folder: str) -> dict:
    path, fs, jvm = _fs(spark, folder)
    current = jvm.org.apache.hadoop.fs.Path(path, "CURRENT")
    if not fs.exists(current):
        return {}
    stream = fs.open(current)
    try:
        return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()
