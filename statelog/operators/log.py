"""The append-only entry log that a sequence of operations leaves.

Live keys form a list in order of their hashes, opened in each two-byte prefix by a sentry. CREATE appends the new entry and its
predecessor with a new link, WRITE the new entry, DELETE the predecessor alone. Every appended entry names the serial numbers
it replaces in ``dsn``. Predecessor and successor at the time of an operation come from one ordered pass over each prefix;
serial numbers, replaced numbers and file positions are running values over range partitions.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelog.config import COMPACT_DIV, COMPACT_FACTOR, COMPACT_LEAST, SENTRIES
from statelog.functions.codec import entry_bytes, entry_length, k16
from statelog.operators.ranged import ranged_pass, ranged_sums
from statelog.operators.state import sentry_keys
from statelog.runtime import cut

_LINK = "shard_id int, entity binary, version bigint, op_seq bigint, sub int, kind string, key binary, value binary, next_key_hash binary, unlinks boolean"
_NAMES = [c.split()[0] for c in _LINK.split(", ")]
_KINDS = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
_SENTRY_BYTES = 96


def _after(prefix: bytes) -> bytes:
    n = int.from_bytes(prefix, "big") + 1
    return b"\xff" * 32 if n == 65536 else n.to_bytes(2, "big") + bytes(30)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries that creations and deletions touch, with their new links, for operations sorted by prefix, version and op_seq."""
    prefix, order, rows = None, [], []
    for b in batches:
        for p, shard, h, key, value, effect, version, seq in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if p != prefix:
                prefix, order = p, [p + bytes(30)]
            at = bisect_left(order, h)
            nxt = at + (effect != "create")
            following = order[nxt] if nxt < len(order) else _after(p)
            if effect == "create":
                rows.append((shard, h, version, seq, 0, "new", key, value, following, False))
                rows.append((shard, order[at - 1], version, seq, 1, "prev", None, None, h, False))
                order.insert(at, h)
            else:
                rows.append((shard, h, version, seq, 0, "gone", None, None, None, True))
                rows.append((shard, order[at - 1], version, seq, 1, "prev", None, None, following, True))
                order.pop(at)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[i]) for i in range(10)], _NAMES)
            rows = []


def touch_rows(classes: DataFrame) -> DataFrame:
    """Which entries the classified operations touch: ``(shard_id, entity, version, op_seq, sub, kind, key, value, next_key_hash, unlinks)``.

    Only creations and deletions, which change the list, go through the ordered pass over their prefix; a key that is written in a
    third of all operations costs no long task. What a touch doesn't set itself is null.
    """
    acts = classes.where("effect <> 'noop'").select(k16(F.col("key_hash")).alias("p"), "shard_id", "key_hash", "key", F.coalesce("value", F.unhex(F.lit(""))).alias("value"), "effect", "version", F.col("op_seq").cast("long").alias("op_seq"))
    linked = acts.where("effect <> 'write'").repartition("p").sortWithinPartitions("p", "version", "op_seq").mapInArrow(_links, _LINK)
    none = F.lit(None).cast("binary")
    written = acts.where("effect = 'write'").select("shard_id", F.col("key_hash").alias("entity"), "version", "op_seq", F.lit(0).alias("sub"), F.lit("write").alias("kind"), "key", "value", none.alias("next_key_hash"), F.lit(False).alias("unlinks"))
    return linked.unionByName(written)


def entry_log(classes: DataFrame, positions: bool = True) -> DataFrame:
    """Log rows of classified operations (see :func:`statelog.operators.changes.classified`), without the sentries' first entries.

    ``(shard_id, sn, entity, key, value, next_key_hash, version, last_version, dsn, length, file_pos, kind, op_seq, sub)``. Serial numbers go on
    from the sentries'. A null value is stored as empty. No operations give no rows. Two passes over range partitions: serial numbers in
    the order of a shard, then an entity's link, key, value, version and number from its touches before. Without ``positions``,
    file_pos is null and a third, narrow pass is saved.
    """
    t = touch_rows(classes).withColumn("one", (F.col("kind") != "gone").cast("long"))
    order = ["version", "op_seq", "sub"]
    t = ranged_sums(t, ["shard_id"], order, {"one": "rank"}).withColumn("sn", F.col("rank") + SENTRIES).drop("one", "rank")
    t = t.withColumn("sets", F.col("kind").isin("new", "write")).withColumn("links", F.col("next_key_hash").isNotNull())
    t = cut(ranged_pass(t, ["shard_id", "entity"], order, lags=["version", "sn"], lasts={"links": ["next_key_hash"], "sets": ["key", "value"]}))
    sentry_sn = F.conv(F.hex(F.substring("entity", 1, 2)), 16, 10).cast("long").bitwiseAND(SENTRIES - 1)
    old_sn = F.coalesce("prev_sn", sentry_sn)
    gone = t.where("kind = 'gone'").select("shard_id", "version", "op_seq", old_sn.alias("gone_sn"))
    rows = t.where("kind <> 'gone'").withColumn("old_sn", old_sn).join(gone, ["shard_id", "version", "op_seq"], "left")
    relinked = F.col("kind") == "prev"
    first = F.col("last_key").isNull()  # a sentry that nothing touched before
    none = F.array().cast("array<bigint>")
    rows = rows.select(
        "shard_id", "sn", "entity",
        F.when(relinked, F.coalesce("last_key", "entity")).otherwise(F.col("key")).alias("key"),
        F.when(relinked, F.when(first, F.unhex(F.lit(""))).otherwise(F.col("last_value"))).otherwise(F.col("value")).alias("value"),
        F.coalesce("next_key_hash", F.when(F.col("kind") == "write", F.col("last_next_key_hash"))).alias("next_key_hash"),
        "version",
        F.when(F.col("kind") == "new", -1).otherwise(F.coalesce("prev_version", F.lit(0))).cast("long").alias("last_version"),
        F.when(F.col("kind") == "new", none).when(F.col("gone_sn").isNotNull(), F.array("gone_sn", "old_sn")).otherwise(F.array("old_sn")).alias("dsn"),
        "kind", "op_seq", "sub",
    )
    rows = rows.withColumn("length", (_length() + F.size("dsn") * 8).cast("long"))
    out = ["shard_id", "sn", "entity", "key", "value", "next_key_hash", "version", "last_version", "dsn", "length", "file_pos", "kind", "op_seq", "sub"]
    if not positions:
        return rows.withColumn("file_pos", F.lit(None).cast("long")).select(*out)
    rows = cut(rows)
    before = ranged_sums(rows.select("shard_id", "sn", "length"), ["shard_id"], ["sn"], {"length": "before"})
    at = before.select("shard_id", "sn", (F.lit(SENTRIES * _SENTRY_BYTES) + F.col("before")).cast("long").alias("file_pos"))
    return rows.join(at, ["shard_id", "sn"]).select(*out)


def _length():
    """Length of an entry without its dsn list."""
    return entry_length(F.col("key"), F.col("value"), F.array().cast("array<bigint>"))


def sentry_log(spark: SparkSession) -> DataFrame:
    """The sentries' first entries, in the columns of :func:`entry_log`."""
    empty = F.unhex(F.lit(""))
    s = sentry_keys(spark)
    none = F.array().cast("array<bigint>")
    return s.select("shard_id", "sn", F.col("key_hash").alias("entity"), F.col("key_hash").alias("key"), empty.alias("value"), "next_key_hash", F.lit(0).cast("long").alias("version"), F.lit(-1).cast("long").alias("last_version"), none.alias("dsn"), F.lit(_SENTRY_BYTES).cast("long").alias("length"), (F.col("sn") * _SENTRY_BYTES).alias("file_pos"), F.lit("sentry").alias("kind"), F.lit(0).cast("long").alias("op_seq"), F.lit(0).alias("sub"))


def whole_log(classes: DataFrame, positions: bool = False) -> DataFrame:
    """Sentries and appended entries; without file positions unless they are asked for."""
    return sentry_log(classes.sparkSession).unionByName(entry_log(classes, positions))


def encoded(log: DataFrame) -> DataFrame:
    """``(shard_id, sn, entry)``: serialised log rows."""
    e = entry_bytes(*[F.col(c) for c in ("key", "value", "next_key_hash", "version", "last_version", "sn", "dsn")])
    return log.select("shard_id", "sn", e.alias("entry"))


def inactive_sns(log: DataFrame) -> DataFrame:
    """``(shard_id, sn)`` of entries that a later one replaced."""
    return log.select("shard_id", F.explode("dsn").alias("sn")).distinct()


def active_entries(log: DataFrame) -> DataFrame:
    """Log rows that no other row replaced."""
    return log.join(inactive_sns(log), ["shard_id", "sn"], "left_anti")


def active_stats(log: DataFrame) -> DataFrame:
    """Per shard: live entries, the oldest of them, the next serial number, and whether the log may be compacted."""
    ends = log.groupBy("shard_id").agg((F.max("sn") + 1).alias("next_sn"))
    live = active_entries(log).groupBy("shard_id").agg(F.count("*").alias("n_active"), F.min("sn").alias("oldest_active_sn"))
    total = F.col("next_sn") - F.col("oldest_active_sn")
    ready = (total * COMPACT_DIV >= F.col("n_active") * COMPACT_FACTOR) & (total >= COMPACT_LEAST)
    return ends.join(live, "shard_id").select("shard_id", "next_sn", "n_active", "oldest_active_sn", ready.alias("compactible"))
