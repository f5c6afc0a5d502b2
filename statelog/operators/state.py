"""Questions to the state that a sequence of operations leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statelog.config import OP_CREATE, OP_DELETE, OP_WRITE
from statelog.functions.codec import k16


def _setting(ops: DataFrame) -> DataFrame:
    return ops.where(F.col("op_type").isin(OP_WRITE, OP_CREATE, OP_DELETE))


def latest(ops: DataFrame) -> DataFrame:
    """``(shard_id, key_hash, key, value, version, op_seq)`` of each live key: its last setting operation.

    Combined per input split before the shuffle, so no key is hot. Ties of (version, op_seq) go to the greatest op_type and value.
    """
    last = F.max(F.struct("version", "op_seq", "op_type", "value")).alias("o")
    g = _setting(ops).groupBy("shard_id", "key_hash", "key").agg(last)
    return g.where(F.col("o.op_type") != OP_DELETE).select("shard_id", "key_hash", "key", "o.value", "o.version", "o.op_seq")


def as_of(ops: DataFrame, version: int) -> DataFrame:
    """:func:`latest` as it was before ``version``."""
    return latest(ops.where(F.col("version") < version))


def point_lookup(probes: DataFrame, state: DataFrame) -> DataFrame:
    """Each probe key with ``found``, ``size`` and ``value``; a key hash without key matches the hash alone.

    ``probes`` has ``key_hash`` and ``key``. A probe that finds nothing has size 0. Repeated probes give repeated rows.
    """
    s = state.select("key_hash", F.col("key").alias("s_key"), F.col("value").alias("s_value"))
    j = probes.join(s, "key_hash", "left").where("s_key is null or key is null or key = s_key")
    missed = probes.join(s.select("key_hash", F.col("s_key").alias("key")), ["key_hash", "key"], "left_anti").join(s, "key_hash", "left_semi").where("key is not null")
    j = j.select("key_hash", "key", F.col("s_key").isNotNull().alias("found"), F.coalesce(F.length("s_value"), F.lit(0)).alias("size"), F.col("s_value").alias("value"))
    other = missed.select("key_hash", "key", F.lit(False).alias("found"), F.lit(0).alias("size"), F.lit(None).cast("binary").alias("value"))
    return j.unionByName(other)


def existing(probes: DataFrame, state: DataFrame) -> DataFrame:
    """Probe keys that are live."""
    return probes.join(state.select("key_hash"), "key_hash", "left_semi")


def missing(probes: DataFrame, state: DataFrame) -> DataFrame:
    """Probe keys that aren't live."""
    return probes.join(state.select("key_hash"), "key_hash", "left_anti")


def with_successor(state: DataFrame, sentries: DataFrame | None = None) -> DataFrame:
    """Live keys in order of their hash with ``next_key_hash``; the last one's is all ones.

    ``sentries(key_hash)`` open each two-byte prefix, so a key's successor lies in its own prefix or is the next sentry, and each
    prefix is a window of its own. Without sentries, successors are sought inside the prefix alone.
    """
    keys = state.select("key_hash", F.lit(False).alias("sentry"))
    if sentries is not None:
        keys = keys.unionByName(sentries.select("key_hash", F.lit(True).alias("sentry")))
    keys = keys.withColumn("k16", k16(F.col("key_hash")))
    n = F.conv(F.hex("k16"), 16, 10).cast("int")
    beyond = F.when(n == 65535, F.unhex(F.lit("ff" * 32))).otherwise(F.concat(F.unhex(F.lpad(F.hex((n + 1).cast("long")), 4, "0")), F.unhex(F.lit("00" * 30))))
    w = Window.partitionBy("k16").orderBy("key_hash")
    return keys.select("key_hash", F.coalesce(F.lead("key_hash").over(w), beyond).alias("next_key_hash"), "sentry")


def sentry_keys(spark) -> DataFrame:
    """``(shard_id, sn, key_hash, next_key_hash)`` of the sentries: one a two-byte prefix."""
    n = F.col("id")
    zeros = F.unhex(F.lit("00" * 30))
    two = lambda c: F.unhex(F.lpad(F.hex(c), 4, "0"))
    following = F.when(n == 65535, F.unhex(F.lit("ff" * 32))).otherwise(F.concat(two(n + 1), zeros))
    return spark.range(65536).select((n / 4096).cast("int").alias("shard_id"), F.pmod(n, F.lit(4096)).alias("sn"), F.concat(two(n), zeros).alias("key_hash"), following.alias("next_key_hash"))


def predecessors(probes: DataFrame, chain: DataFrame) -> DataFrame:
    """Each probe ``key_hash`` with the greatest chain key hash below it, within its two-byte prefix.

    ``chain`` comes from :func:`with_successor` with sentries. Both sides are united and carried forward in one ordered pass of
    the prefix instead of a range join. A probe equal to a chain key gives the key before it. Repeated probes count once.
    """
    both = chain.select("key_hash", F.lit(1).alias("in_chain"), F.lit(0).alias("probe")).unionByName(probes.select("key_hash", F.lit(0).alias("in_chain"), F.lit(1).alias("probe")).distinct())
    g = both.groupBy("key_hash").agg(F.max("in_chain").alias("in_chain"), F.max("probe").alias("probe")).withColumn("k16", k16(F.col("key_hash")))
    w = Window.partitionBy("k16").orderBy("key_hash").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("in_chain") == 1, F.col("key_hash")), ignorenulls=True).over(w)
    return g.withColumn("prev_key_hash", before).where("probe = 1").select("key_hash", "prev_key_hash", (F.col("in_chain") == 1).alias("exists"))


def non_existence(probes: DataFrame, chain: DataFrame) -> DataFrame:
    """Probes that aren't in the chain with the link that proves it: ``prev_key_hash < key_hash < next_key_hash``."""
    p = predecessors(probes, chain).where("not exists")
    return p.join(chain.select(F.col("key_hash").alias("prev_key_hash"), "next_key_hash"), "prev_key_hash").where("key_hash < next_key_hash").select("key_hash", "prev_key_hash", "next_key_hash")


def range_scan(state: DataFrame, low: bytes, high: bytes) -> DataFrame:
    """Live keys with ``low <= key_hash < high``."""
    return state.where((F.col("key_hash") >= F.lit(low)) & (F.col("key_hash") < F.lit(high)))


def op_lookup(ops: DataFrame, state: DataFrame, chain: DataFrame) -> DataFrame:
    """The stored key that each operation has to read: its own for WRITE and READ, its predecessor for CREATE and DELETE."""
    own = ops.where(F.col("op_type").isin(OP_WRITE, 1)).join(state.select("key_hash"), "key_hash", "left_semi").select("version", "op_seq", "key_hash", F.col("key_hash").alias("read_hash"))
    near = ops.where(F.col("op_type").isin(OP_CREATE, OP_DELETE))
    found = near.join(predecessors(near.select("key_hash"), chain), "key_hash").select("version", "op_seq", "key_hash", F.col("prev_key_hash").alias("read_hash"))
    return own.unionByName(found)


def layered(probes: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """Each probe key with the value of the first layer that knows it, and that layer's number; null where none does.

    A layer ``(key_hash, value)`` knows deleted keys by a null value (a tombstone), which hides the layers below.
    """
    tagged = None
    for i, layer in enumerate(layers):
        t = layer.select("key_hash", F.struct(F.lit(-i).alias("rank"), F.col("value").alias("value")).alias("v"))
        tagged = t if tagged is None else tagged.unionByName(t)
    top = tagged.groupBy("key_hash").agg(F.max_by("v", F.col("v.rank")).alias("v"))
    return probes.join(top, "key_hash", "left").select(*probes.columns, (-F.col("v.rank")).alias("layer"), F.col("v.value").alias("value"))


def overlay(ops: DataFrame, height: int, width: int = 2) -> DataFrame:
    """The last operation of each key in the ``width`` blocks before ``height``; a deleted key keeps a tombstone (null value)."""
    recent = _setting(ops).where((F.col("height") < height) & (F.col("height") >= height - width))
    g = recent.groupBy("key_hash").agg(F.max(F.struct("version", "op_seq", "op_type", "value")).alias("o"))
    return g.select("key_hash", F.when(F.col("o.op_type") != OP_DELETE, F.col("o.value")).alias("value"), F.col("o.version").alias("version"))


def shard_stats(state: DataFrame) -> DataFrame:
    """Live keys, bytes of their values and first and last version per shard."""
    return state.groupBy("shard_id").agg(F.count("*").alias("n_keys"), F.sum(F.length("value")).cast("long").alias("value_bytes"), F.min("version").alias("first_version"), F.max("version").alias("last_version"))


def code_table(texts: DataFrame, text: str) -> DataFrame:
    """Content-addressed store: ``(code_hash, value)``, equal contents once. Null contents aren't stored."""
    value = F.encode(F.col(text), "UTF-8")
    return texts.where(F.col(text).isNotNull()).select(F.unhex(F.sha2(value, 256)).alias("code_hash"), value.alias("value")).dropDuplicates(["code_hash"])


def code_lookup(accounts: DataFrame, code: DataFrame) -> DataFrame:
    """``accounts(..., code_hash)`` with ``stored``, whether ``code(code_hash)`` holds their code. Code that many accounts share costs no long task:
    accounts that share a hash are counted out by a left join that adaptive execution may split, and the code side has a row a hash."""
    return accounts.join(code.select("code_hash", F.lit(True).alias("stored")).distinct(), "code_hash", "left").select(*accounts.columns, F.coalesce("stored", F.lit(False)).alias("stored"))
