"""Deterministic generators: random columns, change feeds for tests of correctness and speed, and colliding token transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statelog.config import OP_CREATE, OP_DELETE, OP_WRITE


def random_bytes(seed: int | str, *parts: Column, bits: int = 512) -> Column:
    """Bytes that follow from the seed and the given columns alone."""
    return F.unhex(F.sha2(F.concat_ws("/", F.lit(str(seed)), *[p.cast("string") for p in parts]), bits))


def random_uint(seed: int | str, bits: int, *parts: Column) -> Column:
    """Unsigned integer of up to 60 bits."""
    digits = F.substring(F.hex(random_bytes(seed, *parts, bits=256)), 1, 15)
    return F.shiftrightunsigned(F.conv(digits, 16, 10).cast("long"), 60 - bits)


def random_float(seed: int | str, *parts: Column) -> Column:
    """Number in [0, 1)."""
    return random_uint(seed, 53, *parts) / F.lit(float(1 << 53))


def random_bool(seed: int | str, *parts: Column) -> Column:
    return random_uint(seed, 1, *parts) == 1


def random_text(seed: int | str, length: int, *parts: Column) -> Column:
    """Text of ``length`` hex digits, up to 128."""
    return F.substring(F.lower(F.hex(random_bytes(seed, *parts))), 1, length)


def shuffled(i: Column, bits: int) -> Column:
    """A one-to-one reordering of 0 .. 2 ** bits - 1: two rounds of multiplying by an odd number and folding the upper half down."""
    mask = (1 << bits) - 1
    for odd in (0x5851F42D4C957F2D & mask | 1, 0x14057B7EF767814F & mask | 1):
        i = (i.cast("decimal(38,0)") * F.lit(odd).cast("decimal(20,0)") % F.lit(1 << bits).cast("decimal(20,0)")).cast("long")
        i = i.bitwiseXOR(F.shiftright(i, max(1, bits // 2)))
    return i


def fuzz_changes(spark: SparkSession, seed: int, heights: int, tasks: int = 20, ops: int = 25, keys: int = 2000) -> DataFrame:
    """A change feed of ``heights`` blocks over ``keys`` keys; a fifth of the operations delete. Keys may repeat in a task."""
    rows = spark.range(heights * tasks * ops)
    n = F.col("id")
    height, task, seq = (n / (tasks * ops)).cast("long") + 1, F.pmod((n / ops).cast("long"), F.lit(tasks)).cast("int"), F.pmod(n, F.lit(ops)).cast("int")
    key = random_bytes("key", F.pmod(random_uint(seed, 40, n), F.lit(keys)), bits=256)
    kind = F.when(random_float(f"{seed}-kind", n) < 0.2, OP_DELETE).otherwise(F.when(random_bool(f"{seed}-op", n), OP_CREATE).otherwise(OP_WRITE))
    value = F.when(kind != OP_DELETE, random_bytes(f"{seed}-value", n, bits=256))
    return rows.select(height.alias("height"), task.alias("task_idx"), F.lit(0).alias("cset_idx"), seq.alias("op_seq"), kind.alias("op_type"), key.alias("key"), value.alias("value"), F.shiftleft(height, 24).bitwiseOR(task.cast("long")).alias("version"))


def speed_changes(spark: SparkSession, bits: int, round_no: int) -> DataFrame:
    """Round 0 creates 2 ** bits keys in order; later rounds write each of them once in another order. 131,072 operations a block."""
    n = F.col("id")
    per_block, per_task = 131_072, 16
    height = (n / per_block).cast("long") + 1 + round_no * max(1, (1 << bits) // per_block)
    task = F.pmod((n / per_task).cast("long"), F.lit(per_block // per_task)).cast("int")
    which = n if round_no == 0 else shuffled(n, bits)
    key = F.substring(F.unhex(F.sha2(which.cast("string"), 512)), 1, 52)
    return spark.range(1 << bits).select(height.alias("height"), task.alias("task_idx"), (F.pmod(n, F.lit(per_task)) / 8).cast("int").alias("cset_idx"), F.pmod(n, F.lit(per_task)).cast("int").alias("op_seq"), F.lit(OP_CREATE if round_no == 0 else OP_WRITE).alias("op_type"), key.alias("key"), random_bytes(f"v{round_no}", n, bits=256).alias("value"), F.shiftleft(height, 24).bitwiseOR(task.cast("long")).alias("version"))


def transfer_accesses(spark: SparkSession, tasks: int, per_task: int, callers: int | None = None) -> DataFrame:
    """``(height, tx_idx, txid, r, w)`` of token transfers: each writes its sender's and recipient's slot and reads the token.

    With ``callers``, tasks cycle over so few senders and collide; without, each has its own.
    """
    n = F.col("id")
    sender = F.pmod(n, F.lit(callers)) if callers else n
    slot = lambda kind, x: F.unhex(F.sha2(F.concat_ws(":", F.lit(kind), x.cast("string")), 256))
    w = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(per_task - 1)), lambda k: F.array(slot("from", sender), slot("to", n * per_task + k))))
    token = F.unhex(F.sha2(F.lit("token"), 256))
    return spark.range(tasks).select(F.lit(1).cast("long").alias("height"), n.cast("int").alias("tx_idx"), F.lower(F.hex(slot("tx", n))).alias("txid"), F.array(token).alias("r"), F.array_distinct(w).alias("w"))
