"""What surrounds the execution of a block's tasks: access sets of calls, checks, fees and the operations a state change amounts to.

The virtual machine itself isn't part of the engine; plain value transfers stand for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statelog.config import CODE_SHARD, EMPTY_CODE_HASH, OP_CREATE, OP_DELETE, OP_WRITE
from statelog.functions import u256
from statelog.functions.codec import account_bytes, account_fields, key_hash, sha256, shard_of

#: Addresses in access lists that say what their items are: read accounts, written accounts, read slots, written slots.
READ_ACCOUNT, WRITE_ACCOUNT, READ_SLOT, WRITE_SLOT = 1, 2, 3, 4
BASE_GAS, SLOT_GAS = 21_000, 1_900

_ZERO = "00" * 32


def call_access(calls: DataFrame) -> DataFrame:
    """``(task, mode, hash)`` that a task's calls access; ``calls(task, caller, target, value, access_list)``.

    The caller is written, a target is read if no value goes to it and written otherwise. ``access_list`` is an array of
    ``(kind, items)`` with 32-byte items: addresses in their last 20 bytes, or slot hashes. Null lists and targets add nothing.
    """
    own = F.array(F.struct(F.lit("w").alias("mode"), sha256(F.col("caller")).alias("hash")))
    paid = F.col("value") != F.unhex(F.lit(_ZERO))
    target = F.when(F.col("target").isNotNull(), F.array(F.struct(F.when(paid, "w").otherwise("r").alias("mode"), sha256(F.col("target")).alias("hash"))))
    base = calls.select("task", F.explode(F.concat(own, F.coalesce(target, F.array().cast("array<struct<mode:string,hash:binary>>")))).alias("a")).select("task", "a.*")
    listed = calls.select("task", F.explode("access_list").alias("l")).select("task", "l.kind", F.explode("l.items").alias("item")).where(F.col("kind").between(READ_ACCOUNT, WRITE_SLOT))
    mode = F.when(F.col("kind").isin(WRITE_ACCOUNT, WRITE_SLOT), "w").otherwise("r")
    value = F.when(F.col("kind").isin(READ_ACCOUNT, WRITE_ACCOUNT), sha256(F.substring("item", 13, 20))).otherwise(F.col("item"))
    return base.unionByName(listed.select("task", mode.alias("mode"), value.alias("hash"))).distinct()


def gas_access_list(calls: DataFrame) -> DataFrame:
    """Calls with ``accounts``, the addresses of their access list that count for gas; slots don't."""
    kept = F.filter(F.coalesce("access_list", F.array().cast(calls.schema["access_list"].dataType)), lambda x: x["kind"].isin(READ_ACCOUNT, WRITE_ACCOUNT))
    return calls.withColumn("accounts", F.transform(F.flatten(F.transform(kept, lambda x: x["items"])), lambda i: F.substring(i, 13, 20)))


def initial_gas(n_slots: Column, gas_limit: Column) -> Column:
    """Gas before execution; null where the limit doesn't cover it."""
    need = F.lit(BASE_GAS).cast("long") + n_slots * SLOT_GAS
    return F.when(need <= gas_limit, need)


def gas_price(effective: Column, base_fee: Column) -> Column:
    """Price that goes to the coinbase: what the effective price leaves over the base fee."""
    return F.greatest(effective - base_fee, F.lit(0).cast("long"))


def is_empty_code(code_hash: Column) -> Column:
    return F.lower(F.hex(code_hash)).isin(_ZERO, EMPTY_CODE_HASH)


def warm_up(calls: DataFrame, accounts: DataFrame, code: DataFrame | None = None) -> DataFrame:
    """``(task, error)`` of each call: ``no caller``, ``no bytecode`` or null. ``accounts(address, value)``, ``code(code_hash)``."""
    a = accounts.select("address", account_fields(F.col("value"))["code_hash"].alias("code_hash"))
    caller = calls.join(a.select(F.col("address").alias("caller"), F.lit(True).alias("known")), "caller", "left")
    j = caller.join(a.select(F.col("address").alias("target"), F.col("code_hash").alias("needs")), "target", "left")
    j = j.withColumn("needs", F.when(~is_empty_code(F.col("needs")), F.col("needs")))
    if code is not None:
        j = j.join(code.select(F.col("code_hash").alias("needs"), F.lit(True).alias("has_code")), "needs", "left")
    else:
        j = j.withColumn("has_code", F.lit(None).cast("boolean"))
    error = F.when(F.col("known").isNull(), "no caller").when(F.col("needs").isNotNull() & F.col("has_code").isNull(), "no bytecode")
    return j.select("task", error.alias("error"))


def settle_failures(failed: DataFrame, accounts: DataFrame) -> DataFrame:
    """Callers of failed tasks ``(task, caller, price, gas_limit)`` after paying ``price * gas_limit``, or all they have.

    ``(task, caller, paid, value)``: changes of a failed task are discarded, its nonce counts. A caller without account pays nothing and
    gives no row.
    """
    f = account_fields(F.col("value"))
    j = failed.join(accounts.select(F.col("address").alias("caller"), "value"), "caller")
    fee = u256.from_decimal(F.col("price").cast("decimal(19,0)") * F.col("gas_limit").cast("decimal(19,0)"))
    j = j.withColumn("fee", fee).withColumn("balance", f["balance"])
    paid = F.when(F.col("balance") < F.col("fee"), F.col("balance")).otherwise(F.col("fee"))
    j = j.withColumn("paid", paid)
    left = u256.saturating_sub(F.col("balance"), F.col("paid"))
    return j.select("task", "caller", "paid", account_bytes(left, f["nonce"] + 1, f["code_hash"]).alias("value"))


def block_rewards(fees: DataFrame, coinbases: DataFrame, accounts: DataFrame) -> DataFrame:
    """``(height, coinbase, fees, value)``: the coinbase's account after a block's ``fees(height, paid)``; a new account if it had none.

    Each block is taken against the same ``accounts``. A block without coinbase gives no row.
    """
    total = u256.total(fees, ["height"], "paid", "fees").join(coinbases.where("coinbase is not null"), "height")
    j = total.join(accounts.select(F.col("address").alias("coinbase"), "value"), "coinbase", "left")
    empty = F.unhex(F.lit("00" * 40 + EMPTY_CODE_HASH))
    f = account_fields(F.coalesce("value", empty))
    return j.select("height", "coinbase", "fees", account_bytes(u256.add(f["balance"], F.col("fees")), f["nonce"], f["code_hash"]).alias("value"))


def diff_ops(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(shard_id, key_hash, key, op_type, value)``: operations that lead from state ``old(key, value)`` to ``new(key, value)``.

    CREATE without an old value, DELETE without a new one, WRITE if they differ; a slot's zero value (32 zero bytes) is none. Equal
    values give no row. Keys come once a side; a null value is none.
    """

    def some(df: DataFrame, name: str) -> DataFrame:
        return df.where("key is not null and value is not null").where(F.hex("value") != _ZERO).select("key", F.col("value").alias(name))

    j = some(old, "was").join(some(new, "now"), "key", "full")
    op = F.when(F.col("was").isNull(), OP_CREATE).when(F.col("now").isNull(), OP_DELETE).when(F.col("was") != F.col("now"), OP_WRITE)
    j = j.withColumn("op_type", op).where("op_type is not null").withColumn("key_hash", key_hash(F.col("key")))
    return j.select(shard_of(F.col("key_hash")).alias("shard_id"), "key_hash", "key", "op_type", F.col("now").alias("value"))


def code_creations(created: DataFrame) -> DataFrame:
    """CREATE operations in the code shard of ``created(code_hash, code)``; equal code once."""
    return created.where("code is not null").dropDuplicates(["code_hash"]).select(F.lit(CODE_SHARD).alias("shard_id"), F.col("code_hash").alias("key_hash"), F.col("code_hash").alias("key"), F.lit(OP_CREATE).alias("op_type"), F.col("code").alias("value"))


def transfer_block(transfers: DataFrame, accounts: DataFrame) -> DataFrame:
    """Balances after transfers ``(sender, recipient, amount)`` of whole numbers: ``(address, balance)`` of all accounts touched.

    The sum of what comes in and goes out per account, added in any order; a sender may not be overdrawn at the end of the block (its
    balance then is null). Self-transfers change nothing.
    """
    moved = transfers.select(F.explode(F.array(F.struct(F.col("sender").alias("address"), (-F.col("amount")).alias("d")), F.struct(F.col("recipient").alias("address"), F.col("amount").alias("d")))).alias("m")).select("m.*")
    net = moved.where("address is not null").groupBy("address").agg(F.sum("d").cast("decimal(38,0)").alias("d"))
    j = net.join(accounts.select("address", account_fields(F.col("value"))["balance"].alias("balance")), "address", "left").withColumn("balance", F.coalesce("balance", F.unhex(F.lit(_ZERO))))
    up, down = u256.from_decimal(F.greatest("d", F.lit(0).cast("decimal(38,0)"))), u256.from_decimal(F.greatest(-F.col("d"), F.lit(0).cast("decimal(38,0)")))
    j = j.withColumn("up", up).withColumn("down", down)
    return j.select("address", F.when(F.col("balance") >= F.col("down"), u256.add(u256.saturating_sub(F.col("balance"), F.col("down")), F.col("up"))).alias("balance"))


_RESULT = "name string, address binary, is_caller boolean, failed boolean, paid binary, value binary"


def run_tasks(transfers: DataFrame, accounts: DataFrame) -> DataFrame:
    """Tasks of transfers one after another: ``(name, address, is_caller, failed, paid, value)``, a row for each account that a transfer changed.

    ``transfers(task, k, name, caller, target, amount, fee)``, numbers as 32 bytes, k the place in the task; ``accounts(address, value)``. Each
    transfer sees what those before it in its task left. It pays ``fee``, moves ``amount`` and counts the caller's nonce up; where the
    balance doesn't cover both it fails: nothing moves, and the caller pays the fee, or all it has. A caller without account gives no row, a
    target without one gets a new account. Tasks run side by side, each against the same ``accounts``; a task is small.
    """
    ends = transfers.select("task", F.explode(F.array_distinct(F.filter(F.array("caller", "target"), lambda a: a.isNotNull()))).alias("address")).distinct()
    has = ends.join(accounts.select("address", "value"), "address").groupBy("task").agg(F.collect_list(F.struct("address", "value")).alias("has"))
    steps = transfers.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("k", "name", "caller", "target", "amount", "fee"))).alias("steps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = bytes(40) + bytes.fromhex(EMPTY_CODE_HASH)
        for b in batches:
            out = []
            for steps_, has_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                now = {a["address"]: a["value"] for a in has_ or []}
                for s in steps_:
                    caller, target = s["caller"], s["target"]
                    if caller not in now:
                        continue
                    amount, fee = int.from_bytes(s["amount"], "big"), int.from_bytes(s["fee"], "big")
                    acc = now[caller]
                    balance, nonce = int.from_bytes(acc[:32], "big"), int.from_bytes(acc[32:40], "big")
                    failed = balance < amount + fee
                    paid = min(balance, fee)
                    left = balance - paid - (0 if failed or target in (None, caller) else amount)
                    now[caller] = left.to_bytes(32, "big") + (nonce + 1).to_bytes(8, "big") + acc[40:]
                    out.append((s["name"], caller, True, failed, paid.to_bytes(32, "big"), now[caller]))
                    if not failed and target not in (None, caller):
                        acc = now.get(target, new)
                        now[target] = ((int.from_bytes(acc[:32], "big") + amount) % (1 << 256)).to_bytes(32, "big") + acc[32:]
                        out.append((s["name"], target, False, False, None, now[target]))
            kinds = [pa.string(), pa.binary(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds[i]) for i in range(6)], [c.split()[0] for c in _RESULT.split(", ")])

    return steps.join(has, "task", "left").select("steps", "has").mapInArrow(run, _RESULT)


def completed_prefix(done: DataFrame) -> DataFrame:
    """``(height, all_done)``: the last task of the longest prefix of a block's tasks that are done; -1 if the first isn't.

    ``done(height, task_idx)``; repeated rows count once.
    """
    w = Window.partitionBy("height").orderBy("task_idx")
    d = done.select("height", "task_idx").distinct().withColumn("k", F.row_number().over(w) - 1)
    return d.groupBy("height").agg(F.coalesce(F.max(F.when(F.col("k") == F.col("task_idx"), F.col("task_idx"))), F.lit(-1)).alias("all_done"))
