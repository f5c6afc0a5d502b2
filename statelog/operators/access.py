"""What transactions read and write, and which of them collide."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statelog.functions.codec import sha256
from statelog.functions.spelling import member_set, prefixed_hex, slot_set
from statelog.operators.activity import distinct_blocks
from statelog.operators.ranged import ranged_lag, ranged_pass, ranged_sum


def distinct_txs(txs: DataFrame) -> DataFrame:
    """One row a transaction ``(height, tx_idx, txid, sender, rdo, rnw, rdo_slots, rnw_slots)`` with its lists as sets.

    Copies of a transaction hold the same sets; where they don't, the union counts. Rows without id or place are ignored.
    """
    t = txs.where("height is not null and tx_idx is not null").select("height", "tx_idx", prefixed_hex(F.col("txid")).alias("txid"), prefixed_hex(F.col("from_addr")).alias("sender"), member_set(F.col("rdo_addr_list")).alias("rdo"), member_set(F.col("rnw_addr_list")).alias("rnw"), slot_set(F.col("rdo_slot_list")).alias("rdo_slots"), slot_set(F.col("rnw_slot_list")).alias("rnw_slots"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return t.where("txid is not null").groupBy("height", "tx_idx", "txid").agg(F.max("sender").alias("sender"), *[union(c) for c in ("rdo", "rnw", "rdo_slots", "rnw_slots")])


def _hashes(addresses: F.Column, slots: F.Column) -> F.Column:
    """Hashes of addresses and of slots (address and index joined)."""
    return F.array_distinct(F.concat(F.transform(addresses, lambda a: sha256(a.cast("binary"))), F.transform(slots, lambda s: sha256(F.regexp_replace(s, ":", "").cast("binary")))))


def access_sets(txs: DataFrame, blocks: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """``(height, tx_idx, txid, sender, r, w)``: hashes a transaction reads and writes.

    Writes of the block's coinbase and of ``ignore`` addresses (such as ``config.WETH``) are left out of the written addresses; their slots
    and reads stay.
    """
    t = distinct_txs(txs).join(distinct_blocks(blocks).select("height", "coinbase"), "height", "left")
    skip = F.array(*[F.lit(a) for a in ignore]).cast("array<string>")
    writes = F.filter("rnw", lambda a: ~(a.eqNullSafe(F.col("coinbase"))) & ~F.array_contains(skip, a))
    return t.select("height", "tx_idx", "txid", "sender", _hashes(F.col("rdo"), F.col("rdo_slots")).alias("r"), _hashes(writes, F.col("rnw_slots")).alias("w"))


def access_rows(sets: DataFrame) -> DataFrame:
    """``(height, tx_idx, mode, hash)``: a row for each hash of each set, mode ``r`` or ``w``."""
    both = F.array(F.struct(F.lit("r").alias("mode"), F.col("r").alias("hs")), F.struct(F.lit("w").alias("mode"), F.col("w").alias("hs")))
    return sets.select("height", "tx_idx", F.explode(both).alias("m")).select("height", "tx_idx", "m.mode", F.explode("m.hs").alias("hash"))


def numbered(sets: DataFrame) -> DataFrame:
    """``sets`` with ``pos``: place of the transaction among all, by height, index and id.

    Only the three columns of the order go through range partitions; the sets are joined by them.
    """
    at = ["height", "tx_idx", "txid"]
    narrow = sets.select(*at, F.lit(0).alias("_all"), F.lit(1).cast("long").alias("_one"))
    placed = ranged_sum(narrow, ["_all"], at, "_one", "pos").select(*at, "pos")
    return sets.join(placed, at)


def collisions(rows: DataFrame) -> DataFrame:
    """``(height, tx_a, tx_b)``: pairs of transactions of a block, a before b, of which one writes what the other touches.

    Each block is a group of its own, so a hash that every block touches doesn't pair transactions across blocks.
    """
    both = rows.groupBy("height", "hash", "tx_idx").agg(F.max(F.col("mode") == "w").alias("writes"))
    a, b = both.alias("a"), both.alias("b")
    j = a.join(b, (F.col("a.height") == F.col("b.height")) & (F.col("a.hash") == F.col("b.hash")) & (F.col("a.tx_idx") < F.col("b.tx_idx")) & (F.col("a.writes") | F.col("b.writes")))
    return j.select(F.col("a.height").alias("height"), F.col("a.tx_idx").alias("tx_a"), F.col("b.tx_idx").alias("tx_b")).distinct()


def last_collision(sets: DataFrame, single_set: bool = False) -> DataFrame:
    """``(pos, last)``: for each transaction the greatest earlier ``pos`` that collides with it, -1 for none.

    ``single_set`` counts reads as writes. Per hash, in order of ``pos``, it is the last one that touched the hash or, for a read, the last
    one that wrote it; both come from passes over range partitions, so a hash that a third of the rows touch costs no long task.
    """
    both = F.array(F.struct(F.lit(False).alias("writes"), F.col("r").alias("hs")), F.struct(F.lit(True).alias("writes"), F.col("w").alias("hs")))
    touch = sets.select("pos", F.explode(both).alias("m")).select("pos", "m.writes", F.explode("m.hs").alias("hash"))
    touch = touch.groupBy("hash", "pos").agg(F.max("writes").alias("writes"))
    if single_set:
        touched = ranged_lag(touch, ["hash"], ["pos"], ["pos"])
        last = F.coalesce("prev_pos", F.lit(-1))
    else:
        touched = ranged_pass(touch.withColumn("_written", F.when(F.col("writes"), F.col("pos"))), ["hash"], ["pos"], lags=["pos"], maxes={"_written": "wrote"})
        last = F.when(F.col("writes"), F.coalesce("prev_pos", F.lit(-1))).otherwise(F.col("wrote"))
    hit = touched.groupBy("pos").agg(F.max(last).alias("last"))
    return sets.select("pos").join(hit, "pos", "left").na.fill(-1, ["last"])


def write_frequency(txs: DataFrame) -> DataFrame:
    """``(addr, n)``: transactions that write each address."""
    return distinct_txs(txs).select(F.explode("rnw").alias("addr")).groupBy("addr").agg(F.count("*").alias("n"))


def hottest(txs: DataFrame) -> str | None:
    """The most written address (the least of equals), or None without any."""
    top = write_frequency(txs).agg(F.max(F.struct("n", "addr")).alias("t")).first()["t"]
    return top["addr"] if top else None


def sender_tasks(txs: DataFrame, per_task: int = 3) -> DataFrame:
    """Transactions of a sender in a block as tasks of at most ``per_task``: ``(height, sender, task_no, first_idx, n_txs, txids)``.

    Senders come in order of first appearance (``first_idx``); a null sender is one sender.
    """
    w = Window.partitionBy("height", "sender").orderBy("tx_idx", "txid")  # one sender in one block
    t = distinct_txs(txs).select("height", "sender", "tx_idx", "txid").withColumn("k", F.row_number().over(w) - 1)
    t = t.withColumn("task_no", F.expr(f"k div {per_task}").cast("int"))
    g = t.groupBy("height", "sender", "task_no").agg(F.min("tx_idx").alias("first_idx"), F.count("*").alias("n_txs"), F.array_sort(F.collect_list(F.struct("tx_idx", "txid"))).alias("l"))
    return g.select("height", "sender", "task_no", "first_idx", "n_txs", F.transform("l", lambda x: x["txid"]).alias("txids"))


def numbered_in_tasks(sets: DataFrame, per_task: int = 3) -> DataFrame:
    """``sets`` with ``task_no``, the task of its sender in its block that a transaction belongs to, and ``k``, its place in it."""
    w = Window.partitionBy("height", "sender").orderBy("tx_idx", "txid")  # one sender in one block
    at = sets.withColumn("_at", F.row_number().over(w) - 1)
    return at.withColumn("task_no", F.expr(f"_at div {per_task}").cast("int")).withColumn("k", F.expr(f"_at % {per_task}")).drop("_at")


def task_sets(sets: DataFrame, per_task: int = 3) -> DataFrame:
    """``(pos, height, sender, task_no, n_txs, r, w)``: the tasks of :func:`sender_tasks` with the united sets of their transactions.

    ``sets`` comes from :func:`access_sets`. Tasks are numbered by block, then by their sender's first appearance, then ``task_no``.
    """
    w = Window.partitionBy("height", "sender").orderBy("tx_idx", "txid")  # one sender in one block
    at = sets.withColumn("k", F.row_number().over(w) - 1).withColumn("task_no", F.expr(f"k div {per_task}").cast("int"))
    at = at.withColumn("from_idx", F.first("tx_idx").over(w)).withColumn("from_txid", F.first("txid").over(w))
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    g = at.groupBy("height", "sender", "from_idx", "from_txid", "task_no").agg(F.count("*").alias("n_txs"), union("r"), union("w"))
    g = g.withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1).cast("long"))
    placed = ranged_sum(g, ["_all"], ["height", "from_idx", "from_txid", "task_no"], "_one", "pos")
    return placed.select("pos", "height", "sender", "task_no", "n_txs", "r", "w")


def merge_ratio(txs: DataFrame) -> DataFrame:
    """Transactions, senders' tasks and their ratio over all blocks, in one row."""
    per = distinct_txs(txs).groupBy("height", "sender").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_txs"), F.count("*").alias("n_tasks")).select("n_txs", "n_tasks", F.round(F.try_divide("n_txs", "n_tasks"), 6).alias("ratio"))


def slot_counts(txs: DataFrame) -> DataFrame:
    """Slots that each transaction lists."""
    return distinct_txs(txs).select("height", "tx_idx", "txid", (F.size("rdo_slots") + F.size("rnw_slots")).alias("n_slots"))


def _declared(declared: DataFrame) -> DataFrame:
    as_set = lambda c: F.array_distinct(F.filter(F.coalesce(F.col(c), F.array().cast("array<binary>")), lambda x: x.isNotNull()))
    union = lambda c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c)
    return declared.select(prefixed_hex(F.col("txid")).alias("txid"), as_set("rdo_set").alias("may_read"), as_set("rnw_set").alias("may_write")).where("txid is not null").groupBy("txid").agg(union("may_read"), union("may_write"))


def violations(sets: DataFrame, declared: DataFrame) -> DataFrame:
    """``(txid, kind, hash)``: accesses of declared tasks outside of their declaration.

    A read is allowed if it is declared in either set, a write if it is declared written.
    """
    j = sets.join(_declared(declared), "txid")
    bad_reads = F.array_except("r", F.array_union("may_read", "may_write"))
    bad_writes = F.array_except("w", "may_write")
    reads = j.select("txid", F.lit("read").alias("kind"), F.explode(bad_reads).alias("hash"))
    return reads.unionByName(j.select("txid", F.lit("write").alias("kind"), F.explode(bad_writes).alias("hash")))
