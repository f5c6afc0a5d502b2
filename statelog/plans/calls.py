"""Queries of calls, code, generators, the state store in a folder and ordered streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelog.config import CODE_SHARD, SENTRIES
from statelog.functions import u256
from statelog.functions.codec import account_fields, slot_key
from statelog.operators import access as A
from statelog.operators import changes as C
from statelog.operators import compaction as K
from statelog.operators import execution as X
from statelog.operators import log as L
from statelog.operators import state as S
from statelog.plans.dependency import _TXS, sets_of
from statelog.plans.pipeline import _ACCOUNTS, BASE_FEE, PRICE, accounts_of
from statelog.plans.sqltext import LATEST, OPS, WHOLE, nibble
from statelog.plans.store import classes_of, hx, ops_of
from statelog.runtime import cut, scratch, table
from statelog.sources import workload as W
from statelog.sources.store import StateStore
from statelog.streaming.blocks import ordered_by_shard

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {OPS} select version, op_seq, kh as key_hash, op_type from ops where shard_id = 5")
def shard_ops(spark: SparkSession, d: str) -> DataFrame:
    """Operations of one shard."""
    return C.in_shard(ops_of(spark, d), 5).select("version", "op_seq", hx("key_hash").alias("key_hash"), "op_type")


def _code_ops(spark: SparkSession, d: str) -> DataFrame:
    """Every text stored as bytecode: CREATE operations in the code shard."""
    return X.code_creations(S.code_table(table(spark, d, "documents"), "text").select("code_hash", F.col("value").alias("code")))


@query(f"select distinct {CODE_SHARD}::integer as shard_id, sha256(encode(text)) as key_hash, 3::integer as op_type, octet_length(encode(text))::integer as size from documents where text is not null")
def code_ops(spark: SparkSession, d: str) -> DataFrame:
    return _code_ops(spark, d).select(F.col("shard_id").cast("int").alias("shard_id"), hx("key_hash").alias("key_hash"), F.col("op_type").cast("int").alias("op_type"), F.length("value").alias("size"))


@query(f"with {OPS} select shard_id, count(*) as n_ops from ops group by shard_id")
def data_ops(spark: SparkSession, d: str) -> DataFrame:
    """Operations on data and on code together, then without those on code."""
    both = ops_of(spark, d).select("shard_id", "key_hash", "op_type").unionByName(_code_ops(spark, d).select("shard_id", "key_hash", "op_type"))
    return C.without_code(both).groupBy("shard_id").agg(F.count("*").alias("n_ops"))


@query("""select distinct '0x' || lower(left(hex(key), 40)) as address, lower(substr(hex(key), 41)) as slot, octet_length(key)::integer as size from changes where key is not null""")
def slot_keys(spark: SparkSession, d: str) -> DataFrame:
    """Slot keys taken apart and put together again."""
    k = table(spark, d, "changes").where("key is not null").select(F.substring("key", 1, 20).alias("a"), F.expr("substring(key, 21)").alias("i")).distinct()
    return k.select(F.concat(F.lit("0x"), hx("a")).alias("address"), hx("i").alias("slot"), F.length(slot_key(F.col("a"), F.col("i"))).alias("size"))


_WORD = "array<struct<kind:int,items:array<binary>>>"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """``(task, caller, target, value, access_list)``: a call of each transaction's first written address; transactions at odd places pay."""
    t = A.distinct_txs(table(spark, d, "txs"))
    raw = lambda a: F.unhex(F.substring(a, 3, 1 << 30))
    word = lambda a: F.concat(F.unhex(F.lit("00" * 12)), raw(a))
    hashed = lambda s: F.unhex(F.sha2(F.regexp_replace(s, ":", "").cast("binary"), 256))
    kinds = ((X.READ_ACCOUNT, "rdo", word), (X.WRITE_ACCOUNT, "rnw", word), (X.READ_SLOT, "rdo_slots", hashed), (X.WRITE_SLOT, "rnw_slots", hashed))
    lists = F.array(*[F.struct(F.lit(k).alias("kind"), F.transform(c, f).alias("items")) for k, c, f in kinds], F.struct(F.lit(9).alias("kind"), F.array(F.unhex(F.lit("ff" * 32))).alias("items")))
    value = F.when(F.col("tx_idx") % 2 == 1, F.unhex(F.lit("00" * 31 + "01"))).otherwise(F.unhex(F.lit("00" * 32)))
    return t.select(F.col("txid").alias("task"), raw(F.col("sender")).alias("caller"), raw(F.get("rnw", F.lit(0))).alias("target"), value.alias("value"), lists.cast(_WORD).alias("access_list"))


_RAW = "sha256(unhex(substr({0}, 3)))"


@query(f"""with {_TXS}, first as (select height, tx_idx, tx, min(item) as target from item where mode = 'w' and kind = 'addr' group by all)
select tx as task, 'w' as mode, {_RAW.format("sender")} as hash from tx where sender is not null
union select tx, case when tx_idx % 2 = 1 then 'w' else 'r' end, {_RAW.format("target")} from first
union select tx, mode, case when kind = 'addr' then {_RAW.format("item")} else sha256(item) end from item""")
def call_access(spark: SparkSession, d: str) -> DataFrame:
    """What calls access, from caller, target, value and access list."""
    a = X.call_access(_calls(spark, d).where("caller is not null")).unionByName(X.call_access(_calls(spark, d).where("caller is null")).where("hash is not null"))
    return a.select("task", "mode", hx("hash").alias("hash"))


@query(f"""with {_TXS}, a as (select height, tx_idx, tx, string_agg(replace(item, '0x', ''), ',' order by mode, item) as accounts from item where kind = 'addr' group by all)
select tx.tx as task, coalesce(a.accounts, '') as accounts from tx left join a using (height, tx_idx, tx)""")
def gas_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of access lists that count for gas: those of accounts, not those of slots."""
    return X.gas_access_list(_calls(spark, d)).select("task", F.concat_ws(",", F.transform("accounts", lambda a: F.lower(F.hex(a)))).alias("accounts"))


def _stored_code(spark: SparkSession, d: str) -> DataFrame:
    """Half of the code hashes that accounts name, as if only their code had been stored."""
    h = accounts_of(spark, d).select(account_fields(F.col("value"))["code_hash"].alias("code_hash")).distinct()
    return h.where(F.hex("code_hash") < "8")


_CODE = f"{_ACCOUNTS}, code as (select distinct right(v, 64) as code_hash from acct where right(v, 64) < '8')"
_EMPTY = "('" + "0" * 64 + "', 'c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470')"


@query(f"with {_CODE} select address, right(v, 64) as code_hash, right(v, 64) in {_EMPTY} as is_empty, code.code_hash is not null as stored from acct left join code on code.code_hash = right(v, 64)")
def code_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Accounts with what the code store knows of their code."""
    f = S.code_lookup(accounts_of(spark, d).select("address", account_fields(F.col("value"))["code_hash"].alias("code_hash")), _stored_code(spark, d))
    return f.select(hx("address").alias("address"), hx("code_hash").alias("code_hash"), X.is_empty_code(F.col("code_hash")).alias("is_empty"), "stored")


@query(f"""with {_TXS}, {_CODE}, pick as (select address, row_number() over (order by address) - 1 as k, count(*) over () as n from acct),
calls as (select tx, replace(sender, '0x', '') as caller, {nibble("substr(tx, 3, 1)")} * 16 + {nibble("substr(tx, 4, 1)")} as k from tx),
j as (select c.tx, c.caller, p.address as target from calls c left join pick p on p.k = c.k)
select j.tx as task, case when a.address is null then 'no caller' when t.address is not null and right(t.v, 64) not in {_EMPTY} and code.code_hash is null then 'no bytecode' end as error
from j left join acct a on a.address = j.caller left join acct t on t.address = j.target left join code on code.code_hash = right(t.v, 64)""")
def warm_up_code(spark: SparkSession, d: str) -> DataFrame:
    """Calls whose sender has no account or whose target's bytecode isn't stored; a call's target is one of the first 256 accounts."""
    acc = accounts_of(spark, d)
    first = acc.select("address").orderBy("address").limit(256).withColumn("one", F.lit(1).cast("long")).withColumn("all", F.lit(0))
    first = A.ranged_sum(first, ["all"], ["address"], "one", "k").select("k", F.col("address").alias("target"))
    calls = _calls(spark, d).select("task", "caller", F.conv(F.substring("task", 3, 2), 16, 10).cast("long").alias("k")).join(F.broadcast(first), "k", "left")  # 256 rows
    return X.warm_up(calls, acc, _stored_code(spark, d)).select("task", "error")


@query(f"""with {WHOLE}, b as (select distinct version >> 24 as height from whole where version > 0),
f as (select w.shard_id, b.height, max(w.sn) // 2048 as first_twig from b join whole w on w.version >> 24 <= b.height group by all),
o as (select shard_id, min(sn) as oldest from active where sn >= 4096 group by shard_id)
select f.shard_id, f.height + 10 as height, least(f.first_twig, o.oldest // 2048 - 1) as end_twig from f join o using (shard_id) where f.height % 32 = 0 and least(f.first_twig, o.oldest // 2048 - 1) >= 0""")
def prune_plan(spark: SparkSession, d: str) -> DataFrame:
    """Twig up to which each shard may be pruned after a block: every 32 blocks, but no twig that heights to keep or compaction need.

    Taken as if compaction had moved the sentries, which would hold the first twigs for ever.
    """
    log = cut(L.whole_log(classes_of(spark, d)))
    oldest = L.active_entries(log).where(F.col("sn") >= SENTRIES).groupBy("shard_id").agg(F.min("sn").alias("oldest_active_sn"))
    return K.prune_plan(log, oldest, least=0)


#: Blocks that the feed is committed as in the store queries.
_LOADS = 3


def _store(spark: SparkSession, d: str) -> tuple[StateStore, list[int]]:
    """The feed committed to a store in a folder as a few large blocks; last height of each."""
    feed = table(spark, d, "changes").withColumn("version", F.coalesce("version", C.version_of(F.col("height"), F.col("task_idx"))))
    low, high = feed.agg(F.min("height"), F.max("height")).first()
    store, ends = StateStore(spark, scratch(spark, "store")), []
    if low is None:
        return store, ends
    for k in range(_LOADS):
        a, b = (low + (high + 1 - low) * i // _LOADS for i in (k, k + 1))
        ends.append(b - 1)
        store.commit(feed.where((F.col("height") >= a) & (F.col("height") < b)), b - 1)
    return store, ends


def _end(k: int) -> str:
    """SQL of the height that ends load k, counted from 1."""
    return f"(select min(height) + (max(height) + 1 - min(height)) * {k} // {_LOADS} - 1 from changes)"


def _state_at(end: str, name: str) -> str:
    return f"{name} as (select * from (select *, row_number() over (partition by kh order by version desc, op_seq desc) as r from ops where op_type in (2, 3, 4) and height <= {end}) where r = 1 and op_type <> 4)"


@query(f"with {OPS}, {_state_at(_end(2), 's')} select kh as key_hash, version, op_seq::bigint as op_seq, lower(hex(value)) as value from s")
def store_truncated(spark: SparkSession, d: str) -> DataFrame:
    """Live keys of a store that was rolled back by its last block."""
    store, ends = _store(spark, d)
    if ends:
        store.truncate(ends[1])
    return store.live().select(F.sha2("key", 256).alias("key_hash"), "version", "op_seq", hx("value").alias("value"))


@query(f"with {OPS}, " + ", ".join(_state_at(_end(k), f"s{k}") for k in range(1, _LOADS + 1)) + " " + " union all ".join(f"select {_end(k)} as height, (select count(*) from changes where height <= {_end(k)} and height > coalesce({_end(k - 1) if k > 1 else 'null'}, -1)) as n_ops, (select count(*) from s{k}) as n_live" for k in range(1, _LOADS + 1)))
def store_meta(spark: SparkSession, d: str) -> DataFrame:
    """Commit rows of a store."""
    return _store(spark, d)[0].meta().select("height", "n_ops", "n_live")


@query(f"with {LATEST} select (select count(*) from state) as n_live, (select count(*) from changes where height > {_end(2)}) as n_ops")
def store_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Live keys and operations that stay when all blocks but the last are pruned."""
    store, ends = _store(spark, d)
    if ends:
        store.prune(ends[2])
    return store.live().agg(F.count("*").alias("n_live")).crossJoin(store.ops().agg(F.count("*").alias("n_ops")))  # one row each


@query("""with s as (select distinct shard_id, serial_number as n from changes where shard_id is not null and serial_number is not null),
r as (select *, row_number() over (partition by shard_id order by n) - 1 as k from s) select shard_id, n as released from r where n = k""")
def ordered_chain(spark: SparkSession, d: str) -> DataFrame:
    """The feed as a stream in which each shard takes its operations in the order of their numbers, up to the first that is missing."""
    folder = scratch(spark, "chain")
    feed = spark.readStream.schema(table(spark, d, "changes").schema).parquet(f"{d}/changes.parque[t]")  # a pattern may name a file
    out = ordered_by_shard(feed).select("shard_id", "released").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("shard_id int, released bigint").parquet(f"{folder}/out")


def _uint_sql(seed: str, bits: int, part: str) -> str:
    h = f"substr(sha256('{seed}/' || {part}), 1, 15)"
    return "((" + " + ".join(f"{nibble(f'substr({h}, {i + 1}, 1)')}::bigint * {16 ** (14 - i)}" for i in range(15)) + f") >> {60 - bits})"


def _shuffle_sql(i: str, bits: int) -> str:
    mask = (1 << bits) - 1
    for odd in (0x5851F42D4C957F2D & mask | 1, 0x14057B7EF767814F & mask | 1):
        i = f"((({i})::hugeint * {odd}) % {1 << bits})::bigint"
        i = f"xor({i}, {i} >> {max(1, bits // 2)})"
    return i


@query(f"""with b as (select distinct height from blocks where height is not null)
select height, {_uint_sql("s", 16, "height::varchar")} as n16, {_uint_sql("s", 1, "height::varchar")} = 1 as coin, substr(sha256('s/' || height::varchar), 1, 12) as text, {_shuffle_sql("height % 1048576", 20)} as place from b""")
def random_columns(spark: SparkSession, d: str) -> DataFrame:
    """Random numbers, bits and texts that follow from a seed and a column, and a place in a one-to-one reordering."""
    h = F.col("height")
    b = table(spark, d, "blocks").where("height is not null").select("height").distinct()
    text = F.substring(F.lower(F.hex(W.random_bytes("s", h, bits=256))), 1, 12)
    return b.select("height", W.random_uint("s", 16, h).alias("n16"), W.random_bool("s", h).alias("coin"), text.alias("text"), W.shuffled(F.pmod(h, F.lit(1 << 20)), 20).alias("place"))


@query("""with t as (select row_number() over (order by c_custkey) - 1 as n from customer), k as (select n, unnest(range(4)) as k from t)
select n::integer as tx_idx, sha256('from:' || (n % 50)::varchar) as hash from k union select n::integer, sha256('to:' || (n * 4 + k)::varchar) from k""")
def transfer_workload(spark: SparkSession, d: str) -> DataFrame:
    """Written slots of colliding token transfers, as many tasks as there are customers."""
    n = table(spark, d, "customer").count()
    return W.transfer_accesses(spark, n, 4, 50).select("tx_idx", F.explode("w").alias("hash")).select("tx_idx", hx("hash").alias("hash"))


def _transfers(spark: SparkSession, d: str) -> DataFrame:
    """``(task, k, name, caller, target, amount, fee)``: transactions as transfers in their senders' tasks."""
    t = A.numbered_in_tasks(sets_of(spark, d)).select("height", "tx_idx", "txid", "sender", "task_no", "k")
    targets = A.distinct_txs(table(spark, d, "txs")).select("height", "tx_idx", "txid", F.get("rnw", F.lit(0)).alias("to"), (F.size("rdo_slots") + F.size("rnw_slots")).alias("slots"))
    j = t.where("sender is not null").join(targets, ["height", "tx_idx", "txid"])
    gas = F.lit(X.BASE_GAS).cast("long") + F.col("slots").cast("long") * X.SLOT_GAS
    raw = lambda a: F.unhex(F.substring(a, 3, 40))
    amount = F.concat(F.lit("0000000000000000"), F.substring("txid", 3, 16))  # 64 bits of the id
    return j.select(F.struct("height", "sender", "task_no").alias("task"), "k", F.col("txid").alias("name"), raw(F.col("sender")).alias("caller"), raw(F.col("to")).alias("target"), F.unhex(F.lpad(amount, 64, "0")).alias("amount"), u256.from_decimal(gas.cast("decimal(19,0)") * F.lit(PRICE - BASE_FEE).cast("decimal(19,0)")).alias("fee"))


_U64 = "(" + " + ".join(f"{nibble(f'substr(tx, {i + 3}, 1)')}::hugeint * {16 ** (15 - i)}::hugeint" for i in range(16)) + ")"


@query(f"""with recursive {_TXS}, {_ACCOUNTS},
slots as (select height, tx_idx, tx, count(*) as n from item where kind = 'slot' group by all),
first as (select height, tx_idx, tx, min(item) as target from item where mode = 'w' and kind = 'addr' group by all),
o as (select *, row_number() over (partition by height, sender order by tx_idx, tx) - 1 as place from tx where sender is not null),
k as (
  select o.height, o.sender, o.tx, place // 3 as task_no, place % 3 as k, coalesce(first.target = o.sender, true) as own, {_U64.replace("tx,", "o.tx,")} as amount, {PRICE - BASE_FEE}::hugeint * (21000 + 1900 * coalesce(slots.n, 0)) as fee
  from o left join slots using (height, tx_idx, tx) left join first using (height, tx_idx, tx)),
run(height, sender, task_no, k, name, failed, now) as (
  select k.height, k.sender, k.task_no, k.k, k.tx, a.balance < k.amount + k.fee, case when a.balance < k.amount + k.fee then greatest(a.balance - k.fee, 0) when own then a.balance - k.fee else a.balance - k.fee - k.amount end
  from k join acct a on '0x' || a.address = k.sender where k.k = 0
  union all
  select k.height, k.sender, k.task_no, k.k, k.tx, r.now < k.amount + k.fee, case when r.now < k.amount + k.fee then greatest(r.now - k.fee, 0) when own then r.now - k.fee else r.now - k.fee - k.amount end
  from run r join k on k.height = r.height and k.sender = r.sender and k.task_no = r.task_no and k.k = r.k + 1)
select name as task, failed, now::varchar as balance from run""")
def task_execution(spark: SparkSession, d: str) -> DataFrame:
    """Each sender's tasks run as transfers one after another on its account: what fails is settled in place and the next one sees it."""
    r = X.run_tasks(_transfers(spark, d), accounts_of(spark, d))
    return r.where("is_caller").select(F.col("name").alias("task"), "failed", u256.to_decimal(account_fields(F.col("value"))["balance"]).cast("string").alias("balance"))
