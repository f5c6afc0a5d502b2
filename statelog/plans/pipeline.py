"""Queries of execution, compaction, recovery, sources and streaming, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelog.functions import u256
from statelog.functions.codec import account_fields
from statelog.functions.spelling import bare_hex
from statelog.operators import access as A
from statelog.operators import compaction as K
from statelog.operators import execution as X
from statelog.operators import log as L
from statelog.operators import merkle as M
from statelog.operators import state as S
from statelog.operators.activity import distinct_blocks
from statelog.operators.changefeed import live
from statelog.plans.dependency import _TXS
from statelog.plans.sqltext import LATEST, OPS, nibble
from statelog.plans.store import _AS_OF, asof_query, classes_of, hx, ops_of
from statelog.plans.store import _then as _before
from statelog.runtime import cut, scratch, table
from statelog.sources import blocks as J
from statelog.streaming.blocks import stream_state as run_stream

QUERIES, SQL = {}, {}

#: Fee model of the queries: price a unit of gas and base fee.
PRICE, BASE_FEE = 7_000_000_007, 5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _then(version: int) -> str:
    """State before a version, as CTE ``s0``."""
    return f"s0 as (select * from (select *, row_number() over (partition by kh order by version desc, op_seq desc) as r from ops where op_type in (2, 3, 4) and version < {version}) where r = 1 and op_type <> 4)"


@asof_query(f"""with {LATEST}, {_then(_AS_OF)},
a as (select kh, key, value from s0 where value is not null and hex(value) <> repeat('0', 64)), b as (select kh, key, value from state where value is not null and hex(value) <> repeat('0', 64)),
j as (select coalesce(a.kh, b.kh) as key_hash, a.value as was, b.value as now from a full join b on a.kh = b.kh)
select {nibble("left(key_hash, 1)")}::integer as shard_id, key_hash, (case when was is null then 3 when now is null then 4 else 2 end)::integer as op_type, lower(hex(now)) as value from j where was is null or now is null or was <> now""", QUERIES, SQL)
def diff_to_ops(spark: SparkSession, d: str, height: int) -> DataFrame:
    """Operations that lead from the state before a height to the latest one."""
    ops = ops_of(spark, d)
    out = X.diff_ops(_before(spark, d, height).select("key", "value"), S.latest(ops).select("key", "value"))
    return out.select("shard_id", hx("key_hash").alias("key_hash"), "op_type", hx("value").alias("value"))


def accounts_of(spark: SparkSession, d: str) -> DataFrame:
    """``(address, value)``: last account row of each key of the entry log."""
    last = F.max(F.struct("version", "value")).alias("l")
    return table(spark, d, "entry_log").where("value is not null").groupBy(F.col("key").alias("address")).agg(last).select("address", "l.value")


def _u64_sql(digits: str) -> str:
    return "(" + " + ".join(f"{nibble(f'substr({digits}, {i + 1}, 1)')}::hugeint * {16 ** (15 - i)}::hugeint" for i in range(16)) + ")"


def _u128_sql(hex64: str) -> str:
    """Lower 128 bits of 64 hex digits; balances and fees here are well below."""
    return f"({_u64_sql(f'substr({hex64}, 33, 16)')} * 18446744073709551616::hugeint + {_u64_sql(f'substr({hex64}, 49, 16)')})"


_ACCOUNTS = f"acct as (select lower(hex(key)) as address, lower(hex(max_by(value, version))) as v, {_u128_sql('left(lower(hex(max_by(value, version))), 64)')} as balance from entry_log where value is not null group by key)"
_FEES = f"""{_TXS},
slots as (select height, tx_idx, tx, count(*) as n from item where kind = 'slot' group by all),
fee as (
  select tx.height, tx.tx_idx, tx.tx, replace(tx.sender, '0x', '') as caller, 21000 + 1900 * coalesce(slots.n, 0) as gas, ({PRICE - BASE_FEE}::hugeint * (21000 + 1900 * coalesce(slots.n, 0))) as fee
  from tx left join slots using (height, tx_idx, tx))"""


def _fee_txs(spark: SparkSession, d: str) -> DataFrame:
    """``(task, height, caller, price, gas_limit)``: what each transaction would pay at most."""
    t = A.distinct_txs(table(spark, d, "txs"))
    gas = X.initial_gas((F.size("rdo_slots") + F.size("rnw_slots")).cast("long"), F.lit(1 << 40))
    price = X.gas_price(F.lit(PRICE).cast("long"), F.lit(BASE_FEE).cast("long"))
    return t.select(F.col("txid").alias("task"), "height", F.unhex(F.substring("sender", 3, 40)).alias("caller"), price.alias("price"), gas.alias("gas_limit"))


@query(f"with {_FEES}, {_ACCOUNTS} select fee.tx as txid, balance < fee as overdrawn, (greatest(balance - fee, 0))::varchar as left_over from fee join acct on acct.address = fee.caller")
def settlement(spark: SparkSession, d: str) -> DataFrame:
    """Each transaction settled as a failed one against its sender's account: what is left of the balance."""
    acc = accounts_of(spark, d)
    s = X.settle_failures(_fee_txs(spark, d), acc).join(acc.select(F.col("address").alias("caller"), F.col("value").alias("was")), "caller")
    f = account_fields(F.col("value"))
    return s.select(F.col("task").alias("txid"), (f["balance"] == F.unhex(F.lit("00" * 32))).alias("overdrawn"), u256.to_decimal(f["balance"]).cast("string").alias("left_over"))


@query(f"with {_FEES}, t as (select height, sum(fee)::hugeint as fees from fee group by height) select height, replace(coinbase, '0x', '') as coinbase, fees::varchar as fees from t join blk using (height) where coinbase is not null")
def fee_reward(spark: SparkSession, d: str) -> DataFrame:
    """Fees that each block's coinbase collects."""
    t = _fee_txs(spark, d).withColumn("paid", u256.from_decimal(F.col("price").cast("decimal(19,0)") * F.col("gas_limit").cast("decimal(19,0)")))
    coinbases = distinct_blocks(table(spark, d, "blocks")).select("height", F.unhex(bare_hex(F.col("coinbase"))).alias("coinbase"))
    r = X.block_rewards(t, coinbases, accounts_of(spark, d))
    return r.select("height", hx("coinbase").alias("coinbase"), u256.to_decimal(F.col("fees")).cast("string").alias("fees"))


@query(f"with {_FEES}, {_ACCOUNTS} select fee.tx as txid, case when acct.address is null then 'no caller' end as error from fee left join acct on acct.address = fee.caller")
def warm_up(spark: SparkSession, d: str) -> DataFrame:
    """Transactions whose sender has no account; transfers need no bytecode."""
    calls = _fee_txs(spark, d).withColumn("target", F.lit(None).cast("binary"))
    return X.warm_up(calls, accounts_of(spark, d)).select(F.col("task").alias("txid"), "error")


@query(f"""with {OPS}, t as (select distinct height, task_idx from ops), k as (select *, row_number() over (partition by height order by task_idx) - 1 as k from t)
select height, coalesce(max(case when k = task_idx then task_idx end), -1)::integer as all_done from k group by height""")
def completed_prefix(spark: SparkSession, d: str) -> DataFrame:
    return X.completed_prefix(ops_of(spark, d))


@query()
def compaction_log(spark: SparkSession, d: str) -> DataFrame:
    """Serial numbers with compaction from a thousand entries on, as soon as two hundredths of the log are dead."""
    out = K.compacted_log(L.touch_rows(classes_of(spark, d)), 102, 100, 1000)
    return out.select("shard_id", "sn", hx("entity").alias("entity"), "kind", "version", "op_seq", F.concat_ws(",", F.col("dsn").cast("array<string>")).alias("dsn"))


@query("select 0::integer as shard_id where false")
def recovery_check(spark: SparkSession, d: str) -> DataFrame:
    """Shards whose root can't be rebuilt after pruning from the twigs and edge nodes that stay: none."""
    log = cut(L.whole_log(classes_of(spark, d)))
    nodes = cut(M.all_nodes(log, cut(L.active_entries(log))))
    youngest = log.groupBy("shard_id").agg(F.max(F.shiftright("sn", 11)).alias("end"))
    left = cut(K.pruned_nodes(nodes, youngest))
    roots = K.recovered_roots(left.where("level = 12 and not is_edge"), left.where("is_edge"))
    return K.recovery_mismatches(roots, M.roots_of(nodes))


@query(f"""with {_TXS}, h as (select distinct height from blk)
select height, tx as txid, sender as from_addr, (select count(*) from item i where i.height = tx.height and i.tx_idx = tx.tx_idx and i.tx = tx.tx and i.mode = 'w' and i.kind = 'addr')::integer as n_rnw,
  (row_number() over (partition by height order by tx_idx, tx) - 1)::integer as tx_idx from tx semi join h using (height)""")
def json_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Transactions written as nested JSON blocks and read back."""
    t = A.distinct_txs(table(spark, d, "txs"))
    slots = lambda c: F.transform(c, lambda s: F.struct(F.substring_index(s, ":", 1).alias("addr"), F.substring_index(s, ":", -1).alias("index")))
    t = t.select("height", "tx_idx", "txid", F.col("sender").alias("from_addr"), F.col("rdo").alias("rdo_addr_list"), F.col("rnw").alias("rnw_addr_list"), slots("rdo_slots").alias("rdo_slot_list"), slots("rnw_slots").alias("rnw_slot_list"))
    path = scratch(spark, "json")
    J.write_blocks(t, distinct_blocks(table(spark, d, "blocks")).select("height", "coinbase"), path)
    back = J.block_txs(J.read_blocks(spark, path, multi_line=False))
    return back.select("height", "tx_idx", "txid", "from_addr", F.size("rnw_addr_list").alias("n_rnw"))


@query(f"with {LATEST} select kh as key_hash, version, op_seq::bigint as op_seq from state")
def stream_state(spark: SparkSession, d: str) -> DataFrame:
    """The change feed read as a stream of files and upserted batch by batch."""
    folder = scratch(spark, "stream")
    state = run_stream(spark, f"{d}/changes.parque[t]", table(spark, d, "changes").schema, folder, f"{folder}/checkpoint")  # a pattern may name a file
    return live(state).select(F.sha2("key", 256).alias("key_hash"), "version", "op_seq")
