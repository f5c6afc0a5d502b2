"""Queries p4, p5 and p7 with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelog.operators.activity import activity_by_key
from statelog.operators.changefeed import apply_changes, live, publish
from statelog.operators.history import value_history
from statelog.runtime import scratch, table


def p4_by_key(spark: SparkSession, d: str) -> DataFrame:
    return activity_by_key(table(spark, d, "txs"), table(spark, d, "blocks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    h = value_history(table(spark, d, "entry_log"), values=False)
    return h.select(F.lower(F.hex("key")).alias("key_hex"), "valid_from", "valid_to")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    state = publish(apply_changes(table(spark, d, "changes")), scratch(spark, "state"))
    return live(state).select(F.lower(F.hex("key")).alias("key_hex"), "version", "op_seq")


QUERIES = {"p4_by_key": p4_by_key, "p5_found": p5_found, "p7_found": p7_found}


def hex_sql(e: str) -> str:
    """DuckDB text of the canonical spelling with 0x in front; null for blank text."""
    s = f"regexp_replace(lower(trim({e}, e' \\t\\n\\r\\f\\v')), '^0x', '')"
    return f"'0x' || nullif({s}, '')"


SQL = {
    "p4_by_key": f"""
with b as (select height, max({hex_sql("coinbase")}) as coinbase from blocks group by height),
t as (select distinct height, {hex_sql("txid")} as tx, rnw_addr_list from txs),
r as (
  select 'coinbase' as field, b.coinbase as key, t.height, t.tx from t left join b using (height)
  union
  select 'rnw_addr_list', {hex_sql("a")}, height, tx from (select height, tx, unnest(rnw_addr_list) as a from t) where {hex_sql("a")} is not null)
select field, key, count(distinct tx) as n_txs, count(distinct height) as n_blocks, min(height) as first_height, max(height) as last_height
from r group by field, key""",
    "p5_found": """
with e as (
  select shard_id, sn, max(key) as key, max(value) as value, max(version) as version, max(last_version) as last_version, max(dsn) as dsn
  from entry_log group by shard_id, sn),
d as (select shard_id, unnest(dsn) as sn, key as by_key, version as by_version, sn as by_sn from e),
points as (
  select key, version, value, sn as set_sn, null::bigint as end_sn from e
  union all select e.key, d.by_version, null, null, d.by_sn from d join e using (shard_id, sn) where d.by_key <> e.key
  union all select key, last_version, null, null, null from e where last_version >= 0),
p0 as (select key, version, max(value) as value, max(set_sn) as set_sn, max(end_sn) as end_sn from points group by key, version),
p as (select key, version, set_sn is not null and (end_sn is null or end_sn < set_sn) as sets, end_sn is not null as ends, value from p0),
m as (select *, lag(sets) over w as sets0, lag(case when sets then value end) over w as value0 from p window w as (partition by key order by version)),
c as (select key, version, sets from m where sets0 is null or sets0 <> sets or ends or (case when sets then value end) is distinct from value0),
n as (select *, lead(version) over (partition by key order by version) as next from c)
select lower(hex(key)) as key_hex, version as valid_from, coalesce(next, -1) as valid_to from n where sets""",
    "p7_found": """
with c as (select key, coalesce(version, (height::bigint << 24) + task_idx) as version, op_seq::bigint as op_seq, op_type from changes where op_type in (2, 3, 4)),
l as (select key, version, op_seq, op_type, row_number() over (partition by key order by version desc, op_seq desc) as r from c)
select lower(hex(key)) as key_hex, version, op_seq from l where r = 1 and op_type <> 4""",
}
