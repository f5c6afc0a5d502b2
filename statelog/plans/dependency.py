"""Queries of the dependency analytics over transactions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statelog.operators import access as A
from statelog.operators import bundling as B
from statelog.plans.sqltext import hex_id
from statelog.runtime import cut, table

QUERIES, SQL = {}, {}

CONFIGS = [(n, bloom) for bloom in (False, True) for n in (32, 64, 128)]


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def hx(c: str) -> F.Column:
    return F.lower(F.hex(c))


_TXS = f"""
blk as (select height, max({hex_id("coinbase")}) as coinbase from blocks group by height),
tx0 as (select *, {hex_id("txid")} as tx from txs where {hex_id("txid")} is not null),
tx as (select height, tx_idx, tx, max({hex_id("from_addr")}) as sender from tx0 group by all),
item as (
  select distinct height, tx_idx, tx, mode, kind, item from (
    select height, tx_idx, tx, 'r' as mode, 'addr' as kind, {hex_id("a")} as item from (select *, unnest(rdo_addr_list) as a from tx0)
    union all select height, tx_idx, tx, 'w', 'addr', {hex_id("a")} from (select *, unnest(rnw_addr_list) as a from tx0)
    union all select height, tx_idx, tx, 'r', 'slot', {hex_id("s.addr")} || s."index" from (select *, unnest(rdo_slot_list) as s from tx0)
    union all select height, tx_idx, tx, 'w', 'slot', {hex_id("s.addr")} || s."index" from (select *, unnest(rnw_slot_list) as s from tx0))
  where item is not null)"""


def _acc(ignore_hottest: bool = False) -> str:
    hot = "and item <> (select item from item where mode = 'w' and kind = 'addr' group by item order by count(*) desc, item desc limit 1)" if ignore_hottest else ""
    return f"""{_TXS},
acc as (
  select distinct height, tx_idx, tx, mode, sha256(item) as hash from item left join blk using (height)
  where mode = 'r' or kind = 'slot' or (item is distinct from coinbase {hot}))"""


def sets_of(spark: SparkSession, d: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    return A.access_sets(table(spark, d, "txs"), table(spark, d, "blocks"), ignore)


@query(f"with {_acc()} select height, tx_idx, mode, hash from acc")
def access_set(spark: SparkSession, d: str) -> DataFrame:
    return A.access_rows(sets_of(spark, d)).select("height", "tx_idx", "mode", hx("hash").alias("hash"))


@query(f"""with {_acc()}, t as (select height, hash, tx_idx, max(mode) = 'w' as writes from acc group by all)
select distinct a.height, a.tx_idx as tx_a, b.tx_idx as tx_b from t a join t b on a.height = b.height and a.hash = b.hash and a.tx_idx < b.tx_idx and (a.writes or b.writes)""")
def tx_collisions(spark: SparkSession, d: str) -> DataFrame:
    return A.collisions(A.access_rows(sets_of(spark, d)))


@query(f"with {_TXS} select item as addr, count(*) as n from item where mode = 'w' and kind = 'addr' group by item")
def addr_write_freq(spark: SparkSession, d: str) -> DataFrame:
    return A.write_frequency(table(spark, d, "txs"))


@query(f"""with {_TXS}, k as (select *, (row_number() over (partition by height, sender order by tx_idx, tx) - 1) // 3 as task_no from tx)
select height, sender, task_no::integer as task_no, min(tx_idx) as first_idx, count(*) as n_txs, string_agg(tx, ',' order by tx_idx, tx) as txids from k group by height, sender, task_no""")
def sender_tasks(spark: SparkSession, d: str) -> DataFrame:
    return A.sender_tasks(table(spark, d, "txs")).withColumn("txids", F.concat_ws(",", "txids"))


@query(f"with {_TXS}, g as (select height, sender, count(*) as n from tx group by all) select sum(n)::bigint as n_txs, count(*) as n_tasks, round(sum(n)::double / count(*), 6) as ratio from g")
def merge_ratio(spark: SparkSession, d: str) -> DataFrame:
    return A.merge_ratio(table(spark, d, "txs"))


@query(f"""with {_TXS}, s as (select height, tx_idx, tx, count(*) as n from item where kind = 'slot' group by all)
select tx.height, tx.tx_idx, tx.tx as txid, coalesce(s.n, 0)::integer as n_slots from tx left join s using (height, tx_idx, tx)""")
def slot_count(spark: SparkSession, d: str) -> DataFrame:
    return A.slot_counts(table(spark, d, "txs"))


_DECLARED = f"""
dec as (
  select distinct {hex_id("txid")} as tx, 'r' as may, lower(hex(h)) as hash from (select txid, unnest(rdo_set) as h from access_sets)
  union select {hex_id("txid")}, 'w', lower(hex(h)) from (select txid, unnest(rnw_set) as h from access_sets)),
task as (select distinct {hex_id("txid")} as tx from access_sets)"""


@query(f"""with {_acc()},{_DECLARED}
select distinct tx as txid, 'read' as kind, hash from acc semi join task using (tx) anti join dec using (tx, hash) where mode = 'r'
union all select distinct tx, 'write', hash from acc semi join task using (tx) anti join (select tx, hash from dec where may = 'w') using (tx, hash) where mode = 'w'""")
def access_violations(spark: SparkSession, d: str) -> DataFrame:
    v = A.violations(sets_of(spark, d), table(spark, d, "access_sets"))
    return v.select("txid", "kind", hx("hash").alias("hash"))


def _swap_sql() -> str:
    """Accesses as if each transaction were declared like the one after it in its block: many violations."""
    return f"""with {_acc()},{_DECLARED},
other as (select tx.tx, lead(tx.tx) over (partition by height order by tx_idx) as of from tx semi join task using (tx)),
wrong as (select o.tx, d.may, d.hash from other o join dec d on d.tx = o.of)
select distinct a.tx as txid, 'read' as kind, a.hash from acc a join other o on o.tx = a.tx and o.of is not null anti join wrong w on w.tx = a.tx and w.hash = a.hash where a.mode = 'r'
union all select distinct a.tx, 'write', a.hash from acc a join other o on o.tx = a.tx and o.of is not null anti join wrong w on w.tx = a.tx and w.hash = a.hash and w.may = 'w' where a.mode = 'w'"""


@query(_swap_sql())
def access_violations_swapped(spark: SparkSession, d: str) -> DataFrame:
    """Violations when the declarations are handed to the wrong transactions: that of the next declared one in the block."""
    sets = sets_of(spark, d)
    declared = table(spark, d, "access_sets").withColumn("name", A.prefixed_hex(F.col("txid")))
    places = sets.select("height", "tx_idx", "txid").join(declared.select(F.col("name").alias("txid")).distinct(), "txid", "left_semi")
    nxt = F.lead("txid").over(Window.partitionBy("height").orderBy("tx_idx"))
    other = places.select(F.col("txid").alias("to"), nxt.alias("name")).where("name is not null")
    handed = declared.join(other, "name").select(F.col("to").alias("txid"), "rdo_set", "rnw_set")
    return A.violations(sets, handed).select("txid", "kind", hx("hash").alias("hash"))


def _serial_sql(ignore_hottest: bool, single: bool) -> str:
    return f"""with recursive {_acc(ignore_hottest)},
num as (select *, (row_number() over (order by height, tx_idx, tx) - 1)::bigint as pos from tx),
t as (select hash, n.pos, max(mode) = 'w' as writes from acc join num n using (height, tx_idx, tx) group by all),
l0 as (
  select hash, pos, writes, lag(pos) over w as touched, max(case when writes then pos end) over (partition by hash order by pos rows between unbounded preceding and 1 preceding) as wrote
  from t window w as (partition by hash order by pos)),
l as (select pos, max(case when writes or {str(single).lower()} then touched else wrote end) as last from l0 group by pos),
c as materialized (select num.pos, coalesce(l.last, -1) as last from num left join l using (pos)),
cut(start) as (
  select min(pos) from c
  union all
  select (select min(c.pos) from c where c.pos > cut.start and c.last >= cut.start) from cut where cut.start is not null)
select (select count(*) from c) as n_txs, count(*) as n_bundles, round((select count(*) from c)::double / count(*), 6) as tlp from cut where start is not null"""


def _serial(name: str, ignore_hottest: bool, single: bool) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        hot = A.hottest(table(spark, d, "txs")) if ignore_hottest else None
        sets = A.numbered(sets_of(spark, d, (hot,) if hot else ()))
        return B.tlp(B.serial_starts(A.last_collision(sets, single)))

    query(_serial_sql(ignore_hottest, single), name)(run)


for _hot in (False, True):
    for _single in (False, True):
        _serial(f"serial_tlp_{'ignore' if _hot else 'keep'}_{'uni' if _single else 'sep'}", _hot, _single)


def reorder_bundles(spark: SparkSession, d: str) -> DataFrame:
    hot = A.hottest(table(spark, d, "txs"))
    return B.reorder(A.numbered(sets_of(spark, d, (hot,) if hot else ())), CONFIGS)


@query()
def reorder_tlp(spark: SparkSession, d: str) -> DataFrame:
    """Reordered bundles of 32, 64 and 128 lanes, with exact sets and with Bloom filters."""
    return B.reorder_tlp(reorder_bundles(spark, d))


@query()
def reorder_tlp_tasks(spark: SparkSession, d: str) -> DataFrame:
    """As :func:`reorder_tlp` over the tasks of each sender, whose transactions' sets are united."""
    hot = A.hottest(table(spark, d, "txs"))
    return B.reorder_tlp(B.reorder(A.task_sets(sets_of(spark, d, (hot,) if hot else ())), CONFIGS))


def _positions(h: str) -> str:
    """SQL list of the five filter positions of a hash as hex text."""
    bit = lambda at: f"((strpos('0123456789abcdef', substr({h}, {16 - at // 4}, 1)) - 1) // {1 << at % 4} % 2)"
    return "[" + ", ".join("(" + " + ".join(f"{bit(11 * j + b)} * {1 << b}" for b in range(11)) + ")::integer" for j in range(5)) + "]"


_LANE = "struct(r integer[], w integer[], m integer[], nr bigint, nw bigint)"
_HITS = "len(list_filter(s.r, lambda h: list_has_all(l.w, h))) > 0 or len(list_filter(s.w, lambda h: list_has_all(l.w, h) or list_has_all(l.r, h))) > 0"


@query(f"""with recursive {_acc()},
hashed as (select height, tx_idx, mode, hash, {_positions("hash")} as p from acc),
side as (select height, tx_idx, mode, list(p) as p, list(left(hash, 16)) as k from hashed group by all),
s as materialized (
  select tx.height, tx.tx_idx, row_number() over (partition by tx.height order by tx.tx_idx) as k, count(*) over (partition by tx.height) as n,
    coalesce(r.p, []) as r, coalesce(w.p, []) as w, coalesce(r.k, []) as rk, coalesce(w.k, []) as wk
  from tx left join side r on r.height = tx.height and r.tx_idx = tx.tx_idx and r.mode = 'r' left join side w on w.height = tx.height and w.tx_idx = tx.tx_idx and w.mode = 'w'),
run(height, k, lanes, done) as (
  select distinct height, 0::bigint, []::{_LANE}[], []::integer[][] from s
  union all
  select height, k, case when closes then list_transform(put, lambda l, j: case when j = i then {{'r': []::integer[], 'w': []::integer[], 'm': []::integer[], 'nr': 0::bigint, 'nw': 0::bigint}} else l end) else put end, case when closes then done || [put[i].m] else done end
  from (
    select *, k < n and (put[i].nr > 256 or put[i].nw > 256 or len(put[i].m) >= 64) as closes from (
      select *, list_transform(case when i > len(lanes) then lanes || [{{'r': []::integer[], 'w': []::integer[], 'm': []::integer[], 'nr': 0::bigint, 'nw': 0::bigint}}] else lanes end, lambda l, j: case when j = i then
        {{'r': list_distinct(l.r || flatten(r)), 'w': list_distinct(l.w || flatten(w)), 'm': l.m || [tx_idx], 'nr': l.nr + len(r), 'nw': l.nw + len(w)}} else l end) as put from (
        select run.height, s.k, s.n, s.tx_idx, s.r, s.w, run.lanes, run.done, coalesce(list_position(list_transform(run.lanes, lambda l: {_HITS}), false), len(run.lanes) + 1) as i
        from run join s on s.height = run.height and s.k = run.k + 1)))),
bundles as (select run.height, unnest(run.done || list_transform(list_filter(run.lanes, lambda l: len(l.m) > 0), lambda l: l.m)) as m, generate_subscripts(run.done || list_transform(list_filter(run.lanes, lambda l: len(l.m) > 0), lambda l: l.m), 1) as b
  from run join (select height, max(n) as n from s group by height) e on e.height = run.height and run.k = e.n),
flat as (select height, b, unnest(m) as tx_idx, generate_subscripts(m, 1) as slot from bundles),
o as (select *, row_number() over (partition by height order by b, slot) - 1 as out_idx from flat),
o2 as (select o.*, min(out_idx) over (partition by height, b) as start from o),
q as (select o2.*, s.rk, s.wk from o2 join s using (height, tx_idx)),
hit as (
  select a.height, a.out_idx, max(b.out_idx) as j from q a join q b on a.height = b.height and b.out_idx < a.start and b.out_idx >= a.start - 128
    and (list_has_any(b.wk, a.rk) or list_has_any(b.wk, a.wk) or list_has_any(b.rk, a.wk)) group by all)
select q.height, q.out_idx::integer as out_idx, q.tx_idx, q.start::integer as bundle_start, coalesce(hit.j, greatest(q.start - 129, 0))::integer as all_done_idx, false as failed from q left join hit using (height, out_idx)""")
def exec_schedule(spark: SparkSession, d: str) -> DataFrame:
    return B.block_schedules(sets_of(spark, d))


@query(f"""with recursive {_acc()}, t as (select height, hash, tx_idx, max(mode) = 'w' as writes from acc group by all),
dep as materialized (select distinct a.height, a.tx_idx as a, b.tx_idx as b from t a join t b on a.height = b.height and a.hash = b.hash and a.tx_idx < b.tx_idx and (a.writes or b.writes)),
path(height, tx_idx, n) as (
  select height, tx_idx, 1 from tx
  union
  select p.height, d.b, p.n + 1 from path p join dep d on d.height = p.height and d.a = p.tx_idx)
select height, tx_idx, max(n)::integer as wave from path group by all""")
def dependency_waves(spark: SparkSession, d: str) -> DataFrame:
    return B.waves(sets_of(spark, d))


@query(f"""with {_acc()}, t as (select height, hash, tx_idx, max(mode) = 'w' as writes from acc group by all),
c as (select distinct a.height, a.tx_idx as a, b.tx_idx as b from t a join t b on a.height = b.height and a.hash = b.hash and a.tx_idx < b.tx_idx and (a.writes or b.writes)),
n as (select height, count(*) as n from tx group by height)
select n.height, n.n as n_txs, coalesce(sum(case when c.a is not null then 1 else 0 end), 0)::bigint as n_pairs, n.n * (n.n - 1) // 2 - coalesce(sum(case when c.a is not null then 1 else 0 end), 0)::bigint as n_free
from n left join c using (height) group by n.height, n.n""")
def tlp_unordered_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Colliding and independent pairs of each block."""
    sets = cut(sets_of(spark, d))
    n = sets.groupBy("height").agg(F.count("*").alias("n_txs"))
    c = A.collisions(A.access_rows(sets)).groupBy("height").agg(F.count("*").alias("n_pairs"))
    return n.join(c, "height", "left").na.fill(0, ["n_pairs"]).withColumn("n_free", F.expr("n_txs * (n_txs - 1) div 2 - n_pairs"))
