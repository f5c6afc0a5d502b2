"""Queries of the state store over the change feed, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelog.functions.codec import entry_fields, key_hash, sha256
from statelog.functions.hashing import null_left, null_upper
from statelog.operators import changes as C
from statelog.operators import log as L
from statelog.operators import merkle as M
from statelog.operators import state as S
from statelog.plans import sqltext as T
from statelog.runtime import cut, table

QUERIES, SQL = {}, {}

#: Stands in the as-of queries' SQL for the middle height of the feed.
AS_OF_HEIGHT = 7_000_010
_AS_OF = AS_OF_HEIGHT << 24
_MIDDLE = "(select (min(height) + max(height) + 1) // 2 from changes)"


def query(sql: str | None = None):
    """Register a query by its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def middle_height(spark: SparkSession, d: str) -> int:
    """Middle of the heights of the change feed; 0 for an empty one."""
    low, high = table(spark, d, "changes").agg(F.min("height"), F.max("height")).first()
    return 0 if low is None else (low + high + 1) // 2


def _at_middle(sql: str) -> str:
    sql = sql.replace(str(_AS_OF), f"({_MIDDLE} << 24)")
    for k in range(3):
        sql = sql.replace(str(AS_OF_HEIGHT + k), f"({_MIDDLE} + {k})")
    return sql


def asof_query(sql: str, queries: dict = QUERIES, sqls: dict = SQL):
    """Register a query ``(spark, d, height)`` by its function's name, as of the middle height of the feed, so its state grows with the data."""

    def add(f):
        queries[f.__name__] = lambda spark, d: f(spark, d, middle_height(spark, d))
        sqls[f.__name__] = _at_middle(sql)
        return f

    return add


def hx(c: str) -> F.Column:
    return F.lower(F.hex(c))


def ops_of(spark: SparkSession, d: str) -> DataFrame:
    return C.ordered_ops(table(spark, d, "changes"))


def classes_of(spark: SparkSession, d: str) -> DataFrame:
    return C.classified(ops_of(spark, d))


@query(f"""with {T.OPS} select height, task_idx, cset_idx, shard_id, kh as key_hash, op_seq, op_type,
  row_number() over (partition by height, task_idx, cset_idx order by shard_id, kh, op_seq)::integer as pos from ops""")
def change_sort(spark: SparkSession, d: str) -> DataFrame:
    return C.sorted_ops(ops_of(spark, d)).select("height", "task_idx", "cset_idx", "shard_id", hx("key_hash").alias("key_hash"), "op_seq", "op_type", "pos")


@query(f"with {T.OPS} select shard_id, count(*) as n_ops from ops group by shard_id")
def shard_routing(spark: SparkSession, d: str) -> DataFrame:
    return C.shard_count_check(ops_of(spark, d)).where("n_ops > 0")


@query(f"with {T.CLASSES} select lower(hex(key)) as key, version, op_seq, effect from cls")
def upsert_classify(spark: SparkSession, d: str) -> DataFrame:
    return classes_of(spark, d).select(hx("key").alias("key"), "version", "op_seq", "effect")


@query(f"with {T.CLASSES} select height, count(*) as n_changes, sum(case effect when 'create' then 2 when 'write' then 1 else 0 end)::bigint as n_compacts from cls where effect <> 'noop' group by height")
def change_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.change_counts(classes_of(spark, d))


def _then(spark: SparkSession, d: str, height: int) -> DataFrame:
    """State before a height. Versions begin with the height, so the scan skips what lies above by its statistics."""
    before = table(spark, d, "changes").where((F.col("height") < height) | F.col("height").isNull())
    return S.as_of(C.ordered_ops(before), height << 24)


def _state_columns(s: DataFrame) -> DataFrame:
    return s.select("shard_id", hx("key_hash").alias("key_hash"), hx("key").alias("key"), hx("value").alias("value"), "version", "op_seq")


_STATE = "select shard_id, kh as key_hash, lower(hex(key)) as key, lower(hex(value)) as value, version, op_seq from state"


@query(f"with {T.LATEST} {_STATE}")
def state_latest(spark: SparkSession, d: str) -> DataFrame:
    return _state_columns(S.latest(ops_of(spark, d)))


_THEN = T.LATEST.replace("where op_type in (2, 3, 4)", f"where op_type in (2, 3, 4) and version < {_AS_OF}")


@asof_query(f"with {_THEN} {_STATE}")
def state_asof(spark: SparkSession, d: str, height: int) -> DataFrame:
    return _state_columns(_then(spark, d, height))


def _probes(spark: SparkSession, d: str) -> DataFrame:
    """Every key that the feed ever names."""
    return ops_of(spark, d).select("key_hash", "key").distinct()


@asof_query(f"""with {_THEN}, p as (select distinct kh, key from ops)
select p.kh as key_hash, s.kh is not null as found, coalesce(octet_length(s.value), 0)::integer as size, lower(hex(s.value)) as value from p left join state s on s.kh = p.kh""")
def point_lookup(spark: SparkSession, d: str, height: int) -> DataFrame:
    found = S.point_lookup(_probes(spark, d), _then(spark, d, height))
    return found.select(hx("key_hash").alias("key_hash"), "found", "size", hx("value").alias("value"))


@asof_query(f"with {_THEN} select distinct ops.kh as key_hash from ops semi join state on state.kh = ops.kh")
def key_exists(spark: SparkSession, d: str, height: int) -> DataFrame:
    return S.existing(_probes(spark, d), _then(spark, d, height)).select(hx("key_hash").alias("key_hash"))


@asof_query(f"with {_THEN} select distinct ops.kh as key_hash from ops anti join state on state.kh = ops.kh")
def key_missing(spark: SparkSession, d: str, height: int) -> DataFrame:
    return S.missing(_probes(spark, d), _then(spark, d, height)).select(hx("key_hash").alias("key_hash"))


def _chain(spark: SparkSession, d: str, height: int) -> DataFrame:
    return S.with_successor(_then(spark, d, height), S.sentry_keys(spark))


_CHAIN = f"{_THEN},{T.SENTRIES}, keys as (select kh from state union all select kh from sentry), chain as (select kh, coalesce(lead(kh) over (order by kh), repeat('f', 64)) as next_kh from keys)"


@asof_query(f"with {_CHAIN} select kh as key_hash, next_kh as next_key_hash from chain")
def successor_next_hash(spark: SparkSession, d: str, height: int) -> DataFrame:
    return _chain(spark, d, height).select(hx("key_hash").alias("key_hash"), hx("next_key_hash").alias("next_key_hash"))


@asof_query(f"""with {_CHAIN}, p as (select distinct kh from ops)
select p.kh as key_hash, c.kh as prev_key_hash, exists (select 1 from state s where s.kh = p.kh) as exists from p asof join chain c on p.kh > c.kh""")
def predecessor(spark: SparkSession, d: str, height: int) -> DataFrame:
    p = S.predecessors(_probes(spark, d).select("key_hash"), _chain(spark, d, height))
    return p.select(hx("key_hash").alias("key_hash"), hx("prev_key_hash").alias("prev_key_hash"), "exists")


@asof_query(f"""with {_CHAIN}, p as (select distinct kh from ops anti join state on state.kh = ops.kh)
select p.kh as key_hash, c.kh as prev_key_hash, c.next_kh as next_key_hash from p asof join chain c on p.kh > c.kh""")
def not_exists(spark: SparkSession, d: str, height: int) -> DataFrame:
    n = S.non_existence(_probes(spark, d).select("key_hash"), _chain(spark, d, height))
    return n.select(*[hx(c).alias(c) for c in ("key_hash", "prev_key_hash", "next_key_hash")])


@asof_query(f"""with {_CHAIN}
select version, op_seq, ops.kh as key_hash, ops.kh as read_hash from ops semi join state on state.kh = ops.kh where op_type in (1, 2)
union all
select version, op_seq, o.kh, c.kh from (select * from ops where op_type in (3, 4)) o asof join chain c on o.kh > c.kh""")
def op_lookup(spark: SparkSession, d: str, height: int) -> DataFrame:
    then = _then(spark, d, height)
    return S.op_lookup(ops_of(spark, d), then, _chain(spark, d, height)).select("version", "op_seq", hx("key_hash").alias("key_hash"), hx("read_hash").alias("read_hash"))


@query(f"with {T.LATEST} {_STATE} where kh >= '40' || repeat('0', 62) and kh < '80' || repeat('0', 62)")
def range_scan(spark: SparkSession, d: str) -> DataFrame:
    return _state_columns(S.range_scan(S.latest(ops_of(spark, d)), b"\x40" + bytes(31), b"\x80" + bytes(31)))


@query(f"with {T.LATEST} select shard_id, count(*) as n_keys, sum(octet_length(value))::bigint as value_bytes, min(version) as first_version, max(version) as last_version from state group by shard_id")
def shard_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.shard_stats(S.latest(ops_of(spark, d)))


def _layer_sql(height: int, width: int) -> str:
    return f"select kh, case when op_type <> 4 then value end as value from (select *, row_number() over (partition by kh order by version desc, op_seq desc) as r from ops where op_type in (2, 3, 4) and height >= {height - width} and height < {height}) where r = 1"


@asof_query(f"""with {_THEN}, p as (select distinct kh from ops), l0 as ({_layer_sql(AS_OF_HEIGHT + 2, 1)}), l1 as ({_layer_sql(AS_OF_HEIGHT + 1, 1)}),
j as (select p.kh, case when l0.kh is not null then 0 when l1.kh is not null then 1 when s.kh is not null then 2 end::integer as layer, l0.value as v0, l1.value as v1, s.value as v2
  from p left join l0 on l0.kh = p.kh left join l1 on l1.kh = p.kh left join state s on s.kh = p.kh)
select kh as key_hash, layer, lower(hex(case layer when 0 then v0 when 1 then v1 when 2 then v2 end)) as value from j""")
def overlay_lookup(spark: SparkSession, d: str, height: int) -> DataFrame:
    """Reads through the overlays of two blocks in flight and the store below them."""
    ops = ops_of(spark, d)
    layers = [S.overlay(ops, height + 2, 1).select("key_hash", "value"), S.overlay(ops, height + 1, 1).select("key_hash", "value"), _then(spark, d, height).select("key_hash", "value")]
    return S.layered(_probes(spark, d).select("key_hash"), layers).select(hx("key_hash").alias("key_hash"), "layer", hx("value").alias("value"))


@query("select sha256(encode(text)) as code_hash, octet_length(encode(text))::integer as size from documents where text is not null group by all")
def code_dedup(spark: SparkSession, d: str) -> DataFrame:
    return S.code_table(table(spark, d, "documents"), "text").select(hx("code_hash").alias("code_hash"), F.length("value").alias("size"))


@query(f"with {T.SENTRIES} select shard_id, sn, kh as key_hash, next_kh as next_key_hash from sentry")
def sentries(spark: SparkSession, d: str) -> DataFrame:
    return S.sentry_keys(spark).select("shard_id", "sn", hx("key_hash").alias("key_hash"), hx("next_key_hash").alias("next_key_hash"))


@query(f"with {T.OPS} select distinct lower(hex(key)) as key, kh as key_hash, left(kh, 16) as k64, shard_id from ops")
def key_hashes(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "changes").where("key is not null").select("key").distinct().withColumn("h", key_hash(F.col("key")))
    return k.select(hx("key").alias("key"), hx("h").alias("key_hash"), F.lower(F.hex(F.substring("h", 1, 8))).alias("k64"), C.shard_of(F.col("h")).alias("shard_id"))


@query(f"with {T.LOG} select shard_id, sn, entity, key, value, next_kh as next_key_hash, version, last_version, kind, array_to_string(dsn, ',') as dsn from log")
def log_entries(spark: SparkSession, d: str) -> DataFrame:
    """Serial numbers, links, versions and replaced entries of every appended entry."""
    log = L.entry_log(classes_of(spark, d), positions=False)
    return log.select("shard_id", "sn", hx("entity").alias("entity"), hx("key").alias("key"), hx("value").alias("value"), hx("next_key_hash").alias("next_key_hash"), "version", "last_version", "kind", F.concat_ws(",", F.col("dsn").cast("array<string>")).alias("dsn"))


@query(f"""with {T.LOG}, n as (select *, (((61 + length(key) // 2 + length(value) // 2) + 7) // 8 * 8 + 8 * len(dsn))::bigint as length from log)
select shard_id, sn, length, (393216 + coalesce(sum(length) over (partition by shard_id order by sn rows between unbounded preceding and 1 preceding), 0))::bigint as file_pos from n""")
def file_positions(spark: SparkSession, d: str) -> DataFrame:
    return L.entry_log(classes_of(spark, d)).select("shard_id", "sn", "length", "file_pos")


@query(f"with {T.LOG} select shard_id, sn, {T.entry_hex()} as entry, sha256(unhex({T.entry_hex()})) as leaf from log")
def entry_encode(spark: SparkSession, d: str) -> DataFrame:
    e = L.encoded(L.entry_log(classes_of(spark, d), positions=False))
    return e.select("shard_id", "sn", hx("entry").alias("entry"), F.lower(F.hex(sha256(F.col("entry")))).alias("leaf"))


@query(f"with {T.LOG} select shard_id, sn, key, value, next_kh as next_key_hash, version, last_version, array_to_string(dsn, ',') as dsn from log")
def entry_decode(spark: SparkSession, d: str) -> DataFrame:
    """Fields read back from the serialised entries."""
    f = entry_fields(F.col("entry"))
    e = L.encoded(L.entry_log(classes_of(spark, d), positions=False)).select("shard_id", *[c.alias(k) for k, c in f.items()])
    return e.select("shard_id", "sn", hx("key").alias("key"), hx("value").alias("value"), hx("next_key_hash").alias("next_key_hash"), "version", "last_version", F.concat_ws(",", F.col("dsn").cast("array<string>")).alias("dsn"))


@query(f"with {T.WHOLE} select shard_id, sn, entity, version from active where sn >= 4096 or version > 0")
def active_log(spark: SparkSession, d: str) -> DataFrame:
    a = L.active_entries(cut(L.whole_log(classes_of(spark, d))))
    return a.where("sn >= 4096 or version > 0").select("shard_id", "sn", hx("entity").alias("entity"), "version")


@query(f"""with {T.WHOLE}, e as (select shard_id, max(sn) + 1 as next_sn from whole group by shard_id), a as (select shard_id, count(*) as n_active, min(sn) as oldest_active_sn from active group by shard_id)
select shard_id, next_sn, n_active, oldest_active_sn, (next_sn - oldest_active_sn) * 128 >= n_active * 256 and next_sn - oldest_active_sn >= 200000 as compactible from e join a using (shard_id)""")
def active_stats(spark: SparkSession, d: str) -> DataFrame:
    return L.active_stats(cut(L.whole_log(classes_of(spark, d))))


def _log_and_active(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    log = cut(L.whole_log(classes_of(spark, d)))
    return log, cut(L.active_entries(log))


_TREES = T.trees(null_left(0).hex())


@query(f"with {_TREES} select shard_id, nth as twig, h as left_root from l11")
def twig_left_root(spark: SparkSession, d: str) -> DataFrame:
    t = M.left_trees(M.leaf_hashes(cut(L.whole_log(classes_of(spark, d)))))
    return t.select("shard_id", "twig", F.lower(F.hex(F.get("h11", F.lit(0)))).alias("left_root"))


@query(f"with {_TREES} select shard_id, place8 // 256 as twig, string_agg(lpad(lower(hex(b)), 2, '0'), '' order by place8) as bits from byte group by all having max(b) > 0")
def active_bits(spark: SparkSession, d: str) -> DataFrame:
    _, active = _log_and_active(spark, d)
    return M.active_bits(active).select("shard_id", "twig", hx("bits").alias("bits"))


@query(f"with {_TREES} select shard_id, nth as twig, h as twig_root from twig")
def twig_roots(spark: SparkSession, d: str) -> DataFrame:
    log, active = _log_and_active(spark, d)
    return M.twig_trees(M.leaf_hashes(log), active).select("shard_id", "twig", hx("twig_root").alias("twig_root"))


def _upper_sql(levels: int) -> str:
    """CTEs ``u12 .. u<12 + levels>`` of the upper tree, with null twigs in place of missing ones."""
    out, below = ["u12 as (select shard_id, nth, h from twig)"], "u12"
    for r in range(levels):
        name, child = f"u{13 + r}", 12 + r
        null = null_upper(child).hex()
        pair = f"coalesce(max(case when nth % 2 = 0 then h end), '{null}') || coalesce(max(case when nth % 2 = 1 then h end), '{null}')"
        out.append(f"{name} as (select shard_id, nth // 2 as nth, sha256(unhex('{child:02x}' || {pair})) as h from {below} group by all)")
        below = name
    return ",\n".join(out)


#: Levels above the twigs that the SQL spells out: 64 twigs a shard.
_UPPER = 6
_ROOTS = f"""{_TREES},
{_upper_sql(_UPPER)},
top as (select shard_id, case when youngest = 0 then 12 else 12 + length(ltrim(bin(youngest::bigint), '0')) end as top from span),
root as ({" union all ".join(f"select shard_id, {12 + r} as level, h from u{12 + r} where nth = 0" for r in range(_UPPER + 1))})"""


@query(f"with {_ROOTS} select root.shard_id, level::integer as level, h as root_hash from root join top on top.shard_id = root.shard_id and top.top = root.level")
def shard_roots(spark: SparkSession, d: str) -> DataFrame:
    log, active = _log_and_active(spark, d)
    roots = M.shard_roots(cut(M.twig_trees(M.leaf_hashes(log), active)))
    return roots.select("shard_id", F.col("level").cast("int").alias("level"), hx("root_hash").alias("root_hash"))


def tree_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Log, live entries, twigs and upper nodes."""
    log, active = _log_and_active(spark, d)
    return log, active, *M.tree(log, active)


def nodes_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    log, active, twigs, upper = tree_of(spark, d)
    return log, active, M.nodes_of_tree(twigs, upper)


@query("select 0::integer as shard_id, 0::integer as level, 0::bigint as nth where false")
def tree_inconsistencies(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that don't fit their children: none."""
    return M.inconsistent(nodes_of(spark, d)[2]).select("shard_id", F.col("level").cast("int").alias("level"), "nth")
