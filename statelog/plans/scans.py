"""Queries of scans, decoding and block proofs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statelog.functions import u256
from statelog.functions.codec import account_fields, bloom_slots, max_level, node_pos, pos_level, pos_nth, sn_to_leaf
from statelog.operators import log as L
from statelog.operators import merkle as M
from statelog.operators import proof as P
from statelog.plans.pipeline import _ACCOUNTS, accounts_of
from statelog.plans.proofs import _ROOTS, _UPPER
from statelog.plans.sqltext import LOG, OPS, WHOLE
from statelog.plans.store import classes_of, hx
from statelog.runtime import cut, table

QUERIES, SQL = {}, {}

#: Live entries a shard that compaction would look at next.
OLDEST = 8


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_PLACED = f"""{LOG}, n as (select *, (((61 + length(key) // 2 + length(value) // 2) + 7) // 8 * 8 + 8 * len(dsn))::bigint as length from log),
placed as (select *, (393216 + coalesce(sum(length) over (partition by shard_id order by sn rows between unbounded preceding and 1 preceding), 0))::bigint as file_pos from n)"""


@query(f"with {_PLACED} select shard_id, left(entity, 16) as k64, next_kh as next_key_hash, file_pos, sn from placed where file_pos >= 400000")
def entry_scan(spark: SparkSession, d: str) -> DataFrame:
    """Scan of four fields from a file position on."""
    log = L.entry_log(classes_of(spark, d)).where("file_pos >= 400000")
    return log.select("shard_id", F.lower(F.hex(F.substring("entity", 1, 8))).alias("k64"), hx("next_key_hash").alias("next_key_hash"), "file_pos", "sn")


@query(f"with {_PLACED}, dead as (select distinct shard_id, unnest(dsn) as sn from placed) select shard_id, file_pos, sn, key, value from placed anti join dead using (shard_id, sn)")
def entry_by_position(spark: SparkSession, d: str) -> DataFrame:
    """Entries read back by the file positions of those that are live."""
    log = cut(L.entry_log(classes_of(spark, d)))
    wanted = L.active_entries(log).select("shard_id", "file_pos")
    return log.join(wanted, ["shard_id", "file_pos"], "left_semi").select("shard_id", "file_pos", "sn", hx("key").alias("key"), hx("value").alias("value"))


@query(f"with {_PLACED} select shard_id, sn // 2048 as twig, min(file_pos) as first_pos from placed group by all")
def twig_first_pos(spark: SparkSession, d: str) -> DataFrame:
    return L.entry_log(classes_of(spark, d)).groupBy("shard_id", F.shiftright("sn", 11).alias("twig")).agg(F.min("file_pos").alias("first_pos"))


@query(f"with {WHOLE}, r as (select shard_id, sn, row_number() over (partition by shard_id order by sn) as place from active) select shard_id, sn, place::integer as place from r where place <= {OLDEST}")
def oldest_active(spark: SparkSession, d: str) -> DataFrame:
    """The oldest live entries of each shard, which compaction moves next; limited before the shuffle."""
    live = L.active_entries(cut(L.whole_log(classes_of(spark, d)))).select("shard_id", "sn")
    return live.withColumn("place", F.row_number().over(Window.partitionBy("shard_id").orderBy("sn"))).where(F.col("place") <= OLDEST)


@query(f"with {_ACCOUNTS} select address, balance::varchar as balance, lower(substr(v, 65, 16)) as nonce, right(v, 64) as code_hash from acct")
def account_decode(spark: SparkSession, d: str) -> DataFrame:
    f = account_fields(F.col("value"))
    return accounts_of(spark, d).select(hx("address").alias("address"), u256.to_decimal(f["balance"]).cast("string").alias("balance"), F.lower(F.lpad(F.hex(f["nonce"]), 16, "0")).alias("nonce"), F.lower(F.hex(f["code_hash"])).alias("code_hash"))


def _bits_sql(j: int) -> str:
    """Bits 11 j .. 11 j + 10 of the number that 16 hex digits spell, least significant first, as text of a sum."""
    terms = []
    for bit in range(11):
        at = 11 * j + bit
        digit = f"(strpos('0123456789abcdef', substr(k64, {16 - at // 4}, 1)) - 1)"
        terms.append(f"(({digit} // {1 << (at % 4)}) % 2) * {1 << bit}")
    return "(" + " + ".join(terms) + ")"


@query(f"with {OPS}, k as (select distinct left(kh, 16) as k64 from ops) select k64, {' || chr(44) || '.join(f'{_bits_sql(j)}::varchar' for j in range(5))} as slots from k")
def bloom_positions(spark: SparkSession, d: str) -> DataFrame:
    """Five Bloom filter positions of each key."""
    k = table(spark, d, "changes").where("key is not null and op_seq is not null and op_type is not null").select(F.substring(F.sha2("key", 256), 1, 16).alias("k64")).distinct()
    return k.select("k64", F.concat_ws(",", bloom_slots(F.col("k64")).cast("array<string>")).alias("slots"))


@query(f"with {LOG} select shard_id, sn, (sn // 2048) * 4096 + sn % 2048 as leaf, 12 as level, sn // 2048 as nth, case when sn // 2048 = 0 then 12 else 12 + length(ltrim(bin((sn // 2048)::bigint), '0')) end::integer as top from log")
def node_positions(spark: SparkSession, d: str) -> DataFrame:
    """Leaf places, twig nodes packed and unpacked, and the root's level when an entry's twig is the youngest."""
    log = L.entry_log(classes_of(spark, d), positions=False).select("shard_id", "sn").withColumn("twig", F.shiftright("sn", 11))
    pos = node_pos(F.lit(12), F.col("twig"))
    return log.select("shard_id", "sn", sn_to_leaf(F.col("sn")).alias("leaf"), pos_level(pos).alias("level"), pos_nth(pos).alias("nth"), max_level(F.col("twig")).alias("top"))


@query(f"with {_ROOTS}, u as ({' union all '.join(f'select shard_id, {12 + r} as level, nth, h from u{12 + r}' for r in range(_UPPER + 1))}) select shard_id, level::integer as level, nth, h as hash from u join top using (shard_id) where level <= top and nth < (1 << (top - level))")
def upper_tree(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of each shard from the twig roots up to its root."""
    log = cut(L.whole_log(classes_of(spark, d)))
    twigs = cut(M.twig_trees(M.leaf_hashes(log), L.active_entries(log).select("shard_id", "sn")).select("shard_id", F.col("twig").alias("nth"), F.col("twig_root").alias("hash")))
    nodes = twigs.select("shard_id", F.lit(12).alias("level"), "nth", "hash").unionByName(M.upper_nodes(twigs))
    return nodes.select("shard_id", F.col("level").cast("int").alias("level"), "nth", hx("hash").alias("hash"))


def _last_block(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The log before its last block, the entries that block replaced and those it appended."""
    top = log.agg(F.max(F.shiftright("version", 24))).first()[0]
    new = log.where(F.shiftright("version", 24) == top)
    old = log.where(F.shiftright("version", 24) < top)
    return old, new.select("shard_id", F.explode("dsn").alias("sn")).distinct(), new.select("shard_id", "sn")


_BLOCK = f"{WHOLE}, lastb as (select max(version >> 24) as h from whole), fresh as (select * from whole, lastb where version >> 24 = h), gone0 as (select distinct shard_id, unnest(dsn) as sn from fresh)"


@query(f"with {_BLOCK} select shard_id, sn, 'touched' as part from gone0 union all select shard_id, sn, 'appended' from fresh")
def block_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries that a proof of the last block covers."""
    _, touched, appended = _last_block(L.whole_log(classes_of(spark, d)))
    return touched.withColumn("part", F.lit("touched")).unionByName(appended.withColumn("part", F.lit("appended")))


@query(f"with {_BLOCK} select distinct shard_id, true as old_valid, true as new_valid from gone0")
def block_validation(spark: SparkSession, d: str) -> DataFrame:
    """The last block checked without the store: what it replaced against the roots before it, all it touched against the roots after it."""
    log = cut(L.whole_log(classes_of(spark, d)))
    old, touched, appended = _last_block(log)
    checks = []
    for name, part, asked in (("old_valid", old, touched), ("new_valid", log, touched.unionByName(appended).distinct())):
        nodes = cut(M.all_nodes(part, L.active_entries(part)))
        roots = cut(M.roots_of(nodes))
        checks.append(P.verify_witness(P.witness(asked, nodes, roots), roots).withColumnRenamed("valid", name))
    return checks[0].join(checks[1], "shard_id")


@query(f"with {_ROOTS}, u as ({' union all '.join(f'select shard_id, {12 + r} as level, nth, h from u{12 + r}' for r in range(_UPPER + 1))}) select shard_id, level::integer as level, nth, h as hash from u join top using (shard_id) where level <= top and nth < (1 << (top - level))")
def upper_tree_updated(spark: SparkSession, d: str) -> DataFrame:
    """The upper tree after the last block, from the one before it and the twigs that the block changed."""
    log = cut(L.whole_log(classes_of(spark, d)))
    old, touched, appended = _last_block(log)
    before = M.tree(old, L.active_entries(old))[1]
    dirty = touched.unionByName(appended).select("shard_id", F.shiftright("sn", 11).alias("twig")).distinct()
    of = lambda df: df.withColumn("twig", F.shiftright("sn", 11)).join(dirty, ["shard_id", "twig"], "left_semi").drop("twig")
    twigs = M.twig_trees(M.leaf_hashes(of(log)), of(L.active_entries(log).select("shard_id", "sn")))
    new = cut(twigs.select("shard_id", F.col("twig").alias("nth"), F.col("twig_root").alias("hash")))
    return M.updated_upper(before, new).select("shard_id", F.col("level").cast("int").alias("level"), "nth", hx("hash").alias("hash"))


@query(f"""with {_ROOTS}, e as (select shard_id, max(sn) + 1 as next_sn from whole group by shard_id), a as (select shard_id, min(sn) as oldest_active_sn from active group by shard_id),
sized as (select *, ((61 + length(key) // 2 + length(value) // 2 + 7) // 8 * 8 + 8 * len(dsn))::bigint as length from log), f as (select shard_id, sum(length)::bigint as n from sized group by shard_id)
select e.shard_id, next_sn, oldest_active_sn, 393216 + coalesce(f.n, 0) as file_size, (next_sn - 1) // 2048 as youngest_twig, root.level::integer as root_level, root.h as root_hash
from e join a using (shard_id) left join f using (shard_id) join top using (shard_id) join root on root.shard_id = top.shard_id and root.level = top.top""")
def shard_meta(spark: SparkSession, d: str) -> DataFrame:
    """What a commit records of each shard: next and oldest live serial number, size of the entry file, youngest twig and root."""
    log = cut(L.whole_log(classes_of(spark, d)))
    roots = M.roots_of(M.tree(log, L.active_entries(log))[1])
    size = log.groupBy("shard_id").agg(F.sum("length").cast("long").alias("file_size"))
    j = L.active_stats(log).join(size, "shard_id").join(roots, "shard_id")
    return j.select("shard_id", "next_sn", "oldest_active_sn", "file_size", F.shiftright(F.col("next_sn") - 1, 11).alias("youngest_twig"), F.col("level").cast("int").alias("root_level"), hx("root_hash").alias("root_hash"))


@query(f"with {WHOLE}, o as (select shard_id, min(sn) // 2048 * 2048 as start from active where sn >= 4096 group by shard_id) select w.shard_id, w.sn, entity, a.sn is not null as live from whole w join o on o.shard_id = w.shard_id and w.sn >= o.start left join (select shard_id, sn from active) a on a.shard_id = w.shard_id and a.sn = w.sn")
def recovery_scan(spark: SparkSession, d: str) -> DataFrame:
    """Entries that a restart reads again: from the twig of the oldest live entry on, sentries aside, with their liveness."""
    log = cut(L.whole_log(classes_of(spark, d)))
    live = cut(L.active_entries(log).select("shard_id", "sn", F.lit(True).alias("live")))
    start = live.where("sn >= 4096").groupBy("shard_id").agg(F.min("sn").alias("oldest")).select("shard_id", (F.shiftright("oldest", 11) * 2048).alias("start"))
    read = log.join(F.broadcast(start), "shard_id").where("sn >= start").select("shard_id", "sn", "entity")  # a row a shard
    return read.join(live, ["shard_id", "sn"], "left").select("shard_id", "sn", hx("entity").alias("entity"), F.coalesce("live", F.lit(False)).alias("live"))


@query(f"""with {_BLOCK}, n as (select shard_id, sum(case effect when 'create' then 1 when 'write' then 1 else 1 end) as n_change, sum(case effect when 'create' then 2 when 'write' then 1 else 0 end) as n_compact from cls, lastb where effect <> 'noop' and version >> 24 = h group by shard_id),
old as (select w.* from whole w, lastb where version >> 24 < h),
ends as (select shard_id, max(sn) + 1 as sn_end from old group by shard_id),
olddead as (select distinct shard_id, unnest(dsn) as sn from old),
oldlive as (select shard_id, sn, row_number() over (partition by shard_id order by sn) as place from old anti join olddead using (shard_id, sn)),
moved as (select l.shard_id, l.sn from oldlive l join n on n.shard_id = l.shard_id and l.place <= n.n_compact),
span as (select shard_id, min(sn) as a, max(sn) as b from moved group by shard_id)
select shard_id, sn, 'touched' as part from gone0
union all select shard_id, unnest(range(sn_end, sn_end + n_change + n_compact)), 'appended' from n join ends using (shard_id)
union all select shard_id, sn, 'compacted' from moved
union all select shard_id, unnest(range(a, b)), 'bits' from span""".replace("sn_end + n_change + n_compact", "(sn_end + n_change + n_compact)::bigint"))
def block_proof_entries(spark: SparkSession, d: str) -> DataFrame:
    """All that a proof of the last block covers: entries it replaced, numbers it and its compaction may append, entries that compaction would
    move next, and, for their liveness alone, the entries between those."""
    classes = cut(classes_of(spark, d))
    log = cut(L.whole_log(classes))
    old, touched, _ = _last_block(log)
    top = log.agg(F.max(F.shiftright("version", 24))).first()[0]
    effects = classes.where((F.shiftright("version", 24) == top) & (F.col("effect") != "noop"))
    parts = P.block_entries(old, L.active_entries(old), effects)
    return touched.withColumn("part", F.lit("touched")).unionByName(parts)
