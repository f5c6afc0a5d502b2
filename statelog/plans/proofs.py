"""Queries of proofs and witnesses, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelog.config import SENTRIES
from statelog.functions.hashing import null_bits, null_left, null_upper
from statelog.operators import log as L
from statelog.operators import merkle as M
from statelog.operators import proof as P
from statelog.plans.sqltext import le8
from statelog.plans.store import _ROOTS, _UPPER, classes_of, hx, nodes_of, tree_of
from statelog.runtime import cut

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All entries that operations appended, with nodes and roots."""
    log, _, nodes = nodes_of(spark, d)
    return log.where(F.col("sn") >= SENTRIES).select("shard_id", "sn"), nodes, cut(M.roots_of(nodes))


def _paths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Proofs of all entries that operations appended, with roots."""
    log, _, twigs, upper = tree_of(spark, d)
    roots = cut(M.roots_of(upper))
    return P.proof_paths(log.where(F.col("sn") >= SENTRIES).select("shard_id", "sn"), twigs, upper, roots), roots


def _node_sql() -> str:
    """All nodes: ``node(shard_id, level, nth, h)``; left halves of twigs, bits halves, upper nodes."""
    parts = [f"select shard_id, {lv} as level, (nth // {2048 >> lv}) * {4096 >> lv} + nth % {2048 >> lv} as nth, h from l{lv}" for lv in range(11)]
    parts.append("select shard_id, 11, nth * 2, h from l11")
    for lv, name in ((8, "b8"), (9, "c1"), (10, "c2")):
        n = 1 << (11 - lv)
        parts.append(f"select shard_id, {lv}, (nth // {n}) * {2 * n} + {n} + nth % {n}, h from {name}")
    parts.append("select shard_id, 11, nth * 2 + 1, h from c3")
    parts += [f"select shard_id, {12 + r}, nth, h from u{12 + r}" for r in range(_UPPER + 1)]
    return f"{_ROOTS},\nnode as ({' union all '.join(parts)})"


def _null_case(level: str, nth: str) -> str:
    out = [f"when {level} >= 12 and {level} = {lv} then '{null_upper(lv).hex()}'" for lv in range(12, 12 + _UPPER + 1)]
    out += [f"when {level} = {lv} and {nth} % {4096 >> lv} >= {2048 >> lv} then '{null_bits(lv).hex()}'" for lv in range(8, 12)]
    out += [f"when {level} = {lv} then '{null_left(lv).hex()}'" for lv in range(12)]
    return "case " + " ".join(out) + " end"


_ASK = f"ask as (select w.shard_id, w.sn, (w.sn // 2048) * 4096 + w.sn % 2048 as leaf, (w.sn // 2048) * 16 + 8 + w.sn % 2048 // 256 as page, top.top from whole w join top using (shard_id) where w.sn >= {SENTRIES})"

_PROOF = f"""with {_node_sql()},
{_ASK},
path as (
  select shard_id, sn, 'left' as part, lv as level, (leaf >> lv)::bigint as nth from ask, range(0, 11) t(lv)
  union all select shard_id, sn, 'right', lv, (page >> (lv - 8))::bigint from ask, range(8, 11) t(lv)
  union all select shard_id, sn, 'upper', lv, (case when lv = 11 then (sn // 2048) * 2 else (sn // 2048) >> greatest(lv - 12, 0) end)::bigint from ask, range(11, 12 + {_UPPER}) t(lv) where lv < top)"""


@query(f"""{_PROOF}
select p.shard_id, p.sn, p.part, p.level::integer as level, p.nth, coalesce(a.h, {_null_case("p.level", "p.nth")}) as self_hash, coalesce(b.h, {_null_case("p.level", "xor(p.nth, 1)")}) as peer_hash, p.nth % 2 = 1 as peer_at_left
from path p left join node a on a.shard_id = p.shard_id and a.level = p.level and a.nth = p.nth left join node b on b.shard_id = p.shard_id and b.level = p.level and b.nth = xor(p.nth, 1)""")
def proof_rows(spark: SparkSession, d: str) -> DataFrame:
    p = P.proof_rows(_paths(spark, d)[0])
    return p.select("shard_id", "sn", "part", F.col("level").cast("int").alias("level"), "nth", hx("self_hash").alias("self_hash"), hx("peer_hash").alias("peer_hash"), "peer_at_left")


@query(f"with {_ROOTS}, {_ASK} select shard_id, sn, true as valid from ask")
def proof_check(spark: SparkSession, d: str) -> DataFrame:
    return P.check_proofs(*_paths(spark, d))


def _forged(step: F.Column) -> F.Column:
    """A step with its sibling's hash turned round if it is the one at level 9 of the left part."""
    bad = (step["part"] == "left") & (step["level"] == 9)
    return F.struct(*[step[c].alias(c) for c in ("part", "level", "nth", "self_hash")], F.when(bad, F.unhex(F.reverse(F.hex(step["peer_hash"])))).otherwise(step["peer_hash"]).alias("peer_hash"), step["peer_at_left"].alias("peer_at_left"))


@query(f"with {_ROOTS}, {_ASK} select shard_id, sn, sn % 3 <> 0 as valid from ask")
def proof_check_forged(spark: SparkSession, d: str) -> DataFrame:
    """As :func:`proof_check` after a hash in every third entry's proof was altered: those are refused, the others stand."""
    paths, roots = _paths(spark, d)
    altered = paths.withColumn("steps", F.when(F.col("sn") % 3 == 0, F.transform("steps", _forged)).otherwise(F.col("steps")))
    return P.check_proofs(altered, roots)


@query(f"with {_ROOTS}, {_ASK} select shard_id, sn, true as valid from ask")
def proof_codec(spark: SparkSession, d: str) -> DataFrame:
    """Proofs written as bytes and checked from those bytes."""
    return P.decode_proofs(P.encode_proofs(*_paths(spark, d)))


@query(f"""{_PROOF},
full_path as (
  select p.shard_id, p.sn, p.part, p.level, coalesce(a.h, {_null_case("p.level", "p.nth")}) as self_hash, coalesce(b.h, {_null_case("p.level", "xor(p.nth, 1)")}) as peer_hash
  from path p left join node a on a.shard_id = p.shard_id and a.level = p.level and a.nth = p.nth left join node b on b.shard_id = p.shard_id and b.level = p.level and b.nth = xor(p.nth, 1)),
body as (
  select shard_id, sn, max(case when part = 'left' and level = 0 then self_hash end) || string_agg(peer_hash, '' order by level) filter (where part = 'left')
    || max(case when part = 'right' and level = 8 then self_hash end) || string_agg(peer_hash, '' order by level) filter (where part = 'right')
    || coalesce(string_agg(peer_hash, '' order by level) filter (where part = 'upper' and level > 11), '') as hashes from full_path group by shard_id, sn)
select body.shard_id, {le8("sn")} || hashes || root.h as proof from body join top on top.shard_id = body.shard_id join root on root.shard_id = top.shard_id and root.level = top.top""")
def proof_bytes(spark: SparkSession, d: str) -> DataFrame:
    return P.encode_proofs(*_paths(spark, d)).select("shard_id", hx("proof").alias("proof"))


_WITNESS = f"""{_PROOF.replace("path as (", "unused as (")},
own0 as (
  select shard_id, lv as level, (leaf >> lv)::bigint as nth, lv = 0 as given from ask, range(0, 12 + {_UPPER}) t(lv) where lv < top
  union all select shard_id, lv, (page >> (lv - 8))::bigint, lv = 8 from ask, range(8, 12 + {_UPPER}) t(lv) where lv < top),
own as (select shard_id, level, nth, max(given) as given from own0 group by all),
peer as (select distinct shard_id, level, xor(nth, 1) as nth from own),
wit as (select shard_id, level, nth, true as given from own where given union all select shard_id, level, nth, false from peer anti join own using (shard_id, level, nth))"""


@query(f"""{_WITNESS}
select w.shard_id, w.level::integer as level, w.nth, w.given, coalesce(n.h, {_null_case("w.level", "w.nth")}) as hash, (w.nth << w.level)::bigint as place
from wit w left join node n on n.shard_id = w.shard_id and n.level = w.level and n.nth = w.nth""")
def witness_rows(spark: SparkSession, d: str) -> DataFrame:
    w = P.witness(*_asked(spark, d))
    return w.select("shard_id", F.col("level").cast("int").alias("level"), "nth", "given", hx("hash").alias("hash"), "place")


@query(f"with {_ROOTS} select distinct shard_id, true as valid from span")
def witness_check(spark: SparkSession, d: str) -> DataFrame:
    asked, nodes, roots = _asked(spark, d)
    return P.verify_witness(P.witness(asked, nodes, roots), roots)


@query(f"with {_ROOTS} select distinct shard_id, shard_id % 2 = 1 as valid from span")
def witness_check_forged(spark: SparkSession, d: str) -> DataFrame:
    """As :func:`witness_check` after the hash of one node of each even shard's witness was altered: those are refused."""
    asked, nodes, roots = _asked(spark, d)
    w = cut(P.witness(asked, nodes, roots))
    one = w.groupBy("shard_id").agg(F.max("place").alias("last"))
    bad = (F.col("place") == F.col("last")) & (F.col("shard_id") % 2 == 0)
    altered = w.join(F.broadcast(one), "shard_id").withColumn("hash", F.when(bad, F.unhex(F.reverse(F.hex("hash")))).otherwise(F.col("hash")))  # a row a shard
    return P.verify_witness(altered, roots)


_KIND = f"case when coalesce(n.h, {_null_case('w.level', 'w.nth')}) = {_null_case('w.level', 'w.nth')} then '00' when e.i is not null then '02' || lpad(lower(hex(e.i)), 16, '0') else '01' || n.h end"


@query(f"""{_WITNESS},
listed as (select shard_id, leaf, row_number() over (partition by shard_id order by sn) - 1 as i from ask)
select w.shard_id, (w.nth << w.level)::bigint as place, lpad(lower(hex(w.level::bigint)), 2, '0') || lpad(lower(hex(w.nth)), 16, '0') || {_KIND} as bytes
from wit w left join node n on n.shard_id = w.shard_id and n.level = w.level and n.nth = w.nth left join listed e on w.level = 0 and e.shard_id = w.shard_id and e.leaf = w.nth""")
def witness_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Witnesses as bytes, a row a node."""
    asked, nodes, roots = _asked(spark, d)
    return P.witness_bytes(P.witness(asked, nodes, roots), asked).select("shard_id", "place", hx("bytes").alias("bytes"))


@query(f"""{_WITNESS}
select w.shard_id, w.level::integer as level, w.nth, coalesce(n.h, {_null_case("w.level", "w.nth")}) as hash
from wit w left join node n on n.shard_id = w.shard_id and n.level = w.level and n.nth = w.nth""")
def witness_decode(spark: SparkSession, d: str) -> DataFrame:
    """Witnesses read back from their bytes, hashes of listed entries computed from the log."""
    log, _, twigs, upper = tree_of(spark, d)
    asked, roots = log.where(F.col("sn") >= SENTRIES).select("shard_id", "sn"), cut(M.roots_of(upper))
    encoded = P.witness_bytes(P.witness(asked, M.nodes_of_tree(twigs, upper), roots), asked)
    w = P.read_witness(encoded, M.leaf_hashes(log).where(F.col("sn") >= SENTRIES))
    return w.select("shard_id", "level", "nth", hx("hash").alias("hash"))


@query(f"""with {_ROOTS}, now as (select shard_id, sn from active), was as (select (n // 4096)::integer as shard_id, (n % 4096)::bigint as sn from range(65536) t(n))
select shard_id, sn, true as active from now anti join was using (shard_id, sn) union all select shard_id, sn, false from was anti join now using (shard_id, sn)""")
def changed_sns(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose liveness differs between the empty store and the present."""
    log = cut(L.whole_log(classes_of(spark, d)))
    old = M.active_bits(L.sentry_log(spark))
    return P.changed_sns(old, M.active_bits(L.active_entries(log)))


def _claims(log: DataFrame, active: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(shard_id, sn, leaf, live)`` of the appended entries as the tree has them: its leaves and its pages of bits."""
    asked = log.where(F.col("sn") >= SENTRIES).select("shard_id", "sn")
    leaf = P._with_hash(asked.withColumn("level", F.lit(0)).withColumn("nth", P.sn_to_leaf(F.col("sn"))), nodes, "nth", "leaf")
    j = leaf.withColumn("twig", F.shiftright("sn", 11)).join(M.active_bits(active), ["shard_id", "twig"], "left")
    at = F.conv(F.hex(F.substring(F.col("bits"), (F.shiftright(F.col("sn"), 3).bitwiseAND(255) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    live = F.coalesce(F.call_function("shiftright", at, F.col("sn").bitwiseAND(7).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    return j.select("shard_id", "sn", "leaf", live.alias("live"))


@query(f"with {_ROOTS}, {_ASK} select shard_id, sn, true as valid from ask")
def entry_check(spark: SparkSession, d: str) -> DataFrame:
    """Leaf hash and liveness of asked entries against the log."""
    log, active, nodes = nodes_of(spark, d)
    return P.verify_entries(_claims(log, active, nodes), log, active)


@query(f"with {_ROOTS}, {_ASK} select shard_id, sn, sn % 3 <> 0 and sn % 5 <> 0 as valid from ask")
def entry_check_forged(spark: SparkSession, d: str) -> DataFrame:
    """As :func:`entry_check` with a wrong leaf for every third and a wrong liveness for every fifth entry."""
    log, active, nodes = nodes_of(spark, d)
    c = _claims(log, active, nodes)
    leaf = F.when(F.col("sn") % 3 == 0, F.unhex(F.reverse(F.hex("leaf")))).otherwise(F.col("leaf"))
    return P.verify_entries(c.withColumn("leaf", leaf).withColumn("live", (F.col("sn") % 5 == 0) != F.col("live")), log, active)
