"""SQL fragments that several DuckDB queries share."""

from __future__ import annotations


def hex_id(e: str) -> str:
    """Canonical spelling of an identifier with 0x in front; null for blank text."""
    return f"'0x' || nullif(regexp_replace(lower(trim({e}, e' \\t\\n\\r\\f\\v')), '^0x', ''), '')"


def le8(e: str) -> str:
    h = f"lpad(lower(hex(({e})::bigint)), 16, '0')"
    return "(" + " || ".join(f"substr({h}, {i}, 2)" for i in range(15, 0, -2)) + ")"


def nibble(e: str) -> str:
    """Value of a hex digit."""
    return f"(strpos('0123456789abcdef', {e}) - 1)"


def hex16(e: str) -> str:
    """Value of four hex digits."""
    return "(" + " + ".join(f"{16 ** (3 - i)} * {nibble(f'substr({e}, {i + 1}, 1)')}" for i in range(4)) + ")"


#: Operations of the change feed in order; hashes as lower-case hex text.
OPS = f"""
ops as (
  select key, version, op_seq, op_type, value, height, task_idx, cset_idx, sha256(key) as kh, {nibble("left(sha256(key), 1)")}::integer as shard_id
  from (
    select key, version, op_seq, max(op_type) as op_type, max(value) as value, max(height) as height, max(task_idx) as task_idx, max(cset_idx) as cset_idx
    from (select * replace (coalesce(version, (height::bigint << 24) + task_idx) as version) from changes) group by key, version, op_seq))"""

CLASSES = f"""{OPS},
acts as (select *, op_type <> 4 as sets, coalesce(lag(op_type <> 4) over (partition by kh order by version, op_seq), false) as live from ops where op_type in (2, 3, 4)),
cls as (
  select *, case when sets then case when live then 'write' else 'create' end else case when live then 'delete' else 'noop' end end as effect from acts)"""

LATEST = f"""{OPS},
lst as (select * from (select *, row_number() over (partition by kh order by version desc, op_seq desc) as r from ops where op_type in (2, 3, 4)) where r = 1),
state as (select shard_id, kh, key, value, version, op_seq from lst where op_type <> 4)"""

_ZEROS = "repeat('0', 60)"
_NEXT_SENTRY = f"case when left(kh, 4) = 'ffff' then repeat('f', 64) else lpad(lower(hex({hex16('left(kh, 4)')}::bigint + 1)), 4, '0') || {_ZEROS} end"

SENTRIES = f"""
sentry as (
  select (n // 4096)::integer as shard_id, (n % 4096)::bigint as sn, lpad(lower(hex(n)), 4, '0') || {_ZEROS} as kh,
    case when n = 65535 then repeat('f', 64) else lpad(lower(hex(n + 1)), 4, '0') || {_ZEROS} end as next_kh
  from range(65536) t(n))"""

#: Log rows (``log``): entity and next_kh as hex text, value null for sentries' empty one.
LOG = f"""{CLASSES},
eff as (select *, row_number() over (order by version, op_seq) as rn, left(kh, 4) as k16 from cls where effect <> 'noop'),
iv as (select k16, kh, rn as c, d from (select *, lead(rn) over (partition by kh order by rn) as d from eff where effect <> 'write') where effect = 'create'),
near as (
  select a.rn, coalesce(max(case when i.kh < a.kh then i.kh end), any_value(a.k16) || {_ZEROS}) as prev, min(case when i.kh > a.kh then i.kh end) as nxt
  from eff a left join iv i on i.k16 = a.k16 and i.c < a.rn and (i.d is null or i.d > a.rn) and i.kh <> a.kh group by a.rn),
e2 as (select eff.*, near.prev, coalesce(near.nxt, {_NEXT_SENTRY}) as nxt from eff join near using (rn)),
touch as (
  select shard_id, kh as entity, rn, version, op_seq, 0 as sub, 'new' as kind, key, coalesce(value, ''::blob) as value, nxt as next_kh from e2 where effect = 'create'
  union all select shard_id, prev, rn, version, op_seq, 1, 'prev', null, null, kh from e2 where effect = 'create'
  union all select shard_id, kh, rn, version, op_seq, 0, 'write', key, coalesce(value, ''::blob), nxt from e2 where effect = 'write'
  union all select shard_id, kh, rn, version, op_seq, 0, 'gone', null, null, null from e2 where effect = 'delete'
  union all select shard_id, prev, rn, version, op_seq, 1, 'prev', null, null, nxt from e2 where effect = 'delete'),
t2 as (
  select *, sum(case when kind = 'gone' then 0 else 1 end) over (partition by shard_id order by rn, sub) + 4095 as sn,
    last_value(key ignore nulls) over (partition by entity order by rn, sub) as k, last_value(value ignore nulls) over (partition by entity order by rn, sub) as v from touch),
t3 as (
  select *, coalesce(lag(sn) over w, {hex16("left(entity, 4)")} % 4096) as old_sn, coalesce(lag(version) over w, 0) as old_version
  from t2 window w as (partition by entity order by rn, sub)),
gone as (select rn, old_sn as gone_sn from t3 where kind = 'gone'),
log as (
  select shard_id, sn::bigint as sn, entity, lower(hex(coalesce(k, unhex(entity)))) as key, lower(hex(coalesce(v, ''::blob))) as value, next_kh, version,
    (case when kind = 'new' then -1 else old_version end)::bigint as last_version, kind, op_seq, sub, rn,
    (case when kind = 'new' then [] when gone_sn is not null then [gone_sn, old_sn] else [old_sn] end)::bigint[] as dsn
  from t3 left join gone using (rn) where kind <> 'gone')"""

#: Log rows with the sentries' first entries (``whole``).
WHOLE = f"""{LOG},{SENTRIES},
whole as (
  select shard_id, sn, entity, key, value, next_kh, version, last_version, dsn from log
  union all select shard_id, sn, kh, kh, '', next_kh, 0, -1, [] from sentry),
dead as (select distinct shard_id, unnest(dsn) as sn from whole),
active as (select * from whole anti join dead using (shard_id, sn))"""


def entry_hex(prefix: str = "") -> str:
    """Serialised entry as hex text, of columns key, value, next_kh, version, last_version, sn, dsn."""
    k, v = "(length(key) // 2)", "(length(value) // 2)"
    vlen = f"lpad(lower(hex(({v})::bigint)), 6, '0')"
    flipped = f"substr({vlen}, 5, 2) || substr({vlen}, 3, 2) || substr({vlen}, 1, 2)"
    pad = f"repeat('00', ((8 - (5 + {k} + {v}) % 8) % 8)::bigint)"
    dsn = f"case len(dsn) when 0 then '' when 1 then {le8('dsn[1]')} else {le8('dsn[1]')} || {le8('dsn[2]')} end"
    return f"lpad(lower(hex(({k})::bigint)), 2, '0') || {flipped} || lpad(lower(hex(len(dsn)::bigint)), 2, '0') || key || value || {pad} || next_kh || {le8('version')} || {le8('last_version')} || {le8('sn')} || {dsn}"


def hash_rounds(source: str, first: str, child_level: int, rounds: int, keys: str, nth: str = "nth") -> str:
    """CTEs ``<first>1 .. <first><rounds>`` that hash pairs of ``source(keys, nth, h)`` level by level."""
    out, below = [], source
    for r in range(rounds):
        name = f"{first}{r + 1}"
        pair = f"max(case when {nth} % 2 = 0 then h end) || max(case when {nth} % 2 = 1 then h end)"
        out.append(f"{name} as (select {keys}, {nth} // 2 as {nth}, sha256(unhex('{child_level + r:02x}' || {pair})) as h from {below} group by {keys}, {nth} // 2)")
        below = name
    return ",\n".join(out)


def trees(null_leaf_hex: str) -> str:
    """CTEs of the twigs' trees over ``whole``: ``l0 .. l11``, pages ``b8 .. b11`` and ``twig`` (level 12)."""
    return f"""{WHOLE},
span as (select shard_id, max(sn) // 2048 as youngest from whole group by shard_id),
place as (select shard_id, unnest(range((youngest + 1) * 2048)) as sn from span),
l0 as (
  select shard_id, sn as nth, coalesce(sha256(unhex({entry_hex()})), '{null_leaf_hex}') as h
  from place p left join whole w using (shard_id, sn)),
{hash_rounds("l0", "l", 0, 11, "shard_id")},
byte as (
  select p.shard_id, p.sn // 8 as place8, sum(case when a.sn is null then 0 else 1 << (p.sn % 8)::integer end)::bigint as b
  from place p left join active a on a.shard_id = p.shard_id and a.sn = p.sn group by all),
b8 as (select shard_id, place8 // 32 as nth, string_agg(lpad(lower(hex(b)), 2, '0'), '' order by place8) as h from byte group by all),
{hash_rounds("b8", "c", 8, 3, "shard_id")},
twig as (select l.shard_id, l.nth, sha256(unhex('0b' || l.h || c.h)) as h from l11 l join c3 c using (shard_id, nth))"""
