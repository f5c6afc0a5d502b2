"""State, log, trees, proofs, compaction and recovery against a plain Python model of the store."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from statelog.functions.hashing import null_bits, null_left, null_upper
from statelog.operators import changes as C
from statelog.operators import compaction as K
from statelog.operators import log as L
from statelog.operators import merkle as M
from statelog.operators import proof as P
from statelog.operators import state as S
from statelog.runtime import cut

SCHEMA = "height bigint, task_idx int, cset_idx int, op_seq int, op_type int, shard_id int, key_hash binary, key binary, value binary, version bigint"
sha = lambda b: hashlib.sha256(b).digest()


def rows(n=900, keys=120, seed=7):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        h, t, s = 1 + i // 90, i % 90 // 6, i % 6
        kind = rng.choice([1, 2, 2, 3, 3, 4])
        key = b"key%d" % min(rng.randrange(keys), rng.randrange(keys))
        out.append((h, t, s // 3, s, kind, None, None, key, None if kind == 4 else b"v%d" % i, h << 24 | t))
    return out


class Model:
    """The store as its rules read: a sorted list of live entries, opened by sentries."""

    def __init__(self):
        self.log = []  # (shard, sn, key_hash, key, value, next, version, last_version, dsn)
        self.next = [4096] * 16
        self.live = {}
        for n in range(65536):
            h = n.to_bytes(2, "big") + bytes(30)
            nxt = (n + 1).to_bytes(2, "big") + bytes(30) if n < 65535 else b"\xff" * 32
            self.live[h] = dict(sn=n % 4096, key=h, value=b"", next=nxt, version=0)
            self.log.append((n // 4096, n % 4096, h, h, b"", nxt, 0, -1, []))
        self.effects = []

    def append(self, h, key, value, nxt, version, last, dsn):
        shard = h[0] >> 4
        sn = self.next[shard]
        self.next[shard] += 1
        self.live[h] = dict(sn=sn, key=key, value=value, next=nxt, version=version)
        self.log.append((shard, sn, h, key, value, nxt, version, last, dsn))

    def apply(self, kind, key, value, version):
        h = sha(key)
        if kind == 1:
            return
        if kind == 4:
            if h not in self.live:
                return self.effects.append("noop")
            old = self.live.pop(h)
            p = max(x for x in self.live if x < h)
            e = self.live[p]
            self.append(p, e["key"], e["value"], old["next"], version, e["version"], [old["sn"], e["sn"]])
            return self.effects.append("delete")
        if h in self.live:
            old = self.live[h]
            self.append(h, key, value, old["next"], version, old["version"], [old["sn"]])
            return self.effects.append("write")
        p = max(x for x in self.live if x < h)
        e = dict(self.live[p])
        self.append(h, key, value, e["next"], version, -1, [])
        self.append(p, e["key"], e["value"], h, version, e["version"], [e["sn"]])
        return self.effects.append("create")


@pytest.fixture(scope="module")
def model():
    m = Model()
    for r in sorted(rows(), key=lambda r: (r[9], r[3])):
        m.apply(r[4], r[7], r[8], r[9])
    return m


@pytest.fixture(scope="module")
def ops(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    return cut(C.ordered_ops(df.unionByName(df.where("op_seq = 2"))))


@pytest.fixture(scope="module")
def log(spark, ops):
    return cut(L.whole_log(C.classified(ops)))


def test_effects(ops, model):
    got = [r.effect for r in C.classified(ops).orderBy("version", "op_seq").collect()]
    assert got == model.effects


def test_log_rows(log, model):
    cols = ("shard_id", "sn", "entity", "key", "value", "next_key_hash", "version", "last_version", "dsn")
    got = sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in (r[c] for c in cols)) for r in log.where("sn >= 4096").collect())
    assert got == sorted(x for x in model.log if x[1] >= 4096)


def entry(r):
    _, sn, _, key, value, nxt, version, last, dsn = r
    body = bytes([len(key)]) + len(value).to_bytes(3, "little") + bytes([len(dsn)]) + key + value
    body += bytes(-len(body) % 8) + nxt
    return body + b"".join(x.to_bytes(8, "little", signed=True) for x in (version, last, sn, *dsn))


def model_roots(model, dead_below=0):
    roots = {}
    for shard in range(16):
        mine = sorted((r for r in model.log if r[0] == shard), key=lambda r: r[1])
        dead = {d for r in mine for d in r[8]}
        twigs = -(-len(mine) // 2048)
        level = []
        for t in range(twigs):
            hs = [sha(entry(r)) for r in mine[t * 2048 : (t + 1) * 2048]]
            hs += [null_left(0)] * (2048 - len(hs))
            for lv in range(11):
                hs = [sha(bytes([lv]) + hs[i] + hs[i + 1]) for i in range(0, len(hs), 2)]
            bits = bytearray(256)
            for i in range(2048):
                sn = t * 2048 + i
                if sn < len(mine) and sn not in dead:
                    bits[i >> 3] |= 1 << (i & 7)
            ps = [bytes(bits[i * 32 : i * 32 + 32]) for i in range(8)]
            for lv in (8, 9, 10):
                ps = [sha(bytes([lv]) + ps[i] + ps[i + 1]) for i in range(0, len(ps), 2)]
            level.append(sha(b"\x0b" + hs[0] + ps[0]))
        lv = 12
        while len(level) > 1:
            if len(level) % 2:
                level.append(null_upper(lv))
            level = [sha(bytes([lv]) + level[i] + level[i + 1]) for i in range(0, len(level), 2)]
            lv += 1
        roots[shard] = (lv, level[0])
    return roots


def test_trees_proofs_and_recovery(spark, log, model):
    active = cut(L.active_entries(log))
    assert {bytes(r.entity) for r in active.select("entity").collect()} == set(model.live)
    tree_twigs, upper = M.tree(log, active)
    nodes = cut(M.nodes_of_tree(tree_twigs, upper))
    assert M.inconsistent(nodes).collect() == []
    roots = cut(M.roots_of(nodes))
    assert {r.shard_id: (r.level, bytes(r.root_hash)) for r in roots.collect()} == model_roots(model)
    twigs = M.twig_trees(M.leaf_hashes(log), active)
    assert {(r.shard_id, r.level, bytes(r.root_hash)) for r in M.shard_roots(twigs).collect()} == {(r.shard_id, r.level, bytes(r.root_hash)) for r in roots.collect()}
    # proofs of live, dead and unused leaves
    asked = log.where("sn % 97 = 3").select("shard_id", "sn").unionByName(spark.createDataFrame([(0, 6000), (5, 6143)], "shard_id int, sn bigint"))
    proofs = cut(P.proof_paths(asked, tree_twigs, upper, roots))
    assert proofs.count() == asked.count()
    assert {r.valid for r in P.check_proofs(proofs, roots).collect()} == {True}
    encoded = cut(P.encode_proofs(proofs, roots))
    assert {r.valid for r in P.decode_proofs(encoded).collect()} == {True}
    one = encoded.first()
    assert {(r.shard_id, r.sn) for r in P.decode_proofs(encoded).collect()} == {(r.shard_id, r.sn) for r in asked.collect()}
    assert len(one.proof) % 32 == 8 and one.proof[-32:] == {r.shard_id: bytes(r.root_hash) for r in roots.collect()}[one.shard_id]
    spoilt = encoded.withColumn("proof", F.concat(F.substring("proof", 1, 60), F.unhex(F.lit("00112233445566")), F.expr("substring(proof, 68)")))
    assert {r.valid for r in P.decode_proofs(spoilt).collect()} == {False}
    own = F.transform("steps", lambda s: s.withField("self_hash", F.when((s["part"] == "left") & (s["level"] == 0), F.unhex(F.lit("00" * 32))).otherwise(s["self_hash"])))
    assert {r.valid for r in P.check_proofs(proofs.withColumn("steps", own), roots).collect()} == {False}
    w = cut(P.witness(asked.where("shard_id < 3"), nodes, roots))
    assert {r.valid for r in P.verify_witness(w, roots).collect()} == {True}
    stored = asked.join(log.select("shard_id", "sn"), ["shard_id", "sn"], "left_semi")
    back = P.read_witness(P.witness_bytes(w, stored), M.leaf_hashes(stored.join(log, ["shard_id", "sn"])))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, w.select("shard_id", "level", "nth", "hash").withColumn("level", F.col("level").cast("int")).collect()))
    bad = w.withColumn("hash", F.when(F.col("given"), F.unhex(F.lit("11" * 32))).otherwise(F.col("hash")))
    assert {r.valid for r in P.verify_witness(bad, roots).collect()} == {False}
    # pruning and recovery
    ends = log.groupBy("shard_id").agg(F.max(F.shiftright("sn", 11)).alias("end"))
    left = cut(K.pruned_nodes(nodes, ends))
    assert left.count() < nodes.count() / 2
    back = K.recovered_roots(left.where("level = 12 and not is_edge"), left.where("is_edge"))
    assert K.recovery_mismatches(back, roots).collect() == []
    # twigs that changed are enough
    old_log = log.where(F.col("version") < 8 << 24)
    old = M.twig_trees(M.leaf_hashes(old_log), L.active_entries(old_log)).select("shard_id", F.col("twig").alias("nth"), F.col("twig_root").alias("hash"))
    news = log.where(F.col("version") >= 8 << 24)
    touched = news.select("shard_id", F.shiftright("sn", 11).alias("twig")).unionByName(news.select("shard_id", F.explode(F.transform("dsn", lambda x: F.call_function("shiftright", x, F.lit(11)))).alias("twig"))).distinct()
    updated = {(r.shard_id, r.nth, bytes(r.hash)) for r in M.updated_twigs(old, log, active, touched).collect()}
    assert updated == {(r.shard_id, r.twig, bytes(r.twig_root)) for r in twigs.select("shard_id", "twig", "twig_root").collect()}


def test_upper_tree_of_many_twigs(spark):
    n = 700
    roots = spark.range(n).select(F.lit(0).alias("shard_id"), F.col("id").alias("nth"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("hash"))
    level, lv = [sha(str(i).encode()) for i in range(n)], 12
    while len(level) > 1:
        if len(level) % 2:
            level.append(null_upper(lv))
        level = [sha(bytes([lv]) + level[i] + level[i + 1]) for i in range(0, len(level), 2)]
        lv += 1
    top = M.roots_of(roots.select("shard_id", F.lit(12).alias("level"), "nth", "hash").unionByName(M.upper_nodes(roots))).first()
    assert (top.level, bytes(top.root_hash)) == (lv, level[0])
    assert null_bits(11) != null_left(11)


def test_lookups(spark, ops, model):
    state = cut(S.latest(ops))
    assert {bytes(r.key): bytes(r.value) for r in state.collect()} == {e["key"]: e["value"] for h, e in model.live.items() if e["value"]}
    chain = cut(S.with_successor(state, S.sentry_keys(spark)))
    assert {(bytes(r.key_hash), bytes(r.next_key_hash)) for r in chain.collect()} == {(h, e["next"]) for h, e in model.live.items()}
    probes = spark.createDataFrame([(sha(b"key%d" % i), b"key%d" % i) for i in range(130)] + [(sha(b"key1"), b"other"), (sha(b"key1"), None)], "key_hash binary, key binary")
    found = {(bytes(r.key_hash), None if r.key is None else bytes(r.key)): r.found for r in S.point_lookup(probes, state).collect()}
    live = {e["key"] for e in model.live.values()}
    assert all(found[sha(b"key%d" % i), b"key%d" % i] == (b"key%d" % i in live) for i in range(130))
    assert found[sha(b"key1"), b"other"] is False and found[sha(b"key1"), None] == (b"key1" in live)
    for r in S.predecessors(probes.select("key_hash"), chain).collect():
        h = bytes(r.key_hash)
        assert bytes(r.prev_key_hash) == max(x for x in model.live if x < h) and r.exists == (h in model.live)
    for r in S.non_existence(probes.select("key_hash"), chain).collect():
        assert bytes(r.key_hash) not in model.live and bytes(r.prev_key_hash) < bytes(r.key_hash) < bytes(r.next_key_hash)


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    ops = C.ordered_ops(none)
    assert S.latest(ops).collect() == [] and C.classified(ops).collect() == []
    assert L.entry_log(C.classified(ops)).collect() == []
    nulls = spark.createDataFrame([(None,) * 10, (1, 0, 0, None, 2, 0, None, b"k", b"v", 5), (1, 0, 0, 1, 2, 0, None, None, b"v", 5)], SCHEMA)
    assert C.ordered_ops(nulls).collect() == []


def plain_compaction(touches, factor, div, least):
    from collections import OrderedDict

    out = []
    for shard in range(16):
        live = OrderedDict(((shard * 4096 + i).to_bytes(2, "big") + bytes(30), i) for i in range(4096))
        first, nxt, gone = 0, 4096, None
        for t in [t for t in touches if t[0] == shard]:
            _, entity, kind = t[:3]
            if kind == "gone":
                gone = live.pop(entity)
                continue
            dsn = [] if kind == "new" else [live.pop(entity)] if gone is None else [gone, live.pop(entity)]
            live[entity] = nxt
            out.append((shard, nxt, entity, kind, dsn))
            nxt += 1
            tries = 0 if gone is not None else {"prev": 2, "write": 1}.get(kind, 0)
            gone = None
            for _ in range(tries):
                if (nxt - first) * div < len(live) * factor or nxt - first < least:
                    break
                e = min(live, key=live.get)
                old = live.pop(e)
                live[e] = nxt
                out.append((shard, nxt, e, "moved", [old]))
                nxt += 1
                first = old + 1
    return sorted(out)


def test_compaction(ops):
    touches = cut(L.touch_rows(C.classified(ops)))
    rows_ = [(r.shard_id, bytes(r.entity), r.kind) for r in touches.orderBy("shard_id", "version", "op_seq", "sub").collect()]
    got = sorted((r.shard_id, r.sn, bytes(r.entity), r.kind, r.dsn) for r in K.compacted_log(touches, 101, 100, 500).collect())
    assert got == plain_compaction(rows_, 101, 100, 500)
    assert any(r[3] == "moved" for r in got)
    assert [r.kind for r in K.compacted_log(touches).collect()].count("moved") == 0  # far below the default threshold


def test_prune_schedule():
    first = {64: 9, 70: 12}
    assert K.prune_target(74, first, 20 * 2048, 0) == 9
    assert K.prune_target(75, first, 20 * 2048, 0) is None  # not this block
    assert K.prune_target(74, first, 6 * 2048, 0) == 5  # compaction isn't further
    assert K.prune_target(74, first, 20 * 2048, 8) is None  # under two twigs
    assert K.prune_target(10, {0: 3}, 9999, 0) is None
