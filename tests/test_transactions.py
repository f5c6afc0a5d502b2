"""Access sets, collisions, bundling and execution against plain Python."""

import hashlib
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from statelog.operators import access as A
from statelog.operators import activity
from statelog.operators import bundling as B
from statelog.operators import execution as X
from statelog.runtime import cut
from statelog.sources import blocks as J
from statelog.sources import workload as W

TXS = "height bigint, tx_idx int, txid string, from_addr string, rdo_addr_list array<string>, rnw_addr_list array<string>, rdo_slot_list array<struct<addr:string,index:string>>, rnw_slot_list array<struct<addr:string,index:string>>"
sha = lambda b: hashlib.sha256(b).digest()


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    txs, plain = [], []
    for h in range(1, 13):
        for i in range(rng.randrange(0, 40)):
            addr = lambda: "0x%02x" % min(rng.randrange(60), rng.randrange(60))
            r, w = [addr() for _ in range(rng.randrange(3))], [addr() for _ in range(rng.randrange(4))]
            rs, ws = ([(addr(), str(rng.randrange(3))) for _ in range(rng.randrange(2))] for _ in range(2))
            tx = f"0x{h:04x}{i:04x}"
            txs.append((h, i, tx, "0xAA" if i % 3 else None, [*r, None, ""] or None, [x.upper().replace("0X", "") for x in w], rs, ws or None))
            if i % 5 == 0:
                txs.append((h, i, tx.upper(), "0xaa" if i % 3 else None, r, w, rs, ws))
            coinbase = f"0x{h % 4:02x}"
            plain.append((h, i, {sha(x.encode()) for x in r} | {sha((a + k).encode()) for a, k in rs}, {sha(x.encode()) for x in w if x != coinbase} | {sha((a + k).encode()) for a, k in ws}))
    blocks = [(h, f"0X{h % 4:02X} ", None, None) for h in range(1, 13)] + [(3, None, None, None)]
    return txs, blocks, plain


@pytest.fixture(scope="module")
def sets(spark, data):
    t = spark.createDataFrame(data[0], TXS).withColumn("hash", F.lit(1))
    b = spark.createDataFrame(data[1], "height bigint, coinbase string, block_time timestamp, received_at timestamp")
    return cut(A.numbered(A.access_sets(t, b)))


def test_access_sets(sets, data):
    got = [(r.height, r.tx_idx, {bytes(x) for x in r.r}, {bytes(x) for x in r.w}) for r in sets.orderBy("pos").collect()]
    assert got == data[2]
    assert [r.pos for r in sets.orderBy("pos").collect()] == list(range(len(got)))


def hits(a, b):
    return bool(a[3] & b[3] or a[2] & b[3] or a[3] & b[2])


def test_collisions_and_waves(sets, data):
    plain = data[2]
    pairs = {(a[0], a[1], b[1]) for a in plain for b in plain if a[0] == b[0] and a[1] < b[1] and hits(a, b)}
    assert {tuple(r) for r in A.collisions(A.access_rows(sets)).collect()} == pairs
    wave = {}
    for t in plain:
        wave[t[:2]] = 1 + max([wave[o[:2]] for o in plain if o[0] == t[0] and o[1] < t[1] and hits(o, t)], default=0)
    assert {(r.height, r.tx_idx): r.wave for r in B.waves(sets).collect()} == wave


@pytest.mark.parametrize("single", [False, True])
def test_serial_bundles(sets, data, single):
    plain, sizes, r, w, n = data[2], [], set(), set(), 0
    for t in plain:
        if n and (t[2] & w or t[3] & w or t[3] & r):
            sizes.append(n)
            r, w, n = set(), set(), 0
        if single:
            w |= t[2] | t[3]
        else:
            r |= t[2]
            w |= t[3]
        n += 1
    sizes.append(n)
    got = [x.n_txs for x in B.serial_starts(A.last_collision(sets, single), 3).orderBy("start").collect()]
    assert got == sizes


def naive_reorder(plain, lanes, member):
    """First-fit over lists of transactions; ``member`` tells whether a bundle collides."""
    bundles, done = [[] for _ in range(lanes)], []
    for t in plain:
        i = next((k for k, b in enumerate(bundles) if not member(b, t)), None)
        if i is None:
            i = max(range(lanes), key=lambda k: (len(bundles[k]), -k))
            done.append(len(bundles[i]))
            bundles[i] = []
        bundles[i].append(t)
        if len(bundles[i]) >= 64 or len(set().union(*(x[2] for x in bundles[i]))) > 256 or len(set().union(*(x[3] for x in bundles[i]))) > 256:
            done.append(len(bundles[i]))
            bundles[i] = []
    now, n = [], 0
    for b in bundles:
        for t in b:
            if any(hits(o, t) for o in now):
                done.append(n)
                now, n = [], 0
            now.append(t)
            n += 1
    return done + ([n] if n else [])


def bloom_member(bundle, t):
    def bits(hs):
        return [{int.from_bytes(h[:8], "big") >> 11 * j & 2047 for j in range(5)} for h in hs]

    rd, wr = set().union(*(x for o in bundle for x in bits(o[2]))), set().union(*(x for o in bundle for x in bits(o[3])))
    return any(x <= wr for x in bits(t[2])) or any(x <= wr or x <= rd for x in bits(t[3]))


def test_reorder(sets, data):
    plain = data[2]
    got = {}
    for r in B.reorder(sets, [(4, False), (8, False), (8, True)]).orderBy("bundle").collect():
        got.setdefault((r.lanes, r.bloom), []).append(r.n_txs)
    assert got[4, False] == naive_reorder(plain, 4, lambda b, t: any(hits(o, t) for o in b))
    assert got[8, False] == naive_reorder(plain, 8, lambda b, t: any(hits(o, t) for o in b))
    assert got[8, True] == naive_reorder(plain, 8, bloom_member)
    assert sum(x.n_txs for x in B.reorder(sets, [(4, False)], compat=True).collect()) < len(plain)


def test_schedule(sets, data):
    tasks = [(t[1], sorted(t[2]), sorted(t[3])) for t in data[2] if t[0] == 5]
    placed, failed = B.schedule_block(tasks, 2)
    assert sorted([p[1] for p in placed] + failed) == [t[0] for t in tasks]
    by = {t[0]: (0, 0, set(t[1]), set(t[2])) for t in tasks}
    order = [p[1] for p in sorted(placed)]
    for at, idx, start, ready in placed:
        assert not any(hits(by[order[j]], by[idx]) for j in range(start, at))
        clash = [j for j in range(max(0, start - 128), start) if hits(by[order[j]], by[idx])]
        assert ready == (clash[-1] if clash else max(max(0, start - 128) - 1, 0))
    rows = B.block_schedules(sets, 2).where("height = 5").collect()
    assert sorted((r.out_idx, r.tx_idx, r.bundle_start, r.all_done_idx) for r in rows if not r.failed) == sorted(placed)
    assert sorted(r.tx_idx for r in rows if r.failed) == sorted(failed)


def test_sender_tasks_and_counts(spark, data):
    t = spark.createDataFrame(data[0], TXS)
    tasks = A.sender_tasks(t).collect()
    assert sum(r.n_txs for r in tasks) == len(data[2]) and max(r.n_txs for r in tasks) <= 3
    r = A.merge_ratio(t).first()
    assert (r.n_txs, r.n_tasks) == (len(data[2]), len({(x[0], x[3] and x[3].lower()) for x in data[0]}))
    b = spark.createDataFrame(data[1], "height bigint, coinbase string, block_time timestamp, received_at timestamp")
    got = {(x.field, x.key): x.n_txs for x in activity.activity_by_key(t, b).collect()}
    assert got["coinbase", "0x01"] == sum(p[0] % 4 == 1 for p in data[2])


def test_empty_tables(spark):
    t = spark.createDataFrame([], TXS)
    b = spark.createDataFrame([], "height bigint, coinbase string, block_time timestamp, received_at timestamp")
    s = A.numbered(A.access_sets(t, b))
    assert B.tlp(B.serial_starts(A.last_collision(s))).first().n_bundles == 0
    assert B.reorder(s, [(4, True)]).collect() == [] and B.block_schedules(s).collect() == [] and A.hottest(t) is None
    assert activity.activity_by_key(t, b).collect() == []


def test_violations(spark, data, sets):
    t = sets.where("height = 2")
    whole = t.select("txid", F.col("r").alias("rdo_set"), F.col("w").alias("rnw_set"))
    assert A.violations(sets, whole).collect() == []
    only_read = t.select("txid", F.array_union("r", "w").alias("rdo_set"), F.lit(None).cast("array<binary>").alias("rnw_set"))
    got = A.violations(sets, only_read).collect()
    assert {r.kind for r in got} == {"write"} and len(got) == sum(len(p[3]) for p in data[2] if p[0] == 2)


def test_call_access(spark):
    items = lambda *xs: [bytes(12) + x for x in xs]
    a, b, c = b"a" * 20, b"b" * 20, b"c" * 20
    calls = spark.createDataFrame([(1, a, b, bytes(32), [(1, items(c)), (4, [b"s" * 32]), (9, [b"z" * 32])]), (2, a, b, bytes(31) + b"\1", None), (3, a, None, bytes(32), [])], "task int, caller binary, target binary, value binary, access_list array<struct<kind:int,items:array<binary>>>")
    got = {(r.task, r.mode, bytes(r.hash)) for r in X.call_access(calls).collect()}
    assert got == {(1, "w", sha(a)), (1, "r", sha(b)), (1, "r", sha(c)), (1, "w", b"s" * 32), (2, "w", sha(a)), (2, "w", sha(b)), (3, "w", sha(a))}
    assert [[bytes(x) for x in r.accounts] for r in X.gas_access_list(calls).orderBy("task").collect()] == [[c], [], []]


def account(balance, nonce=0, code="00" * 32):
    return balance.to_bytes(32, "big") + nonce.to_bytes(8, "big") + bytes.fromhex(code)


def test_settlement_rewards_and_transfers(spark):
    a, b, m = b"a" * 20, b"b" * 20, b"m" * 20
    acc = spark.createDataFrame([(a, account(2**200, 4)), (b, account(5))], "address binary, value binary")
    failed = spark.createDataFrame([(1, a, 10, 21000), (2, b, 10, 21000), (3, m, 1, 1)], "task int, caller binary, price bigint, gas_limit bigint")
    s = X.settle_failures(failed, acc)
    assert {r.task: (int.from_bytes(r.paid, "big"), bytes(r.value)) for r in s.collect()} == {1: (210000, account(2**200 - 210000, 5)), 2: (5, account(0, 1))}
    fees = s.select(F.lit(7).cast("long").alias("height"), "paid")
    coin = spark.createDataFrame([(7, m), (8, a), (9, None)], "height bigint, coinbase binary")
    r = X.block_rewards(fees, coin, acc).collect()
    assert len(r) == 1 and int.from_bytes(r[0].value[:32], "big") == 210005
    moves = spark.createDataFrame([(a, b, Decimal(3)), (a, a, Decimal(9)), (b, m, Decimal(8)), (m, b, Decimal(50))], "sender binary, recipient binary, amount decimal(38,0)")
    got = {bytes(x.address): x.balance and int.from_bytes(x.balance, "big") for x in X.transfer_block(moves, acc).collect()}
    assert got == {a: 2**200 - 3, b: 50, m: None}
    errors = X.warm_up(spark.createDataFrame([(1, a, b), (2, m, a), (3, a, None)], "task int, caller binary, target binary"), acc.unionByName(spark.createDataFrame([(b"k" * 20, account(0, 0, "11" * 32))], "address binary, value binary")))
    assert {r.task: r.error for r in errors.collect()} == {1: None, 2: "no caller", 3: None}
    gas = spark.range(1).select(X.initial_gas(F.lit(2), F.lit(24800)).alias("ok"), X.initial_gas(F.lit(2), F.lit(24799)).alias("low"), X.gas_price(F.lit(3).cast("long"), F.lit(5).cast("long")).alias("p")).first()
    assert (gas.ok, gas.low, gas.p) == (24800, None, 0)


def test_diff_ops(spark):
    old = spark.createDataFrame([(b"1", b"a"), (b"2", b"a"), (b"3", b"a"), (b"4", bytes(32)), (b"5", None)], "key binary, value binary")
    new = spark.createDataFrame([(b"1", b"a"), (b"2", b"b"), (b"4", b"x"), (b"5", b"y"), (b"3", bytes(32))], "key binary, value binary")
    assert {(bytes(r.key), r.op_type) for r in X.diff_ops(old, new).collect()} == {(b"2", 2), (b"3", 4), (b"4", 3), (b"5", 3)}
    done = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (1, 3), (2, 1)], "height bigint, task_idx int")
    assert {tuple(r) for r in X.completed_prefix(done).collect()} == {(1, 1), (2, -1)}


def test_json_blocks(spark, tmp_path):
    tx = {"txid": "0x1", "from": "0xa", "rdo_addr_list": ["0xb"], "rnw_addr_list": [], "rdo_slot_list": [{"addr": "0xb", "index": "1"}], "rnw_slot_list": None}
    (tmp_path / "blocks_0.json").write_text(json.dumps([{"height": 1, "coinbase": "0xC", "tx_list": [tx, tx]}, {"height": 2, "coinbase": None, "tx_list": []}]))
    b = J.read_blocks(spark, str(tmp_path / "blocks_0.json"))
    t = J.block_txs(b).orderBy("tx_idx").collect()
    assert b.count() == 2 and [(r.height, r.tx_idx, r.from_addr, r.rdo_slot_list[0]["index"]) for r in t] == [(1, 0, "0xa", "1"), (1, 1, "0xa", "1")]
    flat = J.block_txs(b).drop("coinbase")
    J.write_blocks(flat, b.select("height", "coinbase"), f"{tmp_path}/out")
    assert J.block_txs(J.read_blocks(spark, f"{tmp_path}/out", False)).count() == 2


def test_workloads(spark):
    assert W.fuzz_changes(spark, 1, 2).exceptAll(W.fuzz_changes(spark, 1, 2)).count() == 0
    keys = [bytes(r.key) for r in W.speed_changes(spark, 10, 1).select("key").collect()]
    assert len(set(keys)) == 1024 and set(keys) == {bytes(r.key) for r in W.speed_changes(spark, 10, 0).select("key").collect()}
    free, hot = (B.waves(W.transfer_accesses(spark, 40, 5, n)).agg(F.max("wave")).first()[0] for n in (None, 9))
    assert free == 1 and hot == 5
