"""Byte layouts and hashes against fixed values and hashlib."""

import hashlib

from pyspark.sql import functions as F

from statelog.functions import codec as C
from statelog.functions import hashing as H
from statelog.functions import u256
from statelog.functions.spelling import member_set, prefixed_hex, slot_set


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_entry_layout_and_back(spark):
    b = lambda x: F.unhex(F.lit(x.hex()))
    dsn = F.array(*[F.lit(x).cast("long") for x in (0xF1, 0xF2, 0xF3, 0xF4)])
    e = C.entry_bytes(b(b"key"), b(b"value"), b(b"\xab" * 32), F.lit(12345).cast("long"), F.lit(11111).cast("long"), F.lit(99999).cast("long"), dsn)
    raw = bytes(one(spark, e=e)["e"])
    want = b"\x03" + b"\x05\x00\x00" + b"\x04" + b"keyvalue" + bytes(3) + b"\xab" * 32
    for n in (12345, 11111, 99999, 0xF1, 0xF2, 0xF3, 0xF4):
        want += n.to_bytes(8, "little")
    assert raw == want and len(raw) == 104
    f = one(spark, **C.entry_fields(b(raw)))
    assert (bytes(f.key), bytes(f.value), bytes(f.next_key_hash), f.version, f.last_version, f.sn, f.dsn) == (b"key", b"value", b"\xab" * 32, 12345, 11111, 99999, [0xF1, 0xF2, 0xF3, 0xF4])


def test_integers(spark):
    for x in (0, 1, -1, -2, 2**63 - 1, -(2**63), 117440512000001):
        r = one(spark, le=C.le8(F.lit(x).cast("long")), be=C.be8(F.lit(x).cast("long")), back=C.from_le8(C.le8(F.lit(x).cast("long"))))
        assert bytes(r.le) == x.to_bytes(8, "little", signed=True) and bytes(r.be) == x.to_bytes(8, "big", signed=True) and r.back == x


def test_max_level_table(spark):
    table = {0: 12, 1: 13, 2: 14, 3: 14, 4: 15, 7: 15, 8: 16, 15: 16, 16: 17, 32: 18, 64: 19, 128: 20, 256: 21, 511: 21}
    got = {r.t: r.m for r in spark.createDataFrame([(k,) for k in table], "t bigint").select("t", C.max_level(F.col("t")).alias("m")).collect()}
    assert got == table


def test_positions(spark):
    r = one(spark, p=C.node_pos(F.lit(31), F.lit(100380).cast("long")), leaf=C.sn_to_leaf(F.lit(9787).cast("long")))
    assert r.p == 31 << 56 | 100380 and r.leaf == 9787 // 2048 * 4096 + 9787 % 2048
    assert one(spark, lv=C.pos_level(F.lit(r.p)), n=C.pos_nth(F.lit(r.p))) == (31, 100380)


def test_bloom_slots(spark):
    k = 0x8123456789ABCDEF
    got = one(spark, s=C.bloom_slots(F.lit(f"{k:016x}")))["s"]
    assert got == [k >> 11 * j & 2047 for j in range(5)]


def test_null_hashes():
    leaf = hashlib.sha256(bytes(40) + b"\xfe" + b"\xff" * 7 + b"\xfe" + b"\xff" * 7 + b"\xff" * 8).digest()
    assert H.null_left(0) == leaf
    assert H.null_left(1) == hashlib.sha256(b"\x00" + leaf + leaf).digest()
    assert H.null_bits(9) == hashlib.sha256(b"\x08" + bytes(64)).digest()
    assert H.null_upper(12) == hashlib.sha256(b"\x0b" + H.null_left(11) + H.null_bits(11)).digest()
    assert H.null_upper(13) == hashlib.sha256(b"\x0c" + H.null_upper(12) * 2).digest()


def test_key_hash_of_sentries(spark):
    r = one(spark, plain=C.key_hash(F.unhex(F.lit("6b6579")), F.unhex(F.lit("01"))), sentry=C.key_hash(F.unhex(F.lit("abcd00")), F.unhex(F.lit(""))))
    assert bytes(r.plain) == hashlib.sha256(b"key").digest() and bytes(r.sentry) == b"\xab\xcd" + bytes(30)


def test_u256(spark):
    top = 2**256
    for a, b in ((0, 0), (1, 2), (2**128 - 1, 1), (2**255, 2**255), (top - 1, top - 1), (10**30, 7)):
        x, y = (F.unhex(F.lit(f"{v:064x}")) for v in (a, b))
        r = one(spark, s=u256.add(x, y), d=u256.saturating_sub(x, y), t=u256.times(x, F.lit(3)))
        assert int.from_bytes(r.s, "big") == (a + b) % top
        assert int.from_bytes(r.d, "big") == max(0, a - b)
        assert int.from_bytes(r.t, "big") == 3 * a % top
    r = one(spark, v=u256.from_decimal(F.lit("12345678901234567890123456789").cast("decimal(38,0)")))
    assert int.from_bytes(r.v, "big") == 12345678901234567890123456789
    df = spark.createDataFrame([("a", (2**200).to_bytes(32, "big")), ("a", (2**200 + 5).to_bytes(32, "big")), ("b", None)], "k string, v binary")
    got = {r.k: int.from_bytes(r.t, "big") for r in u256.total(df, ["k"], "v", "t").collect()}
    assert got == {"a": 2**201 + 5, "b": 0}


def test_spelling(spark):
    cases = {" 0xAbC1\n": "0xabc1", "ABC1": "0xabc1", "0Xabc1 ": "0xabc1", "": None, "  ": None, "0x": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", prefixed_hex(F.col("x")).alias("y"))
    assert {r.x: r.y for r in df.collect()} == cases
    lists = spark.createDataFrame([(["0xB", "b ", None, "", "0xa"],), (None,), ([],)], "x array<string>").select(member_set(F.col("x")).alias("y"))
    assert [r.y for r in lists.collect()] == [["0xa", "0xb"], [], []]
    slots = spark.createDataFrame([([("0xB", "1"), ("b", "1"), (None, "2"), ("a", None)],), (None,)], "x array<struct<addr:string,index:string>>")
    assert [r.y for r in slots.select(slot_set(F.col("x")).alias("y")).collect()] == [["0xb:1"], []]
