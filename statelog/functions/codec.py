"""Byte layouts as column expressions: integers, log entries, accounts, node positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statelog.config import SENTRIES, TWIG_LEAVES


def _flip(digits: Column, n: int = 8) -> Column:
    """Hex digits of ``n`` bytes with the order of the bytes turned round."""
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))])


def le8(x: Column) -> Column:
    """64-bit integer as 8 bytes, least first."""
    return F.unhex(_flip(F.lpad(F.hex(x.cast("long")), 16, "0")))


def le3(x: Column) -> Column:
    return F.unhex(_flip(F.lpad(F.hex(x.cast("long")), 6, "0"), 3))


def be8(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x.cast("long")), 16, "0"))


def byte(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x.cast("long")), 2, "0"))


def from_hex(digits: Column) -> Column:
    """Signed 64-bit integer of 16 hex digits, most significant first."""
    high, low = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def from_le8(b: Column) -> Column:
    return from_hex(_flip(F.hex(b)))


def sha256(b: Column) -> Column:
    return F.unhex(F.sha2(b, 256))


def key_hash(key: Column, value: Column | None = None) -> Column:
    """sha256 of the key; with an empty value (sentries) the first two bytes of the key and 30 zero bytes."""
    h = sha256(key)
    if value is None:
        return h
    sentry = F.concat(F.substring(key, 1, 2), F.unhex(F.lit("00" * 30)))
    return F.when(F.length(value) == 0, sentry).otherwise(h)


def first_byte(b: Column) -> Column:
    return F.conv(F.hex(F.substring(b, 1, 1)), 16, 10).cast("int")


def shard_of(hash_: Column) -> Column:
    """Data shard of a key hash: its top four bits."""
    return F.shiftright(first_byte(hash_), 4)


def k64(hash_: Column) -> Column:
    """First eight bytes of a key hash, as bytes: their order is that of unsigned integers."""
    return F.substring(hash_, 1, 8)


def k16(hash_: Column) -> Column:
    return F.substring(hash_, 1, 2)


def pad8(length: Column) -> Column:
    """Zero bytes that fill up to a multiple of eight."""
    return F.unhex(F.repeat(F.lit("00"), F.pmod(8 - F.pmod(length, F.lit(8)), F.lit(8)).cast("int")))


def entry_length(key: Column, value: Column, dsn: Column) -> Column:
    return (F.ceil((F.lit(61) + F.length(key) + F.length(value)) / 8) * 8 + F.size(dsn) * 8).cast("long")


def entry_bytes(key: Column, value: Column, next_hash: Column, version: Column, last_version: Column, sn: Column, dsn: Column) -> Column:
    """Serialised log entry."""
    head = F.concat(byte(F.length(key)), le3(F.length(value)), byte(F.size(dsn)), key, value, pad8(F.length(key) + F.length(value) + 5))
    tail = F.unhex(F.array_join(F.transform(dsn, lambda d: F.hex(le8(d))), ""))
    return F.concat(head, next_hash, le8(version), le8(last_version), le8(sn), tail)


def entry_fields(b: Column) -> dict[str, Column]:
    """Fields of a serialised entry."""
    part = lambda at, n: F.substring(b, at, n)
    klen = F.conv(F.hex(part(F.lit(1), F.lit(1))), 16, 10).cast("int")
    vlen = F.conv(_flip(F.hex(part(F.lit(2), F.lit(3))), 3), 16, 10).cast("int")
    n = F.conv(F.hex(part(F.lit(5), F.lit(1))), 16, 10).cast("int")
    start = F.ceil((F.lit(5) + klen + vlen) / 8).cast("int") * 8
    number = lambda at: from_le8(part(start + at, F.lit(8)))
    count = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return {
        "key": part(F.lit(6), klen),
        "value": part(F.lit(6) + klen, vlen),
        "next_key_hash": part(start + 1, F.lit(32)),
        "version": number(33),
        "last_version": number(41),
        "sn": number(49),
        "dsn": F.transform(count, lambda i: from_le8(F.substring(b, start + 57 + i * 8, F.lit(8)))),
    }


def sentry_prefix(shard: Column, sn: Column) -> Column:
    return shard * SENTRIES + sn


def account_bytes(balance32: Column, nonce: Column, code_hash: Column) -> Column:
    """72-byte account row: balance (32 bytes, most significant first), nonce (8) and code hash (32)."""
    return F.concat(balance32, be8(nonce), code_hash)


def account_fields(b: Column) -> dict[str, Column]:
    return {"balance": F.substring(b, 1, 32), "nonce": from_hex(F.hex(F.substring(b, 33, 8))), "code_hash": F.substring(b, 41, 32)}


def slot_key(address20: Column, index32: Column) -> Column:
    return F.concat(address20, index32)


def node_pos(level: Column, nth: Column) -> Column:
    """Packed node position: level in the top byte."""
    return F.shiftleft(level.cast("long"), 56).bitwiseOR(nth)


def pos_level(pos: Column) -> Column:
    return F.shiftrightunsigned(pos, 56).cast("int")


def pos_nth(pos: Column) -> Column:
    return pos.bitwiseAND((1 << 56) - 1)


def sn_to_leaf(sn: Column) -> Column:
    """Place of a serial number's leaf at level 0."""
    return F.shiftleft(F.shiftright(sn, 11), 12).bitwiseOR(sn.bitwiseAND(TWIG_LEAVES - 1))


def max_level(youngest_twig: Column) -> Column:
    """Level of a shard's root: 12 for one twig, then one more for each doubling."""
    return F.when(youngest_twig == 0, 12).otherwise(12 + F.length(F.bin(youngest_twig))).cast("int")


def bloom_slots(k64_hex: Column, funcs: int = 5, bits: int = 2048) -> Column:
    """Bloom positions of a key: ``funcs`` slices of its first eight bytes, least significant first."""
    x = from_hex(k64_hex)
    width = bits.bit_length() - 1
    return F.transform(F.sequence(F.lit(0), F.lit(funcs - 1)), lambda j: F.call_function("shiftrightunsigned", x, j * width).bitwiseAND(bits - 1).cast("int"))
