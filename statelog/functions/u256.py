"""256-bit unsigned numbers as 32 bytes, most significant first, in eight limbs of 32 bits. Their order is that of the bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LIMB = 0xFFFFFFFF


def limbs(b: Column) -> Column:
    """Limbs, least first. Shorter values are filled up with zero bytes in front."""
    padded = F.lpad(F.hex(b), 64, "0")
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(padded, F.lit(57) - i * 8, F.lit(8)), 16, 10).cast("long"))


def from_limbs(parts: Column) -> Column:
    """Bytes of limbs that may be negative or too large: carries run upward, and what leaves the top is dropped."""
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.lit("").alias("digits"))

    def step(acc: Column, limb: Column) -> Column:
        s = limb + acc["carry"]
        return F.struct(F.shiftright(s, 32).alias("carry"), F.concat(F.lpad(F.hex(s.bitwiseAND(F.lit(_LIMB))), 8, "0"), acc["digits"]).alias("digits"))

    return F.unhex(F.aggregate(parts, start, step)["digits"])


def from_decimal(d: Column) -> Column:
    """A whole number of up to 38 digits, not negative."""
    base = F.lit(1 << 32).cast("decimal(20,0)")
    parts, rest = [], d.cast("decimal(38,0)")
    for _ in range(4):
        parts.append((rest % base).cast("long"))
        rest = ((rest - rest % base) / base).cast("decimal(38,0)")
    return from_limbs(F.array(*parts, *[F.lit(0).cast("long")] * 4))


def to_decimal(b: Column) -> Column:
    """As DECIMAL(38, 0); null from about 2 ** 126 on."""
    parts, out = limbs(b), F.lit(0).cast("decimal(38,0)")
    for i in range(4):
        out = (out + F.get(parts, F.lit(i)).cast("decimal(20,0)") * F.lit(str(1 << (32 * i))).cast("decimal(38,0)")).cast("decimal(38,0)")
    high = F.aggregate(F.slice(parts, 5, 4), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return F.when(high == 0, out)


def from_long(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x.cast("long")), 64, "0"))


def add(a: Column, b: Column) -> Column:
    return from_limbs(F.zip_with(limbs(a), limbs(b), lambda x, y: x + y))


def saturating_sub(a: Column, b: Column) -> Column:
    """``a - b``, zero where b is the greater."""
    return F.when(a < b, F.unhex(F.lit("00" * 32))).otherwise(from_limbs(F.zip_with(limbs(a), limbs(b), lambda x, y: x - y)))


def times(a: Column, n: Column) -> Column:
    """``a`` times a number below 2 ** 31."""
    return from_limbs(F.transform(limbs(a), lambda x: x * n.cast("long")))


def total(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` by keys, exact up to 2 ** 31 rows a key; limbs are added per input split first. Nulls count as zero."""
    parts = limbs(F.coalesce(value, F.unhex(F.lit("00" * 32))))
    wide = df.select(*keys, *[F.get(parts, F.lit(i)).alias(f"_l{i}") for i in range(8)])
    g = wide.groupBy(*keys).agg(*[F.sum(f"_l{i}").alias(f"_l{i}") for i in range(8)])
    return g.select(*keys, from_limbs(F.array(*[F.col(f"_l{i}") for i in range(8)])).alias(out))
