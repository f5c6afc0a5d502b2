"""Node hashes of the state trees, and the hashes of what isn't there."""

from __future__ import annotations

import hashlib
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statelog.config import NULL_VERSION, TWIG_LEAVES


def node_hash(child_level: int, left: Column, right: Column) -> Column:
    """Hash of two children at ``child_level``."""
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit(f"{child_level:02x}")), left, right), 256))


def h2(child_level: int, left: bytes, right: bytes) -> bytes:
    """:func:`node_hash` of Python bytes."""
    return hashlib.sha256(bytes([child_level]) + left + right).digest()


def null_entry() -> bytes:
    """Bytes of the entry that stands for an unused leaf: all empty, versions -2, serial number all ones."""
    version = NULL_VERSION.to_bytes(8, "little", signed=True)
    return bytes(5) + bytes(3) + bytes(32) + version + version + b"\xff" * 8


@cache
def null_left(level: int) -> bytes:
    """Root of a subtree of unused leaves, levels 0 to 11."""
    if level == 0:
        return hashlib.sha256(null_entry()).digest()
    return h2(level - 1, null_left(level - 1), null_left(level - 1))


@cache
def null_bits(level: int) -> bytes:
    """Root of pages of zero bits, levels 8 (a page of 32 bytes) to 11."""
    return bytes(32) if level == 8 else h2(level - 1, null_bits(level - 1), null_bits(level - 1))


@cache
def null_upper(level: int) -> bytes:
    """Root of twigs that don't exist, level 12 and up."""
    if level == 12:
        return h2(11, null_left(11), null_bits(11))
    return h2(level - 1, null_upper(level - 1), null_upper(level - 1))


def fold_levels(df: DataFrame, cells: str, child_level: int, rounds: int) -> DataFrame:
    """``df`` with columns ``h1 .. h<rounds>``: level by level, the hashes over an array column of 2 ** rounds children.

    Each level is a column of its own, so the plan hashes it once and not again for each parent.
    """
    def parent(below: str, level: int):
        return lambda i: node_hash(level, F.get(F.col(below), i * 2), F.get(F.col(below), i * 2 + 1))

    for r in range(rounds):
        below = cells if r == 0 else f"h{r}"
        df = df.withColumn(f"h{r + 1}", F.transform(F.sequence(F.lit(0), F.lit((1 << (rounds - r - 1)) - 1)), parent(below, child_level + r)))
    return df


def page_of(sn: Column) -> Column:
    """Active-bits page (of 256 leaves) inside the twig."""
    return F.floor(F.pmod(sn, F.lit(TWIG_LEAVES)) / 256).cast("int")
