"""Canonical spelling of identifiers that come as hex text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters taken off both ends of an identifier.
BLANKS = " \t\n\r\f\x0b"


def bare_hex(c: Column) -> Column:
    """Lower-case text without surrounding blanks and without an ``0x`` in front; null stays null."""
    s = F.lower(F.btrim(c, F.lit(BLANKS)))
    return F.when(s.startswith("0x"), F.substring(s, 3, 1 << 30)).otherwise(s)


def prefixed_hex(c: Column) -> Column:
    """As :func:`bare_hex` with ``0x`` in front; blank text and a lone ``0x`` give null."""
    s = bare_hex(c)
    return F.when(F.length(s) > 0, F.concat(F.lit("0x"), s))


def member_set(c: Column) -> Column:
    """Sorted distinct members of a list of identifiers; null, empty and blank members don't count, a null list is empty."""
    items = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), prefixed_hex), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(items))


def slot_set(c: Column) -> Column:
    """Sorted distinct ``addr:index`` texts of a list of slots; a slot without address or index doesn't count."""
    empty = F.array().cast("array<struct<addr:string,index:string>>")
    text = lambda s: F.concat(prefixed_hex(s["addr"]), F.lit(":"), s["index"])
    items = F.filter(F.transform(F.coalesce(c, empty), text), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(items))


def slot_addresses(*lists: Column) -> Column:
    """Sorted distinct addresses of one or more lists of slots."""
    empty = F.array().cast("array<struct<addr:string,index:string>>")
    parts = [F.transform(F.coalesce(c, empty), lambda s: s["addr"]) for c in lists]
    return member_set(F.concat(*parts))
