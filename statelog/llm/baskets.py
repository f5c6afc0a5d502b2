"""Transactions as baskets of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statelog.functions.spelling import member_set, prefixed_hex, slot_addresses, slot_set


def distinct_baskets(rows: DataFrame, name: Column, sets: dict[str, Column]) -> DataFrame:
    """``(name, sets...)``: one row a name; each set is the sorted union of the sets in the name's rows.

    Rows without name are ignored. Equal sets of a name collapse before the shuffle, so a name that is repeated in a third of all
    rows costs no more than its different sets.
    """
    tidy = rows.select(name.alias("name"), *[c.alias(k) for k, c in sets.items()]).where("name is not null")
    union = lambda k: F.array_sort(F.array_distinct(F.flatten(F.collect_set(k)))).alias(k)
    return tidy.groupBy("name").agg(*[union(k) for k in sets])


def transactions(txs: DataFrame, fields: list[str]) -> DataFrame:
    """Distinct transactions of ``txs`` with the item sets named: ``rdo_addr_list``, ``rnw_addr_list``, ``rnw_slot_list``, ``slot_addr``."""
    known = {
        "rdo_addr_list": lambda: member_set(F.col("rdo_addr_list")),
        "rnw_addr_list": lambda: member_set(F.col("rnw_addr_list")),
        "rnw_slot_list": lambda: slot_set(F.col("rnw_slot_list")),
        "slot_addr": lambda: slot_addresses(F.col("rdo_slot_list"), F.col("rnw_slot_list")),
    }
    return distinct_baskets(txs, prefixed_hex(F.col("txid")), {f: known[f]() for f in fields})


def items_of(baskets: DataFrame, keep: list[str], fields: list[str]) -> DataFrame:
    """``(keep..., field, item)``: one row for each item of each set."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("items")) for f in fields])
    return baskets.select(*keep, F.explode(pairs).alias("s")).select(*keep, "s.field", F.explode("s.items").alias("item"))


#: Keys that hold at least a HOT-th part of all rows: there are at most as many, so they may always be broadcast.
HOT = 10_000


def hot_and_cold(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``counts(..., n)``, one row a key with its number of rows, parted into the at most HOT keys with a HOT-th of all rows or more, and the rest."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") * HOT >= total
    return counts.where(heavy), counts.where(~heavy)


def look_up(rows: DataFrame, counts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``rows`` with ``values`` of ``counts(keys..., values..., n, keeps)`` by key; rows whose key doesn't keep are dropped.

    ``counts`` is a written table with one row for each key in ``rows`` and its number of rows n. No reducer gets a heavy key: heavy keys,
    HOT at most, are broadcast, and rows of the others are shuffled by key.
    """
    hot, cold = hot_and_cold(counts)
    hot = hot.select(*keys, *[F.col(v).alias(f"_hot_{v}") for v in values], F.col("keeps").alias("_keeps"))
    met = rows.join(F.broadcast(hot), keys, "left")
    done = met.where("_keeps").select(*rows.columns, *[F.col(f"_hot_{v}").alias(v) for v in values])
    rest = met.where("_keeps is null").select(*rows.columns).join(cold.where("keeps").select(*keys, *values), keys)
    return done.unionByName(rest)
