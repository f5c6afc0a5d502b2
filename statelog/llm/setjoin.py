"""All pairs of records whose sets overlap above a similarity threshold (Jaccard).

Copies of a set are one class, named by the digest of its members. Members are ordered from rare to frequent, and each class goes
to the list groups of its first members: two sets that are similar enough share one of those. Inside a group, inverted lists
over all members are merged: a probe skips along its short lists with a heap and searches its longest lists by bisection, which
finds the sets that reach the required number of common members without listing pairs.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelog.llm.baskets import HOT, look_up
from statelog.runtime import BROADCAST_ROWS, broadcast_if_small, cut

#: Sets in a list group from which it is cut into tiles of about this size.
TILE = 4000
_EPS = 1e-9
#: Weighs merging a list against searching it when the number of lists to search is chosen; any value gives the same pairs. The one that
#: papers on merging lists with a divided set of long ones report for short records.
_LONG_WEIGHT = 0.0085
_PAIR = "field string, class_a string, class_b string, common int, size_a int, size_b int"


def required(a: int, b: int, t: float) -> int:
    """Common members that sets of ``a`` and ``b`` members need for a Jaccard similarity of ``t``."""
    return math.ceil(t / (1 + t) * (a + b) - _EPS)


def classes(records: DataFrame, min_size: int) -> DataFrame:
    """``(field, name, class_id, members)`` of records ``(field, name, members)`` with at least ``min_size`` distinct members.

    Null members don't count and a null set is empty. Records with equal sets in a field have equal class ids.
    """
    m = F.array_sort(F.array_distinct(F.filter(F.coalesce("members", F.array().cast("array<string>")), lambda x: x.isNotNull())))
    r = records.select("field", "name", m.alias("members")).where((F.size("members") >= min_size) & F.expr("field is not null and name is not null"))
    return r.withColumn("class_id", F.sha2(F.to_json("members"), 256))


def _overlaps(sets: list[list[int]], probes: list[int], indexed: list[int], t: float, sizes: list[int] | None = None) -> Iterator[tuple[int, int, int]]:
    """``(x, y, common)`` for probes x and indexed y, y before x in the order of size, that reach the required overlap.

    ``sets`` is ordered by size; ``probes`` and ``indexed`` are ascending positions in it. ``sizes`` counts members that are left out of
    ``sets`` as no other set holds them.
    """
    lists: dict[int, list[int]] = {}
    for y in indexed:
        for token in sets[y]:
            lists.setdefault(token, []).append(y)
    sizes = sizes or [len(s) for s in sets]
    for x in probes:
        n = sizes[x]
        least = math.ceil(t * n - _EPS)
        lo = bisect_left(sizes, least)
        own = []  # list, first position in it, end
        for token in sets[x]:
            ids = lists.get(token)
            if ids:
                i, end = bisect_left(ids, lo), bisect_left(ids, x)
                if i < end:
                    own.append((end - i, i, end, ids))
        need = required(n, least, t)
        if len(own) < need:
            continue
        own.sort(key=lambda o: o[0])
        longest = own[-1][0]
        n_long = min(need - 1, int(need / (_LONG_WEIGHT * math.log2(longest + 1) + 1)))
        short, long = own[: len(own) - n_long], own[len(own) - n_long :]
        enough = need - n_long
        heads = [(ids[i], k) for k, (_, i, _, ids) in enumerate(short)]
        heapq.heapify(heads)
        at = [o[1] for o in short]
        while len(heads) >= enough:
            y = heads[0][0]
            out = []
            while heads and heads[0][0] == y:
                out.append(heapq.heappop(heads)[1])
            if len(out) >= enough:
                common = len(out)
                want = required(n, sizes[y], t)
                for left, (_, i, end, ids) in zip(range(n_long, 0, -1), reversed(long), strict=True):
                    if common + left < want:
                        break
                    j = bisect_left(ids, y, i, end)
                    common += j < end and ids[j] == y
                if common >= want:
                    yield x, y, common
                ahead = y + 1
            else:  # no set before the one that then leads can reach the overlap: skip to it
                while heads and len(out) < enough - 1:
                    out.append(heapq.heappop(heads)[1])
                if not heads:
                    break
                ahead = heads[0][0]
            for k in out:
                _, _, end, ids = short[k]
                i = bisect_left(ids, ahead, at[k], end)
                at[k] = i
                if i < end:
                    heapq.heappush(heads, (ids[i], k))


def _first_common(a: list[int], b: list[int]) -> int | None:
    other = set(b)
    return next((x for x in a if x in other), None)


def _across(x: int, y: int) -> bool:
    """Whether one of two classes has records in the first table (bit 1) and the other in the second (bit 2)."""
    return bool((x & 1 and y & 2) or (x & 2 and y & 1))


def _group_pairs(rows: list[tuple], token: int, t: float, same_chunk: bool, between: bool) -> Iterator[tuple]:
    """Pairs of one tile of a list group; ``rows`` are (size, class_id, chunk, sides, tokens) in that order."""
    sets = [r[4] for r in rows]
    if same_chunk:
        jobs = [(range(len(rows)), range(len(rows)))]
    else:
        a = [i for i, r in enumerate(rows) if r[2] == rows[0][2]]
        b = [i for i, r in enumerate(rows) if r[2] != rows[0][2]]
        jobs = [(b, a), (a, b)]
    for probes, indexed in jobs:
        for x, y, common in _overlaps(sets, probes, indexed, t, [r[0] for r in rows]):
            if between and not _across(rows[x][3], rows[y][3]):
                continue
            if _first_common(sets[x], sets[y]) == token:  # the pair belongs to this list group alone
                yield (x, y, common)


def _join_groups(t: float, between: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, out = None, [], []

        def flush() -> None:
            if len(rows) > 1:
                for x, y, common in _group_pairs(rows, group[1], t, group[2] == group[3], between):
                    (na, a), (nb, b) = sorted((rows[x][:2], rows[y][:2]), key=lambda r: r[1])
                    out.append((group[0], a, b, common, na, nb))

        for batch in batches:
            for field, token, i, j, size, class_id, chunk, sides, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (field, token, i, j) != group:
                    flush()
                    group, rows = (field, token, i, j), []
                rows.append((size, class_id, chunk, sides, tokens))
            if out:
                yield _pairs_batch(out)
                out = []
        flush()
        if out:
            yield _pairs_batch(out)

    return run


def _pairs_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], [c.split()[0] for c in _PAIR.split(", ")])


def similar_classes(members: DataFrame, threshold: float, tile: int = TILE, small: int = BROADCAST_ROWS) -> DataFrame:
    """``(field, class_a, class_b, common, size_a, size_b)``, class_a < class_b, of all pairs of different sets as similar as ``threshold``.

    ``members`` is a table as :func:`classes` gives it; if it has ``sides`` (see :func:`similar_between`), only pairs across sides are given.
    Members are compared by 64-bit hashes. A list group of more than ``tile`` sets is cut by size into chunks, and pairs of chunks whose
    sizes can be similar are joined in tasks of their own. A member that most sets hold is looked up by a broadcast of bounded size.
    """
    between = "sides" in members.columns
    side = F.bit_or("sides") if between else F.lit(3)
    sets = members.groupBy("field", "class_id").agg(F.first("members").alias("members"), side.cast("int").alias("sides"))
    tokens = sets.select("field", "class_id", "sides", F.size("members").alias("size"), F.explode("members").alias("m")).withColumn("token", F.xxhash64("m")).drop("m")
    tokens = cut(tokens)
    counts = cut(tokens.groupBy("field", "token").agg(F.count("*").alias("n")))
    # tokens of a single set come first and match nothing: n is 1 for those, without a look-up of their own
    known = look_up(tokens, counts.withColumn("many", F.col("n")).withColumn("keeps", F.col("n") > 1), ["field", "token"], ["many"])
    ordered = known.groupBy("field", "class_id", "size", "sides").agg(F.array_sort(F.collect_list(F.struct(F.col("many").alias("n"), "token"))).alias("o"))
    alone = F.col("size") - F.size("o")
    prefix = F.greatest(F.expr(f"size - cast(ceil({threshold} * size - {_EPS}) as int) + 1") - alone, F.lit(0))
    heads = ordered.select("field", "class_id", "size", "sides", F.transform("o", lambda x: x["token"]).alias("tokens"), F.transform(F.slice(F.col("o"), F.lit(1), prefix), lambda x: x["token"]).alias("head"))
    heads = cut(heads.where(F.size("head") > 0))
    listed = heads.select("field", F.explode("head").alias("token"), "size", "class_id", "sides", "tokens")
    load = cut(heads.select("field", F.explode("head").alias("token"), "size").groupBy("field", "token", "size").agg(F.count("*").alias("n")))
    parts = F.ceil(F.col("n") / tile).cast("int")
    hot = load.groupBy("field", "token").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("size", parts.alias("parts")))).alias("sizes")).where(F.col("n") > tile)  # a row a size that occurs
    listed = listed.join(broadcast_if_small(cut(hot.drop("n")), small), ["field", "token"], "left")
    own = F.element_at(F.filter("sizes", lambda x: x["size"] == F.col("size")), 1)["parts"]
    name = lambda size, part: size.cast("long") * (1 << 20) + part
    chunk = F.when(F.col("sizes").isNull(), F.lit(0).cast("long")).otherwise(name(F.col("size"), F.pmod(F.xxhash64("class_id"), own).cast("int")))
    listed = listed.withColumn("chunk", chunk)
    fits = F.filter("sizes", lambda x: (x["size"] >= F.col("size") * threshold - _EPS) & (F.col("size") >= x["size"] * threshold - _EPS))
    others = F.flatten(F.transform(fits, lambda x: F.transform(F.sequence(F.lit(0), x["parts"] - 1), lambda k: name(x["size"], k))))
    others = F.when(F.col("sizes").isNull(), F.array(F.lit(0).cast("long"))).otherwise(others)
    tiled = listed.withColumn("other", F.explode(others)).select("field", "token", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "size", "class_id", "chunk", "sides", "tokens")
    tiled = tiled.repartition("field", "token", "i", "j").sortWithinPartitions("field", "token", "i", "j", "size", "class_id")
    return tiled.mapInArrow(_join_groups(threshold, between), _PAIR)


def similar_between(first: DataFrame, second: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """:func:`similar_classes` between two tables: pairs of which one class has records in ``first`` and the other in ``second``.

    Both are tables as :func:`classes` gives them, with the same fields. Equal sets of both tables are one class and no pair.
    """
    both = first.withColumn("sides", F.lit(1)).unionByName(second.withColumn("sides", F.lit(2)))
    return similar_classes(both, threshold, tile)


def class_links(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(field, name, class_id, copies, links)``: each record with its class, the records of that class and the similar classes."""
    size = members.groupBy("field", "class_id").agg(F.count("*").alias("copies"))
    ends = pairs.select("field", F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("field", "class_id").agg(F.count("*").alias("links"))
    return members.select("field", "name", "class_id").join(size.join(ends, ["field", "class_id"], "left").na.fill(0, ["links"]), ["field", "class_id"]).select("field", "name", "class_id", "copies", "links")


#: Copies of a class that one task joins with others at least, before the class is salted.
COPIES = 2000


def record_pairs(members: DataFrame, pairs: DataFrame, copies: int = COPIES) -> DataFrame:
    """``(field, name_a, name_b)``, name_a < name_b: all pairs of records in the same class or in similar ones.

    The records of a class with many copies are spread over salts, and what they are joined with is repeated for each salt.
    """
    m = members.select("field", "class_id", "name")
    size = cut(m.groupBy("field", "class_id").agg(F.count("*").alias("n")))
    total = size.agg(F.sum("n")).first()[0] or 0
    unit = max(copies, -(-total // HOT))
    salted = size.where(F.col("n") > unit).select("field", "class_id", F.ceil(F.col("n") / unit).cast("int").alias("salts"))
    big = F.broadcast(salted)  # at most HOT classes have over a HOT-th of the records
    m = m.join(big, ["field", "class_id"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("name"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    across = pairs.select("field", "class_a", "class_b")
    for s in "ab":
        side = m.select("field", F.col("class_id").alias(f"class_{s}"), "salt", F.col("name").alias(f"name_{s}"))
        across = across.join(big.withColumnRenamed("class_id", f"class_{s}"), ["field", f"class_{s}"], "left").select(*across.columns, every).join(side, ["field", f"class_{s}", "salt"]).drop("salt")
    many = size.where("n > 1").select("field", "class_id")
    copied = m.join(many, ["field", "class_id"], "left_semi")
    left = copied.select("field", "class_id", "salt", F.col("name").alias("name_a"))
    right = copied.join(big, ["field", "class_id"], "left").select("field", "class_id", F.col("name").alias("name_b"), every)
    within = left.join(right, ["field", "class_id", "salt"]).where("name_a < name_b")
    both = across.select("field", "name_a", "name_b").unionByName(within.select("field", "name_a", "name_b"))
    return both.select("field", F.least("name_a", "name_b").alias("name_a"), F.greatest("name_a", "name_b").alias("name_b")).where("name_a < name_b")
