"""Compaction, pruning and recovery of the entry log."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelog.config import COMPACT_DIV, COMPACT_FACTOR, COMPACT_LEAST, KEPT_HEIGHTS, PRUNE_EVERY, PRUNE_TWIGS, SENTRIES, TWIG_LEAVES
from statelog.functions.codec import max_level
from statelog.functions.hashing import null_upper
from statelog.operators.merkle import roots_of
from statelog.operators.ranged import ranged_max

_OUT = "shard_id int, sn bigint, entity binary, kind string, version bigint, op_seq bigint, sub int, dsn array<bigint>, of_version bigint, of_op_seq bigint, of_sub int"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_KINDS = [pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32()]


class ShardLog:
    """Serial numbers of one shard while entries are appended, replaced and moved."""

    def __init__(self, shard: int, factor: int, div: int, least: int):
        self.factor, self.div, self.least = factor, div, least
        self.first, self.next = 0, SENTRIES
        #: entity -> (serial number, place of its content); in the order of serial numbers
        self.live = OrderedDict(((shard * SENTRIES + i).to_bytes(2, "big") + bytes(30), (i, (0, 0, -1))) for i in range(SENTRIES))

    def touch(self, entity: bytes, kind: str, place: tuple, gone: int | None) -> tuple[int, list[int]]:
        old = self.live.pop(entity, None)
        dsn = [] if kind == "new" else [old[0]] if gone is None else [gone, old[0]]
        sn = self.next
        self.live[entity] = (sn, place)
        self.next += 1
        return sn, dsn

    def remove(self, entity: bytes) -> int:
        return self.live.pop(entity)[0]

    def compact(self) -> tuple | None:
        """Move the oldest live entry to the end if enough of the log is dead: ``(entity, sn, old sn, place)``."""
        total = self.next - self.first
        if total * self.div < len(self.live) * self.factor or total < self.least:
            return None
        entity, (old, place) = self.live.popitem(last=False)
        sn = self.next
        self.live[entity] = (sn, place)
        self.next += 1
        self.first = old + 1
        return entity, sn, old, place


def compacted_log(touches: DataFrame, factor: int = COMPACT_FACTOR, div: int = COMPACT_DIV, least: int = COMPACT_LEAST) -> DataFrame:
    """Serial numbers with compaction: CREATE tries to move an entry twice, WRITE once, DELETE never.

    ``touches(shard_id, entity, kind, version, op_seq, sub)`` in order; kind ``gone`` is a deleted key. A moved row has kind ``moved`` and
    names in ``of_*`` the row whose content it repeats. How many entries move depends on all that went before in the shard, so a shard
    is one ordered stream, of serial numbers without contents; shards run side by side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, log, gone, rows = None, None, None, []
        for b in batches:
            for s, entity, kind, version, seq, sub in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != shard:
                    shard, log, gone = s, ShardLog(s, factor, div, least), None
                if kind == "gone":
                    gone = log.remove(entity)
                    continue
                sn, dsn = log.touch(entity, kind, (version, seq, sub), gone)
                rows.append((s, sn, entity, kind, version, seq, sub, dsn, version, seq, sub))
                deleted, gone = gone is not None, None
                tries = 0 if deleted else 2 if kind == "prev" else 1 if kind == "write" else 0
                for k in range(tries):
                    moved = log.compact()
                    if moved is None:
                        break
                    entity2, sn2, old, place = moved
                    rows.append((s, sn2, entity2, "moved", version, seq, sub + 1 + k, [old], *place))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[i]) for i in range(11)], _NAMES)
            rows = []

    ordered = touches.select("shard_id", "entity", "kind", "version", "op_seq", "sub").repartition("shard_id").sortWithinPartitions("shard_id", "version", "op_seq", "sub")
    return ordered.mapInArrow(run, _OUT)


def prune_target(height: int, first_twig_at: dict[int, int], compact_done_sn: int, pruned_to: int, every: int = PRUNE_EVERY, kept: int = KEPT_HEIGHTS, least: int = PRUNE_TWIGS) -> int | None:
    """Twig up to which a shard is pruned after a block, or None: every ``every`` blocks, but no twig that heights to keep or compaction need."""
    old = height - kept
    if old <= 0 or old % every or old not in first_twig_at:
        return None
    end = min(first_twig_at[old], compact_done_sn // TWIG_LEAVES - 1)
    return end if end >= pruned_to + least else None


def prune_plan(log: DataFrame, oldest: DataFrame, every: int = PRUNE_EVERY, kept: int = KEPT_HEIGHTS, least: int = PRUNE_TWIGS) -> DataFrame:
    """``(shard_id, height, end_twig)``: :func:`prune_target` of each shard and block, as if nothing had been pruned before.

    ``oldest(shard_id, oldest_active_sn)`` has a row a shard. ``height`` is the block after which pruning comes, ``kept`` blocks after the one
    whose twigs go. Twigs in use at a height follow from a running maximum over the shards' blocks.
    """
    per = log.where("version > 0").groupBy("shard_id", F.shiftright("version", 24).alias("at")).agg(F.max("sn").alias("sn"))
    heights = per.select("at").distinct().where(F.col("at") % every == 0)
    base = log.where("version <= 0").groupBy("shard_id").agg(F.max("sn").alias("base"))
    grid = heights.crossJoin(F.broadcast(oldest.select("shard_id", "oldest_active_sn").join(base, "shard_id", "left")))  # a row a shard
    both = per.withColumn("asked", F.lit(False)).unionByName(grid.select("shard_id", "at", F.lit(None).cast("long").alias("sn"), F.lit(True).alias("asked"))).groupBy("shard_id", "at").agg(F.max("sn").alias("sn"), F.max("asked").alias("asked"))
    upto = ranged_max(both.withColumn("own", F.col("sn")), ["shard_id"], ["at"], "own", "before").where("asked")
    j = upto.join(F.broadcast(oldest.join(base, "shard_id", "left")), "shard_id")
    twig = F.shiftright(F.greatest(F.coalesce("sn", F.lit(-1)), "before", F.coalesce("base", F.lit(-1))), 11)
    end = F.least(twig, F.shiftright("oldest_active_sn", 11) - 1)
    return j.select("shard_id", (F.col("at") + kept).alias("height"), end.alias("end_twig")).where(F.col("end_twig") >= least)


def pruned_nodes(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes that stay when twigs below ``ends(shard_id, end)`` go, with ``is_edge`` for those kept only to rebuild the root.

    Above twigs a node goes if all its twigs do, but for the left neighbour of the boundary where the boundary is a right child.
    """
    j = nodes.join(F.broadcast(ends), "shard_id", "left").withColumn("end", F.coalesce("end", F.lit(0).cast("long")))
    up = F.greatest(F.col("level") - 12, F.lit(0))
    bound = F.call_function("shiftright", F.col("end"), up)
    alive_upper = F.call_function("shiftleft", F.col("nth") + 1, up) > F.col("end")
    edge = (F.col("level") >= 12) & (F.col("nth") == bound - 1) & (bound.bitwiseAND(1) == 1)
    below = F.floor(F.col("nth") / F.expr("shiftright(4096, level)")) >= F.col("end")
    alive = F.when(F.col("level") >= 12, alive_upper).otherwise(below)
    return j.withColumn("is_edge", edge & ~alive).where(alive | edge).select("shard_id", "level", "nth", "hash", "is_edge")


def recovered_roots(twig_roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``(shard_id, level, root_hash)`` from the twigs that are left (level 12) and edge nodes, level by level."""
    tops = twig_roots.groupBy("shard_id").agg(max_level(F.max("nth")).alias("top"))
    highest = tops.agg(F.max("top")).first()[0] or 12
    now = twig_roots.select("shard_id", "nth", "hash")
    out = now.withColumn("level", F.lit(12))
    for level in range(12, int(highest)):
        here = now.unionByName(edges.where(F.col("level") == level).select("shard_id", "nth", "hash"))
        side = lambda s: F.max(F.when(F.col("nth").bitwiseAND(1) == s, F.col("hash")))
        null = F.lit(null_upper(level))
        pairs = here.groupBy("shard_id", F.shiftright("nth", 1).alias("nth")).agg(F.coalesce(side(0), null).alias("l"), F.coalesce(side(1), null).alias("r"))
        now = pairs.select("shard_id", "nth", F.unhex(F.sha2(F.concat(F.unhex(F.lit(f"{level:02x}")), F.col("l"), F.col("r")), 256)).alias("hash"))
        out = out.unionByName(now.withColumn("level", F.lit(level + 1)))
    return roots_of(out.join(F.broadcast(tops), "shard_id").where("level <= top").select("shard_id", "level", "nth", "hash"))


def recovery_mismatches(roots: DataFrame, committed: DataFrame) -> DataFrame:
    """Shards whose recovered root isn't the committed one: ``(shard_id)``."""
    j = roots.select("shard_id", "root_hash").join(committed.select("shard_id", F.col("root_hash").alias("was")), "shard_id", "full")
    return j.where(~F.col("root_hash").eqNullSafe(F.col("was"))).select("shard_id")
