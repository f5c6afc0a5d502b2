"""Full history of changing values, from snapshots compared by hash trees.

A snapshot is the state of all keys at some moment. Keys fall into leaf buckets by hash; a bucket's digest is order-free (count, sum
and xor of row hashes), and a parent's digest follows from its children. Comparing two snapshots descends from the root through
differing nodes only; rows of the leaf buckets that differ are compared key by key, and only the new versions of keys that
differ are appended to the history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statelog.operators.ranged import changed, one_array
from statelog.runtime import broadcast_if_small, cut

#: Children of an inner node, and keys a leaf bucket holds on average: the depth of a tree follows from the number of keys.
FANOUT, LEAF_KEYS = 16, 4
#: Successive snapshots that an entry log is taken as.
SNAPSHOTS = 16


def depth_of(keys: int, fanout: int = FANOUT, leaf_keys: int = LEAF_KEYS) -> int:
    """Levels below the root that so many keys ask for: 1 at least."""
    depth = 1
    while fanout**depth * leaf_keys < keys:
        depth += 1
    return depth


def leaf_of(key: str, leaves: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit("leaf")), F.lit(leaves))


def leaf_digests(rows: DataFrame, leaves: int) -> DataFrame:
    """``(snapshot, leaf, n0, sum0, xor0, n1, sum1, xor1)`` of ``rows(snapshot, key, was, now)``: digests of a snapshot's leaf before and now.

    ``was`` and ``now`` are hashes of a key's row in the snapshot before and in this one, null without a row. Keys that no row names are
    the same in both and would add the same to both digests, so they need no row. Digests are combined before the shuffle.
    """
    parts = []
    for k, c in enumerate(("was", "now")):
        h = F.col(c)
        parts += [F.count(h).alias(f"n{k}"), F.coalesce(F.sum(h.bitwiseAND(0xFFFFFFFF)), F.lit(0)).alias(f"sum{k}"), F.coalesce(F.bit_xor(h), F.lit(0)).alias(f"xor{k}")]
    return rows.withColumn("leaf", leaf_of("key", leaves)).groupBy("snapshot", "leaf").agg(*parts)


_DIFFERS = "n0 <> n1 or sum0 <> sum1 or xor0 <> xor1"


def tree_nodes(leaves: DataFrame, depth: int, fanout: int = FANOUT) -> DataFrame:
    """``(snapshot, level, node, digests...)``: all levels of the trees over :func:`leaf_digests`, the root at level 0, in one shuffle."""
    up = F.array(*[F.struct(F.lit(d).alias("level"), F.expr(f"leaf div {fanout ** (depth - d)}L").alias("node")) for d in range(depth + 1)])
    rows = leaves.withColumn("up", F.explode(up)).select("snapshot", "up.level", "up.node", *[f"{x}{k}" for k in (0, 1) for x in ("n", "sum", "xor")])
    total = [(F.bit_xor if c.startswith("xor") else F.sum)(c).alias(c) for c in rows.columns[3:]]
    return rows.groupBy("snapshot", "level", "node").agg(*total)


def changed_leaves(leaves: DataFrame, depth: int, fanout: int = FANOUT) -> DataFrame:
    """``(snapshot, leaf)`` of the leaf buckets that differ from the snapshot before, found from the root down.

    At each level only children of nodes that differ are looked at.
    """
    nodes = cut(tree_nodes(leaves, depth, fanout))
    found = None
    for d in range(depth + 1):
        here = nodes.where(F.col("level") == d)
        if found is not None:
            parents = found.select("snapshot", F.col("node").alias("parent"))
            parents = F.broadcast(parents) if fanout ** (d - 1) <= 4096 else parents  # at most fanout ** (d - 1) rows a snapshot
            here = here.withColumn("parent", F.expr(f"node div {fanout}L")).join(parents, ["snapshot", "parent"], "left_semi")
        found = here.where(_DIFFERS).select("snapshot", "node")
    return found.select("snapshot", F.col("node").alias("leaf"))


def changed_rows(rows: DataFrame, depth: int, fanout: int = FANOUT) -> DataFrame:
    """Rows of ``rows(snapshot, key, was, now, ...)`` whose key differs from the snapshot before.

    Trees say which leaf buckets differ, and only rows of those are compared. ``rows`` should be a written table.
    """
    leaves = fanout**depth
    todo = broadcast_if_small(cut(changed_leaves(leaf_digests(rows, leaves), depth, fanout)))
    inside = rows.withColumn("leaf", leaf_of("key", leaves)).join(todo, ["snapshot", "leaf"], "left_semi").drop("leaf")
    return inside.where(~F.col("was").eqNullSafe(F.col("now")))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str], fanout: int = FANOUT, depth: int | None = None) -> DataFrame:
    """Rows by which two snapshots differ: ``(change, key, columns...)`` with change ``added``, ``removed`` or ``changed`` (new cells).

    A key comes once in each snapshot; of repeated rows the one with the greatest cells stands. Null keys are ignored. Only rows of leaf
    buckets whose digests differ are joined. The depth follows from the number of keys if it isn't given.
    """
    cells = [x for c in columns for x in (F.col(c), F.col(c).isNull())]

    def one(df: DataFrame) -> DataFrame:
        top = F.max(F.struct(*columns)).alias("cells")
        rows = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(top).select("key", *[F.col("cells")[c].alias(c) for c in columns])
        return cut(rows.select("key", F.struct(*columns).alias("cells"), F.xxhash64(F.col("key"), *cells).alias("h")))

    a, b = one(old), one(new)
    depth = depth or depth_of(max(a.count(), b.count()), fanout)
    none = F.lit(None).cast("bigint")
    sides = a.select(F.lit(0).alias("snapshot"), "key", F.col("h").alias("was"), none.alias("now")).unionByName(b.select(F.lit(0).alias("snapshot"), "key", none.alias("was"), F.col("h").alias("now")))
    leaves = fanout**depth
    todo = broadcast_if_small(cut(changed_leaves(leaf_digests(sides, leaves), depth, fanout).select("leaf")))
    a, b = (x.withColumn("leaf", leaf_of("key", leaves)).join(todo, "leaf", "left_semi").select("key", "cells") for x in (a, b))
    j = a.withColumnRenamed("cells", "was").join(b, "key", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("cells").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("cells")), "changed")
    return j.withColumn("change", change).where("change is not null").select("change", F.col("key").alias(key), *[F.coalesce(F.col("cells"), F.col("was"))[c].alias(c) for c in columns])


def value_points(log: DataFrame, snapshots: int = SNAPSHOTS, values: bool = True) -> DataFrame:
    """``(snapshot, key, version, value, kind, fresh, lo, hi)``: what each version says of a key; kind is ``set`` or ``end``.

    Copies of an entry (shard_id, sn) are one entry, its value from the copies that have one. ``end`` stands at versions where an
    entry of another key names the entry in its dsn, or where an entry of the key is missing. Where the key is set and deleted in
    one version, serial numbers tell which came last; a key set after its deletion is ``fresh`` and starts a new period. Entries with
    equal key and version are one point with the greatest value. Rows without key, version, shard or sn are ignored, and entries none of
    whose copies has a value set a null value.

    ``snapshot`` numbers equal steps of version. ``state`` is a hash of kind and value; the last point of a key in a snapshot has the
    least and the greatest of the key's states in that snapshot, other points have nulls. Without ``values``, value is that hash.
    Names in dsn and entries meet in one shuffle by (shard, sn); points are then spread by key and snapshot, so a key that holds a
    third of the log is spread over the snapshots.
    """
    low, high = log.agg(F.min("version"), F.max("version")).first()
    low, high = low or 0, high or 0
    step = max(1, (high - low) // snapshots + 1)
    e = log.select("shard_id", "sn", "key", "value", "version", "last_version", "dsn").where("shard_id is not null and sn is not null and key is not null and version is not null")
    by = F.struct(F.col("key").alias("key"), F.col("version").alias("version"), F.col("sn").alias("sn"))
    none = lambda c: F.lit(None).cast(e.schema[c].dataType).alias(c)
    named = e.select("shard_id", by.alias("by"), F.explode(F.array_distinct("dsn")).alias("sn")).select("shard_id", "sn", *[none(c) for c in ("key", "value", "version", "last_version")], "by")
    own = e.select("shard_id", "sn", "key", "value", "version", "last_version", F.when(F.lit(False), by).alias("by"))
    g = own.unionByName(named).groupBy("shard_id", "sn").agg(*[F.max(c).alias(c) for c in ("key", "value", "version", "last_version")], F.collect_set("by").alias("by")).where("key is not null")
    long = lambda c: c.cast("bigint")
    point = lambda version, value, set_sn, end_sn: F.struct(long(version).alias("version"), value.alias("value"), long(set_sn).alias("set_sn"), long(end_sn).alias("end_sn"))
    null, no_value = F.lit(None), F.lit(None).cast("binary")
    points = F.concat(
        F.array(point(F.col("version"), F.col("value"), F.col("sn"), null)),
        F.filter(F.array(point(F.col("last_version"), no_value, null, null)), lambda p: p["version"] >= 0),
        F.transform(F.filter("by", lambda b: b["key"] != F.col("key")), lambda b: point(b["version"], no_value, null, b["sn"])),
    )
    slot = F.expr(f"cast(least({snapshots - 1}, greatest(0, (version - {low}L) div {step}L)) as int)").alias("snapshot")
    spread = g.select("key", F.explode(points).alias("p")).select("key", "p.*").select(slot, "*").repartition("key", "snapshot")
    p = spread.groupBy("key", "snapshot", "version").agg(F.max("value").alias("value"), F.max("set_sn").alias("set_sn"), F.max("end_sn").alias("end_sn"))
    sets = F.col("set_sn").isNotNull() & (F.col("end_sn").isNull() | (F.col("end_sn") < F.col("set_sn")))
    p = p.withColumn("fresh", sets & F.col("end_sn").isNotNull())
    p = p.select("snapshot", "key", "version", F.when(sets, F.col("value")).alias("value"), F.when(sets, "set").otherwise("end").alias("kind"), "fresh")
    # a fresh point is a state of its own: the period before it has ended even if the value is the same
    state = F.when(F.col("kind") == "end", F.lit(0).cast("bigint")).when(F.col("fresh"), F.xxhash64("value", "version")).otherwise(F.xxhash64("value"))
    p = p.withColumn("state", state)
    w = Window.partitionBy("key", "snapshot").orderBy("version")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.lead("version").over(w).isNull()
    value = F.col("value") if values else F.when(F.col("kind") == "set", F.xxhash64("value")).alias("value")
    return p.select("snapshot", "key", "version", value, "kind", "fresh", F.when(last, F.col("state")).alias("state"), F.when(last, F.min("state").over(upto)).alias("lo"), F.when(last, F.max("state").over(upto)).alias("hi"))


def snapshot_rows(points: DataFrame) -> DataFrame:
    """``(snapshot, key, was, now)``: hashes of each key's row in the snapshot before and in this one, where a point names the key.

    A key's row is its last state and the number of snapshots in which it took several, so a value that changes and changes back between
    two snapshots differs too. At most one row a key and snapshot.
    """
    w = Window.partitionBy("key").orderBy("snapshot")
    turns = F.sum((F.col("lo") != F.col("hi")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = points.where("state is not null").select("snapshot", "key", "state", turns.alias("turns")).withColumn("now", F.xxhash64("key", "state", "turns"))
    return rows.select("snapshot", "key", F.lag("now").over(w).alias("was"), "now")


_RUN = ["key", "version", "value", "kind", "fresh", "until", "opens", "closes"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal (kind, value) of each key in a partition sorted by key and version; a fresh point starts one anyway.

    ``until`` is the version of the key's next run in the partition; ``opens`` and ``closes`` mark a key's first and last run.
    """
    kinds: list[pa.DataType] = []
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(8)], _RUN)
    last = open_run = None
    for b in batches:
        if not b.num_rows:
            continue
        k, v, x, kind, fresh = (one_array(b.column(i)) for i in range(5))
        kinds = [k.type, v.type, x.type, kind.type, fresh.type, pa.int64(), pa.bool_(), pa.bool_()]
        new_key = changed(k, last and last[0])
        new_run = new_key | changed(x, last and last[1]) | changed(kind, last and last[2]) | fresh.to_numpy(zero_copy_only=False).astype(bool)
        at = new_run.nonzero()[0]
        out = []
        for *run, first in zip(*(c.take(pa.array(at)).to_pylist() for c in (k, v, x, kind, fresh)), new_key[at].tolist(), strict=True):
            if open_run is not None:
                open_run[5], open_run[7] = (None, True) if first else (run[1], False)
                out.append(open_run)
            open_run = [*run, None, first, True]
        last = (k[-1], x[-1], kind[-1])
        if out:
            yield batch(out)
    if open_run is not None:
        yield batch([open_run])


def periods(points: DataFrame) -> DataFrame:
    """``(key, value, valid_from, valid_to)`` of points ``(key, version, value, kind, fresh)``, one a key and version; -1 while it still holds.

    Points are range partitioned on (key, version), so a key with most of the points is spread over partitions; only a key's first
    and last run in a partition go through the stitching step. The runs are written once: both steps must see the same partitions.
    """
    points = points.select("key", "version", "value", "kind", "fresh")
    schema = points.select("*", F.col("version").alias("until"), F.lit(True).alias("opens"), F.lit(True).alias("closes")).schema
    schema = type(schema)([type(f)(f.name, f.dataType, True) for f in schema.fields])
    runs = cut(points.repartitionByRange("key", "version").sortWithinPartitions("key", "version").mapInArrow(_runs, schema))
    inner = runs.where("not opens and not closes and kind = 'set'").select("key", "value", F.col("version").alias("valid_from"), F.col("until").alias("valid_to"))
    w = Window.partitionBy("key").orderBy("version")
    # a run that isn't its key's first in a partition has begun there; a first one may go on from the partition before
    goes_on = F.col("opens") & ~F.col("fresh") & F.lag("value").over(w).eqNullSafe(F.col("value")) & F.lag("kind").over(w).eqNullSafe(F.col("kind"))
    edge = runs.where("opens or closes").withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(w))
    whole = edge.groupBy("key", "run").agg(F.min("version").alias("valid_from"), F.max("until").alias("until"), F.max("value").alias("value"), F.max("kind").alias("kind"))
    ends = F.coalesce(F.col("until"), F.lead("valid_from").over(Window.partitionBy("key").orderBy("valid_from")), F.lit(-1))
    whole = whole.withColumn("valid_to", ends.cast("long")).where("kind = 'set'").select("key", "value", "valid_from", "valid_to")
    return inner.unionByName(whole)


def value_history(log: DataFrame, snapshots: int = SNAPSHOTS, fanout: int = FANOUT, depth: int | None = None, values: bool = True) -> DataFrame:
    """Validity periods ``(key, value, valid_from, valid_to)`` of the values of each key in an entry log.

    The log is taken as ``snapshots`` successive snapshots at equal steps of version. Each is compared with the one before it by
    hash trees, and the versions of keys that differ are appended to the history; rewrites that leave a key as it was are not read
    again. Without ``values``, value is a hash. An empty log gives no rows.
    """
    points = cut(value_points(log, snapshots, values))
    rows = cut(snapshot_rows(points))
    depth = depth or depth_of(rows.where("was is null").count(), fanout)
    differ = changed_rows(rows, depth, fanout).select("snapshot", "key")
    return periods(points.join(differ, ["snapshot", "key"], "left_semi"))
