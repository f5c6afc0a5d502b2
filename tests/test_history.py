"""Value history and snapshot comparison against plain Python."""

import random

from pyspark.sql import functions as F

from statelog.operators import history as H

SCHEMA = "shard_id int, sn bigint, key binary, value binary, version bigint, last_version bigint, dsn array<bigint>, file_pos bigint"


def rows_of(df):
    return sorted((bytes(r.key), None if r.value is None else bytes(r.value), r.valid_from, r.valid_to) for r in df.collect())


def plain_periods(points):
    out, by = [], {}
    for k, v, x, kind in points:
        by.setdefault(k, []).append((v, x, kind))
    for k, ps in by.items():
        open_ = None
        for v, x, kind in sorted(ps, key=lambda p: p[0]):
            if kind == "end":
                if open_:
                    out.append((k, open_[1], open_[0], v))
                open_ = None
            elif open_ is None or open_[1] != x:
                if open_:
                    out.append((k, open_[1], open_[0], v))
                open_ = (v, x)
        if open_:
            out.append((k, open_[1], open_[0], -1))
    return sorted(out, key=repr)


def test_rules(spark):
    a, b, c = b"a" * 20, b"b" * 20, b"c" * 20
    log = [
        (0, 1, a, b"1", 10, -1, [], 0), (0, 1, a, None, 10, -1, [], None),  # a copy lacks the value
        (0, 2, a, b"1", 20, 10, [1], 1),  # rewritten, same value
        (0, 3, a, b"2", 30, 20, [2], 2),
        (0, 4, b, b"9", 5, -1, [], 3),
        (0, 5, b, b"9", 40, 5, [3, 4], 4),  # deletes a
        (0, 6, a, b"2", 50, -1, [], 5),  # a again, same value: a new period
        (1, 7, c, b"x", 1, -1, [], 6),
        (1, 9, c, b"x", 9, 6, [8], 7),  # the entry of version 6 is missing
        (1, 9, c, b"x", 9, 6, [8], 7),
        (2, 20, a, b"t", 60, -1, [], 8), (2, 21, b, b"9", 70, 5, [20], 9), (2, 22, a, b"t", 70, -1, [], 9),  # deleted, then set again in one version
        (2, 30, c, b"u", 80, -1, [], 8), (2, 31, b, b"9", 80, 70, [30], 9),  # set, then deleted in one version
        (None, 9, c, b"y", 9, 6, [8], 7), (0, 11, None, b"y", 9, 6, None, 7), (0, 12, c, b"y", None, 6, None, 7),
    ]
    df = spark.createDataFrame(log, SCHEMA).withColumn("kind", F.lit("extra"))
    want = sorted([(a, b"1", 10, 30), (a, b"2", 30, 40), (a, b"2", 50, 60), (a, b"t", 60, 70), (a, b"t", 70, -1), (b, b"9", 5, -1), (c, b"x", 1, 6), (c, b"x", 9, 80)])
    assert rows_of(H.value_history(df)) == want
    assert rows_of(H.value_history(df, snapshots=1, fanout=2, depth=1)) == want
    assert rows_of(H.value_history(df.where("false"))) == []
    hashed = H.value_history(df, values=False)
    assert sorted((bytes(r.key), r.valid_from, r.valid_to) for r in hashed.collect()) == [(k, a, b) for k, _, a, b in want]


def test_periods_of_a_hot_key(spark):
    rng = random.Random(3)
    points, at = [], {}
    for _ in range(1500):
        k = rng.choice([b"hot", b"hot", b"hot", b"x", b"y", b"z"])
        at[k] = at.get(k, 0) + rng.randrange(1, 4)
        kind = rng.choice(["set", "set", "set", "end"])
        points.append((k, at[k], rng.choice([b"1", b"2", None]) if kind == "set" else None, kind))
    df = spark.createDataFrame([(*p, False) for p in points], "key binary, version bigint, value binary, kind string, fresh boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_of_repr(H.periods(df.repartition(8)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == plain_periods(points)


def rows_of_repr(df):
    return sorted(((bytes(r.key), None if r.value is None else bytes(r.value), r.valid_from, r.valid_to) for r in df.collect()), key=repr)


def test_snapshot_diff(spark):
    rng = random.Random(4)
    old = [(f"k{i}", rng.randrange(5), None if i % 7 == 0 else "v") for i in range(300)] + [(None, 1, "v")]
    new = [(k, n + (i % 11 == 0), v) for i, (k, n, v) in enumerate(old) if i % 13] + [("new", 1, None), ("k1", 0, "v")]
    a, b = (spark.createDataFrame(x, "id string, n int, v string").withColumn("leaf", F.lit(1)) for x in (old, new))
    got = {(r.change, r.id, r.n, r.v) for r in H.snapshot_diff(a, b, "id", ["n", "v"], 4, 2).collect()}
    was = {k: (n, v) for k, n, v in old if k}
    now = {}
    for k, n, v in new:
        if k and (k not in now or (n, v or "") > (now[k][0], now[k][1] or "")):
            now[k] = (n, v)
    want = {("added", k, *now[k]) for k in now.keys() - was.keys()} | {("removed", k, *was[k]) for k in was.keys() - now.keys()} | {("changed", k, *now[k]) for k in now.keys() & was.keys() if now[k] != was[k]}
    assert got == want
    assert H.snapshot_diff(a, a, "id", ["n", "v"]).collect() == []
    assert H.snapshot_diff(a.where("false"), a.where("false"), "id", ["n", "v"]).collect() == []


def log_of(rng, keys, versions, moves):
    """An entry log of ``versions`` a key, of which the share ``moves`` changes the value and the others repeat it."""
    rows, sn = [], 0
    for k in range(keys):
        before, value = -1, 0
        for v in sorted(rng.sample(range(1, 4000), versions)):
            value += rng.random() < moves
            rows.append((k % 4, sn, b"%020d" % k, b"%d" % (value % 2), v, before, [], sn))
            before, sn = v, sn + 1
    rng.shuffle(rows)
    return rows


def plain_history(rows):
    return sorted(plain_periods([(r[2], r[4], r[3], "set") for r in rows]))


def test_trees_decide_what_is_read(spark):
    """Fewer changes, fewer leaf buckets and rows; a value that changes back between two snapshots is seen; a lost bucket loses periods."""
    rng = random.Random(9)
    read = {}
    for moves in (0.02, 0.3, 1.0):
        rows = log_of(rng, 300, 12, moves)
        df = spark.createDataFrame(rows, SCHEMA)
        points = H.cut(H.value_points(df, 8))
        snaps = H.cut(H.snapshot_rows(points))
        depth = H.depth_of(300)
        leaves = H.changed_leaves(H.leaf_digests(snaps, H.FANOUT**depth), depth).cache()
        differ = H.changed_rows(snaps, depth)
        kept = points.join(differ.select("snapshot", "key"), ["snapshot", "key"], "left_semi")
        read[moves] = (leaves.count(), kept.count())
        assert rows_of(H.value_history(df, 8)) == rows_of(H.periods(kept)) == plain_history(rows)
        one = leaves.join(snaps.where("was is not null and was <> now").withColumn("leaf", H.leaf_of("key", H.FANOUT**depth)), ["snapshot", "leaf"], "left_semi").first()
        lost = kept.withColumn("leaf", H.leaf_of("key", H.FANOUT**depth)).where((F.col("snapshot") != one.snapshot) | (F.col("leaf") != one.leaf))
        assert lost.count() < kept.count() and rows_of(H.periods(lost)) != plain_history(rows)
    assert read[0.02][0] < read[0.3][0] < read[1.0][0] and read[0.02][1] < read[0.3][1] < read[1.0][1] == 3600


def test_histories_do_not_depend_on_how_partitions_are_joined(spark):
    """Small target sizes make adaptive execution join partitions differently; no period may get lost at a boundary."""
    rng = random.Random(11)
    rows = log_of(rng, 20, 200, 0.6)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for size in ("1b", "4k", "64m"):
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        try:
            assert rows_of(H.value_history(df)) == plain_history(rows)
        finally:
            spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
