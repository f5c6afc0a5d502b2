"""Running values and keyed results over range partitions against plain Python."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statelog.operators import bundling as B
from statelog.operators.ranged import key_activity, ranged_lag, ranged_last, ranged_max, ranged_sum


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    keys = ["hot"] * 600 + [f"k{i % 40}" for i in range(300)] + [None] * 20
    rng.shuffle(keys)
    return [(k, i, rng.choice([None, 1, 2, 5, i])) for i, k in enumerate(keys)]


def test_lag_sum_max(spark, rows):
    df = spark.createDataFrame(rows, "key string, at bigint, v bigint").repartition(7)
    lagged = {(r.key, r.at): r.prev_v for r in ranged_lag(df, ["key"], ["at"], ["v"]).collect()}
    summed = {(r.key, r.at): r.s for r in ranged_sum(df, ["key"], ["at"], "v", "s").collect()}
    most = {(r.key, r.at): r.m for r in ranged_max(df, ["key"], ["at"], "v", "m").collect()}
    seen = {}
    for k, at, v in rows:
        before = seen.setdefault(k, [])
        assert lagged[k, at] == (before[-1] if before else None)
        assert summed[k, at] == sum(x or 0 for x in before)
        assert most[k, at] == max([x for x in before if x is not None], default=-1)
        before.append(v)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_last_true_row(spark, coalesce):
    rng = random.Random(8)
    data = [(rng.choice(["hot"] * 12 + ["a", "b", "c", None]), i, rng.choice([None, "x", "y"]), rng.choice([True, False, False, False, None])) for i in range(1200)]
    data += [("quiet", i, "z", False) for i in range(1200, 2200)] + [("quiet", 2300, None, True), ("quiet", 2301, "q", False)]
    df = spark.createDataFrame(data, "key string, at bigint, v string, f boolean").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        got = {(r.key, r.at): (r.last_v, r.last_at) for r in ranged_last(df, ["key"], ["at"], ["v", "at"], "f").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    last, want = {}, {}
    for k, at, v, f in data:
        want[k, at] = last.get(k, (None, None))
        if f:
            last[k] = (v, at)
    assert got == want


def test_lag_of_nothing(spark):
    df = spark.createDataFrame([], "key string, at bigint, v bigint, prev_other int")
    assert ranged_lag(df, ["key"], ["at"], ["v"]).collect() == []


def test_key_activity_with_hot_key_and_repeats(spark):
    rng = random.Random(2)
    data = [("f", rng.choice(["hot", "hot", "a", "b", None]), rng.randrange(50), str(rng.randrange(30))) for _ in range(2000)]
    data += data[:300] + [("f", "hot", None, "x"), ("f", "hot", 3, None)]
    df = spark.createDataFrame(data, "field string, key string, height bigint, pos string").withColumn("n_rows", F.lit("clash"))
    want = {}
    for _, k, h, p in data:
        if h is not None and p is not None:
            want.setdefault(k, set()).add((h, p))
    got = {r.key: (r.n_txs, r.n_blocks, r.first_height, r.last_height) for r in key_activity(df.repartition(9)).collect()}
    assert got == {k: (len(s), len({h for h, _ in s}), min(s)[0], max(s)[0]) for k, s in want.items()}
    assert key_activity(df.where("false")).collect() == []


def plain_cuts(last):
    starts = []
    for j, c in enumerate(last):
        if not starts or c >= starts[-1]:
            starts.append(j)
    return starts


@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.lists(st.integers(0, 59), max_size=6))
@settings(max_examples=300, deadline=None)
def test_exits_chain_to_the_sequential_rule(back, marks):
    import numpy as np

    last = [max(-1, j - 1 - b) if b < 25 else -1 for j, b in enumerate(back)]
    bounds = sorted({0, *[m for m in marks if m < len(last)], len(last)})
    open_ = None
    for a, b in zip(bounds, bounds[1:], strict=False):
        limits, leaves = B._exits(a, np.array(last[a:b]))
        open_ = a if open_ is None else open_
        open_ = next((x for lim, x in zip(limits, leaves, strict=True) if lim >= open_), open_)
        assert open_ == plain_cuts(last[:b])[-1]


def test_serial_starts_over_partitions(spark):
    rng = random.Random(1)
    last = [max(-1, j - 1 - int(rng.expovariate(0.2))) if rng.random() < 0.7 else -1 for j in range(700)]
    df = spark.createDataFrame(list(enumerate(last)), "pos bigint, last bigint")
    got = sorted((r.start, r.n_txs) for r in B.serial_starts(df, 6).collect())
    starts = plain_cuts(last)
    assert got == [(a, b - a) for a, b in zip(starts, [*starts[1:], len(last)], strict=True)]
    assert B.serial_starts(df.where("false")).collect() == []
