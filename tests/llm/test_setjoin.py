"""Similar pairs of sets against comparing all of them."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statelog.llm import setjoin as J

SCHEMA = "field string, name string, members array<string>"


def brute(records, t, least):
    sets = {}
    for f, n, m in records:
        s = {x for x in m or [] if x is not None}
        if f is not None and n is not None and len(s) >= least:
            sets.setdefault(f, {}).setdefault(n, s)
    out = set()
    for f, by in sets.items():
        names = sorted(by)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                c = len(by[a] & by[b])
                if c >= t * (len(by[a]) + len(by[b]) - c) - 1e-9:
                    out.add((f, a, b))
    return out


def records(seed, n=160):
    rng = random.Random(seed)
    base = [[f"{rng.randrange(9)}-{rng.randrange(40)}" for _ in range(rng.randrange(3, 14))] for _ in range(25)]
    out = []
    for i in range(n):
        s = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            s[rng.randrange(len(s))] = f"new{rng.randrange(50)}"
        out.append((rng.choice(["f", "g"]), f"n{i:03}", [*s, "hot" if rng.random() < 0.4 else None, s[0]]))
    out += [("f", "null", None), ("f", "empty", []), (None, "x", list("abcdef")), ("g", None, list("abcdef")), ("f", "few", ["a", None, "a"])]
    return out


@pytest.mark.parametrize(("seed", "t", "tile"), [(1, 0.6, 4000), (2, 0.6, 3), (3, 0.8, 5), (4, 0.5, 2)])
def test_all_pairs(spark, seed, t, tile):
    data = records(seed)
    df = spark.createDataFrame(data, SCHEMA).withColumn("token", F.lit(1)).withColumn("class_id", F.lit("clash"))
    members = J.classes(df.repartition(3), 3)
    pairs = J.similar_classes(members, t, tile)
    got = [tuple(r) for r in J.record_pairs(members, pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data, t, 3)
    links = {(r.field, r.name): (r.copies, r.links) for r in J.class_links(members, pairs).collect()}
    ids = {(r.field, r.name): r.class_id for r in members.collect()}
    linked = {}
    for f, a, b in got:
        if ids[f, a] != ids[f, b]:
            linked.setdefault((f, a), set()).add(ids[f, b])
            linked.setdefault((f, b), set()).add(ids[f, a])
    assert links == {k: (sum(1 for o in ids.items() if o[0][0] == k[0] and o[1] == v), len(linked.get(k, ()))) for k, v in ids.items()}


@pytest.mark.parametrize("tile", [4000, 3])
def test_the_far_side_of_every_switch(spark, tile):
    """No table is small enough to be broadcast whole, and every class is salted: the same pairs."""
    data = records(7)
    members = J.classes(spark.createDataFrame(data, SCHEMA).repartition(3), 3)
    pairs = J.similar_classes(members, 0.6, tile, small=0)
    assert {tuple(r) for r in J.record_pairs(members, pairs, copies=1).collect()} == brute(data, 0.6, 3)


@pytest.mark.parametrize("tile", [4000, 3])
def test_between_two_tables(spark, tile):
    data = records(8, 180)
    one, two = data[::2], data[1::2]
    a, b = (J.classes(spark.createDataFrame(x, SCHEMA), 3) for x in (one, two))
    got = {(r.field, r.class_a, r.class_b) for r in J.similar_between(a, b, 0.5, tile).collect()}
    sets = [{(r.field, r.class_id): frozenset(r.members) for r in x.collect()} for x in (a, b)]
    want = set()
    for (f, ca), sa in sets[0].items():
        for (g, cb), sb in sets[1].items():
            if f == g and ca != cb and len(sa & sb) >= 0.5 * len(sa | sb) - 1e-9:
                want.add((f, min(ca, cb), max(ca, cb)))
    assert got == want and want


def test_many_copies_of_one_set(spark):
    data = [("f", f"c{i}", list("abcdefg")) for i in range(60)] + [("f", "near", list("abcdefh"))]
    members = J.classes(spark.createDataFrame(data, SCHEMA), 6)
    pairs = J.similar_classes(members, 0.6)
    assert pairs.count() == 1  # copies are one class
    for copies in (2000, 7):
        assert J.record_pairs(members, pairs, copies).count() == 60 * 59 // 2 + 60
    assert {(r.copies, r.links) for r in J.class_links(members, pairs).collect()} == {(60, 1), (1, 1)}


def test_empty(spark):
    members = J.classes(spark.createDataFrame([], SCHEMA), 6)
    assert J.similar_classes(members, 0.6).collect() == []


@given(st.lists(st.sets(st.integers(0, 14), min_size=1, max_size=9), min_size=1, max_size=25), st.sampled_from([0.3, 0.5, 0.6, 0.8, 1.0]))
@settings(max_examples=200, deadline=None)
def test_list_merging(sets, t):
    ordered = sorted((sorted(s) for s in sets), key=len)
    every = range(len(ordered))
    got = sorted(J._overlaps(ordered, list(every), list(every), t))
    want = []
    for x in every:
        for y in range(x):
            c = len(set(ordered[x]) & set(ordered[y]))
            if c >= t * (len(ordered[x]) + len(ordered[y]) - c) - 1e-9:
                want.append((x, y, c))
    assert got == want
