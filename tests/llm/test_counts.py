"""Distinct counts, frequent items and co-occurrence against exact counting."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from statelog.llm import cooccurrence, distinct, frequent
from statelog.llm import baskets as B
from statelog.llm.baskets import items_of, transactions

TXS = "txid string, from_addr string, rdo_addr_list array<string>, rnw_addr_list array<string>, rdo_slot_list array<struct<addr:string,index:string>>, rnw_slot_list array<struct<addr:string,index:string>>"


@pytest.mark.parametrize("n", [0, 1, 40, 3000, 30_000, 400_000])
def test_distinct_within_the_stated_range(spark, n):
    df = spark.range(2 * n).select(F.lit("k").alias("k"), F.sha1((F.col("id") % max(n, 1)).cast("string")).alias("item"))
    df = df.unionByName(df.where("false").select("k", F.lit(None).cast("string").alias("item"))).withColumn("word", F.lit(7))
    r = distinct.estimates(distinct.sketch_words(df, ["k"], "item"), ["k"]).first()
    assert (r is None) if n == 0 else (r.low <= n <= r.high and abs(r.estimate - n) <= distinct.ERROR * n + distinct.SLACK)


def test_distinct_parts_merge_to_the_whole(spark):
    df = spark.range(9000).select((F.col("id") % 3).alias("k"), F.lit("d").alias("d"), (F.col("id") % 5000).cast("string").alias("item"))
    fine = distinct.sketch_words(df, ["k", "d"], "item")
    whole = distinct.estimates(distinct.sketch_words(df, ["d"], "item"), ["d"]).first()
    merged = distinct.estimates(distinct.merge_words(fine, ["d"]), ["d"]).first()
    assert (whole.estimate, whole.sketch) == (merged.estimate, merged.sketch)
    loads = [distinct.estimates(distinct.sketch_words(df.where(c), ["d"], "item"), ["d"]) for c in ("k = 0", "k > 0")]
    again = distinct.merge_words(distinct.words_of(loads[0], ["d"]).unionByName(distinct.words_of(loads[1], ["d"])), ["d"])
    assert distinct.estimates(again, ["d"]).first().sketch == whole.sketch
    sets = {(r.grouping, r.k, r.d): r.estimate for r in distinct.estimates(distinct.grouping_words(fine, ["k", "d"], []), ["grouping", "k", "d"]).collect()}
    assert len(sets) == 3 + 3 + 1 + 1 and sets["all", None, None] == sets["d", None, "d"] == whole.estimate


def baskets(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = [f"0x{min(rng.randrange(200), rng.randrange(200), rng.randrange(200)):x}" for _ in range(rng.randrange(7))]
        if rng.random() < 0.3:
            a += ["0xaaa", "0xbbb"]
        rows.append((f"0x{i:x}", None, a[:2] or None, [*a, None, ""], [(x, "1") for x in a[:1]], [(x, "0x2") for x in a[1:3]]))
        if i % 10 == 0:
            rows.append((f" {i:X}", None, a[:2], [x.upper().replace("0X", "") for x in a], [(x, "1") for x in a[:1]], [(x, "0x2") for x in a[1:3]]))
    rows.append((None, None, ["0x1"], ["0x1"], None, None))
    plain = {r[0]: {x for x in r[3] if x} for r in rows if r[0] and r[0].startswith("0x")}
    return spark.createDataFrame(rows, TXS).withColumn("name", F.lit("clash")).withColumn("item", F.lit(1)), plain


def test_cooccurrence(spark):
    df, plain = baskets(spark)
    n = len(plain)
    single = Counter(x for s in plain.values() for x in s)
    pair = Counter((a, b) for s in plain.values() for a in s for b in s if a < b)
    b = transactions(df, ["rnw_addr_list"])
    for least, lift in ((1, 0.0), (5, 0.0), (3, 2.0)):
        got = {(r.item_a, r.item_b): (r.n_a, r.n_b, r.n_ab, round(r.lift, 9), round(r.pmi, 9)) for r in cooccurrence.item_pairs(b, ["rnw_addr_list"], least, lift).collect()}
        want = {}
        for (x, y), k in pair.items():
            v = k * n / (single[x] * single[y])
            if k >= least and k * n >= lift * single[x] * single[y]:
                want[x, y] = (single[x], single[y], k, round(v, 9), round(math.log2(v), 9))
        assert got == want
    assert cooccurrence.item_pairs(b.where("false"), ["rnw_addr_list"], 1, 0.0).collect() == []


def test_large_baskets(spark, monkeypatch):
    rng = random.Random(6)
    sets = [sorted({f"i{rng.randrange(60)}" for _ in range(rng.choice([3, 30, 45]))}) for _ in range(20)]
    df = spark.createDataFrame([(s,) for s in sets], "items array<string>")
    want = Counter((a, b) for s in sets for a in s for b in s if a < b)
    for chunk in (4, 7, 256):
        monkeypatch.setattr(cooccurrence, "CHUNK", chunk)
        assert {(r.item_a, r.item_b): r.n_ab for r in cooccurrence.item_pairs(df, ["items"]).collect()} == want


def test_hot_keys_are_few_and_none_is_lost(spark, monkeypatch):
    monkeypatch.setattr(B, "HOT", 4)
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 50}") for i in range(900)], "at int, key string")
    counts = rows.groupBy("key").count().selectExpr("key", "count as n", "key <> 'k7' as keeps", "upper(key) as name")
    hot, cold = B.hot_and_cold(counts)
    assert [r.key for r in hot.collect()] == ["hot"] and cold.count() == 50
    for heavy in (4, 10_000, 0):  # one heavy key, all of them, none
        monkeypatch.setattr(B, "HOT", heavy)
        got = sorted((r.at, r.name) for r in B.look_up(rows, counts, ["key"], ["name"]).collect())
        assert got == sorted((r.at, r.key.upper()) for r in rows.collect() if r.key != "k7")


def test_frequent_bounds_and_merge(spark):
    df, plain = baskets(spark, 1500)
    count = Counter(x for s in plain.values() for x in s)
    b = transactions(df, ["rnw_addr_list", "slot_addr"])
    items = items_of(b, [], ["rnw_addr_list", "slot_addr"]).repartition(6)
    cells = frequent.sketch(items, 3, 32)
    got = [r for r in frequent.frequent_items(cells, 3, 32).collect() if r.field == "rnw_addr_list"]
    assert all(r.low <= count[r.item] <= r.high for r in got) and {"0xaaa", "0xbbb"} <= {r.item for r in got}
    parts = [frequent.sketch(items.where(F.pmod(F.xxhash64("item"), F.lit(2)) == k), 3, 32) for k in (0, 1)]
    merged = frequent.merge_sketches(parts[0].unionByName(parts[1]))
    assert {(r.field, r.row, r.cell): r.total for r in merged.collect()} == {(r.field, r.row, r.cell): r.total for r in cells.collect()}
    assert all(r.low <= count[r.item] <= r.high for r in frequent.frequent_items(merged, 3, 32).collect() if r.field == "rnw_addr_list")
    hits = {r.item: r.n for r in frequent.items_with_share(b, ["rnw_addr_list"], 0.02).collect()}
    assert hits == {k: n for k, n in count.items() if n >= 0.02 * len(plain)}
    for width in (2, 5, 20):  # far too small a sketch: items hide behind candidates, and are found
        hits = {r.item: r.n for r in frequent.items_with_share(b, ["rnw_addr_list"], 0.02, 2, width).collect()}
        assert hits == {k: n for k, n in count.items() if n >= 0.02 * len(plain)}
    assert frequent.sketch(items.where("false")).collect() == []


def test_rows_of_the_sketch_are_independent():
    import numpy as np

    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 40_000)
    cells = np.stack([frequent._cells_np(h, r, 512) for r in range(4)])
    first = Counter(map(tuple, cells[:2].T))
    assert max(first.values()) <= 6  # of 40,000 items on 262,144 pairs of cells
    assert min(len(set(c)) for c in cells.tolist()) == 512
