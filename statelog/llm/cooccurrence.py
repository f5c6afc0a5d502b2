"""How often two items occur together, and how much more often than chance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelog.llm.baskets import items_of, look_up
from statelog.runtime import cut


#: Items of a basket up to which its pairs are listed in one row; larger baskets are cut into chunks of as many.
CHUNK = 256


def _listed_pairs(sets: DataFrame) -> DataFrame:
    """``(field, a, b)`` of all pairs of ``sets(basket, field, its)``, a before b; pairs of chunks of a large basket are spread over tasks."""
    small = sets.where(F.size("its") <= CHUNK).select("field", F.col("its").alias("xs"), F.col("its").alias("ys"), F.lit(True).alias("same"))
    last = F.ceil(F.size("its") / CHUNK).cast("int") - 1
    places = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(i, last), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    large = sets.where(F.size("its") > CHUNK).select("basket", "field", "its", F.explode(places).alias("p"))
    part = lambda k: F.slice(F.col("its"), F.col(f"p.{k}") * CHUNK + 1, CHUNK)
    large = large.select("basket", "field", part("i").alias("xs"), part("j").alias("ys"), (F.col("p.i") == F.col("p.j")).alias("same"), F.col("p.i").alias("i"), F.col("p.j").alias("j"))
    large = large.repartition("basket", "field", "i", "j").select("field", "xs", "ys", "same")
    firsts = small.unionByName(large).select("field", "ys", "same", F.posexplode("xs").alias("at", "a"))
    after = F.when(F.col("same"), F.slice(F.col("ys"), F.col("at") + 2, F.size("ys"))).otherwise(F.col("ys"))
    return firsts.select("field", "a", F.explode(after).alias("b"))


def item_pairs(baskets: DataFrame, fields: list[str], min_count: int = 1, min_lift: float = 0.0) -> DataFrame:
    """``(field, item_a, item_b, n_a, n_b, n_ab, lift, pmi)`` of pairs that at least ``min_count`` baskets hold with at least ``min_lift``.

    ``baskets`` has one row a basket and an array of distinct items in each field; ``item_a < item_b``. ``lift`` is n_ab N / (n_a n_b),
    ``pmi`` its base-2 logarithm, N the number of baskets. The pruning of items is exact: a pair is no more frequent than its rarer item,
    so items in fewer than ``min_count`` baskets can't take part, and neither can items in more than N / ``min_lift`` baskets.
    Pairs are counted per input split before the shuffle. A basket with under two items and an empty table give no rows.

    The few items that hold a large part of the rows are numbered, or dropped, by a broadcast that :func:`~statelog.llm.baskets.hot_and_cold`
    bounds, and rows of the others are shuffled by item.
    """
    baskets = cut(baskets.select(*fields))
    n = baskets.count()
    most = n / min_lift if min_lift > 0 else n
    counts = cut(items_of(baskets, [], fields).groupBy("field", "item").agg(F.count("*").alias("n")).withColumn("id", F.xxhash64("field", "item")))
    keeps = (F.col("n") >= min_count) & (F.col("n") <= most)
    twice = counts.where(keeps).groupBy("id").count().where("count > 1").limit(1).count()
    if twice:  # two of them share a hash: number them by another one
        counts = cut(counts.withColumn("id", F.xxhash64(F.lit("again"), "item", "field")))
    counts = counts.withColumn("keeps", keeps)
    numbered = baskets.withColumn("basket", F.monotonically_increasing_id())  # read from files: the same on every run
    kept = look_up(items_of(numbered, ["basket"], fields), counts, ["field", "item"], ["id", "n"]).select("basket", "field", F.struct("id", "n").alias("it"))
    sets = kept.groupBy("basket", "field").agg(F.array_sort(F.collect_list("it")).alias("its")).where(F.size("its") > 1)
    together = _listed_pairs(sets).groupBy("field", F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("n_1"), F.col("b.n").alias("n_2")).agg(F.count("*").alias("n_ab"))
    lift = F.col("n_ab") * F.lit(float(n)) / (F.col("n_1") * F.col("n_2").cast("double"))
    enough = (F.col("n_ab") >= min_count) & (F.col("n_ab").cast("double") * n >= F.col("n_1") * F.col("n_2").cast("double") * min_lift)
    out = together.where(enough).withColumn("lift", lift)
    for c in ("a", "b"):
        out = look_up(out, counts.select(F.col("id").alias(c), F.col("item").alias(f"item_{c}"), "n", "keeps"), [c], [f"item_{c}"])
    flip = F.col("item_a") > F.col("item_b")
    side = lambda x, y: F.when(flip, F.col(y)).otherwise(F.col(x))
    return out.select("field", side("item_a", "item_b").alias("item_a"), side("item_b", "item_a").alias("item_b"), side("n_1", "n_2").alias("n_a"), side("n_2", "n_1").alias("n_b"), "n_ab", "lift", F.log2("lift").alias("pmi"))
