"""Hash trees over the entry log: twigs of 2048 leaves, their liveness bits, and the upper tree of each shard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelog.config import TWIG_LEAVES, TWIG_SHIFT
from statelog.functions.codec import max_level, sha256
from statelog.functions.hashing import fold_levels, node_hash, null_left, null_upper
from statelog.operators.log import encoded
from statelog.runtime import cut

#: Levels of the upper tree that one shuffle folds.
STEP = 8


def leaf_hashes(log: DataFrame) -> DataFrame:
    """``(shard_id, sn, leaf)``."""
    return encoded(log).select("shard_id", "sn", sha256(F.col("entry")).alias("leaf"))


def _dense(groups: DataFrame, size: int, filler: bytes) -> DataFrame:
    """``groups(shard_id, grp, cells: array of (at, hash))`` as arrays of ``size`` hashes in place; what is missing is ``filler``."""
    full = groups.withColumn("cells", F.array_sort("cells"))
    n = F.size("cells")
    packed = F.get(F.col("cells"), n - 1)["at"] == n - 1  # no gaps: only the end is to be filled
    tail = F.array_repeat(F.lit(filler), (F.lit(size) - n).cast("int"))
    in_place = F.concat(F.transform("cells", lambda c: c["hash"]), tail)
    by_place = F.map_from_entries("cells")
    spread = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(by_place, i), F.lit(filler)))
    return full.withColumn("cells", F.when(packed, in_place).otherwise(spread))


def left_trees(leaves: DataFrame) -> DataFrame:
    """``(shard_id, twig, h0 .. h11)``: hashes of a twig's leaves level by level; unused leaves hold the null entry.

    One shuffle by twig, 2048 leaves a group; all eleven levels are folded in place.
    """
    at = F.col("sn").bitwiseAND(TWIG_LEAVES - 1).cast("int")
    groups = leaves.groupBy("shard_id", F.shiftright("sn", TWIG_SHIFT).alias("twig")).agg(F.collect_list(F.struct(at.alias("at"), F.col("leaf").alias("hash"))).alias("cells"))
    return fold_levels(_dense(groups, TWIG_LEAVES, null_left(0)).withColumnRenamed("cells", "h0"), "h0", 0, 11)


def active_bits(active: DataFrame) -> DataFrame:
    """``(shard_id, twig, bits)``: 256 bytes of liveness bits, the lowest bit of a byte first, of twigs with live entries."""
    bits = F.substring(F.expr(f"bitmap_construct_agg(sn % {TWIG_LEAVES})"), 1, 256)
    return active.groupBy("shard_id", F.shiftright("sn", TWIG_SHIFT).alias("twig")).agg(bits.alias("bits"))


def _with_bits_tree(twigs: DataFrame) -> DataFrame:
    """Pages and their hashes: ``b8`` (8 pages), ``b9``, ``b10``, ``b11`` (one)."""
    bits = F.coalesce("bits", F.unhex(F.lit("00" * 256)))
    pages = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(bits, i * 32 + 1, F.lit(32)))
    df = twigs.withColumn("b8", pages)
    for level in (8, 9, 10):
        half = 1 << (10 - level)
        df = df.withColumn(f"b{level + 1}", F.array(*[node_hash(level, F.get(F.col(f"b{level}"), F.lit(2 * i)), F.get(F.col(f"b{level}"), F.lit(2 * i + 1))) for i in range(half)]))
    return df


def twig_trees(leaves: DataFrame, active: DataFrame) -> DataFrame:
    """Left trees and bits trees of each twig with ``twig_root``."""
    df = left_trees(leaves).join(active_bits(active), ["shard_id", "twig"], "left")
    df = _with_bits_tree(df)
    return df.withColumn("twig_root", node_hash(11, F.get("h11", F.lit(0)), F.get("b11", F.lit(0))))


def twig_nodes(twigs: DataFrame) -> DataFrame:
    """``(shard_id, level, nth, hash)`` of levels 0 to 12: at level L a twig owns 4096 >> L places, leaves first, bits after."""
    parts = [F.struct(F.lit(level).alias("level"), F.lit(0).alias("start"), F.col(f"h{level}").alias("hs")) for level in range(12)]
    parts += [F.struct(F.lit(level).alias("level"), F.lit(1 << (11 - level)).alias("start"), F.col(f"b{level}").alias("hs")) for level in range(8, 12)]
    parts += [F.struct(F.lit(12).alias("level"), F.lit(0).alias("start"), F.array("twig_root").alias("hs"))]
    rows = twigs.select("shard_id", "twig", F.explode(F.array(*parts)).alias("p")).select("shard_id", "twig", "p.level", "p.start", F.posexplode("p.hs").alias("i", "hash"))
    width = F.expr("shiftright(4096, level)").cast("long")
    return rows.select("shard_id", "level", (F.col("twig") * width + F.col("start") + F.col("i")).alias("nth"), "hash")


def upper_nodes(roots: DataFrame) -> DataFrame:
    """Nodes above the twigs, ``roots(shard_id, nth, hash)`` at level 12: up to the root of each shard, null where there is no twig.

    STEP levels a shuffle, so 2 ** 24 twigs a shard take three.
    """
    tops = roots.groupBy("shard_id").agg(F.max("nth").alias("youngest")).select("shard_id", max_level(F.col("youngest")).alias("top"))
    tops = cut(tops)
    highest = tops.agg(F.max("top")).first()[0] or 12
    below, level, out = roots.select("shard_id", "nth", "hash"), 12, None
    while level < highest:
        groups = below.groupBy("shard_id", F.shiftright("nth", STEP).alias("twig")).agg(F.collect_list(F.struct(F.col("nth").bitwiseAND((1 << STEP) - 1).cast("int").alias("at"), "hash")).alias("cells"))
        folded = fold_levels(_dense(groups, 1 << STEP, null_upper(level)).withColumnRenamed("cells", "h0"), "h0", level, STEP)
        parts = F.array(*[F.struct(F.lit(level + r).alias("level"), F.lit(1 << (STEP - r)).alias("width"), F.col(f"h{r}").alias("hs")) for r in range(1, STEP + 1)])
        rows = folded.select("shard_id", "twig", F.explode(parts).alias("p")).select("shard_id", "p.level", "twig", "p.width", F.posexplode("p.hs").alias("i", "hash"))
        rows = cut(rows.select("shard_id", "level", (F.col("twig") * F.col("width") + F.col("i")).alias("nth"), "hash"))
        out = rows if out is None else out.unionByName(rows)
        level += STEP
        below = rows.where(F.col("level") == level).select("shard_id", "nth", "hash")
    if out is None:
        return roots.select("shard_id", F.lit(13).alias("level"), "nth", "hash").where("false")
    kept = out.join(F.broadcast(tops), "shard_id").where("level <= top")  # one row a shard
    return kept.where(F.col("nth") < F.expr("shiftleft(1L, top - level)")).select("shard_id", "level", "nth", "hash")


def shard_roots(twigs: DataFrame) -> DataFrame:
    """``(shard_id, level, root_hash)`` of each shard."""
    roots = twigs.select("shard_id", F.col("twig").alias("nth"), F.col("twig_root").alias("hash"))
    return roots_of(roots.select("shard_id", F.lit(12).alias("level"), "nth", "hash").unionByName(upper_nodes(roots)))


def roots_of(nodes: DataFrame) -> DataFrame:
    """The topmost node of each shard."""
    return nodes.where("level >= 12").groupBy("shard_id").agg(F.max(F.struct("level", "nth", "hash")).alias("n")).select("shard_id", "n.level", F.col("n.hash").alias("root_hash"))


def tree(log: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each twig's trees in a row (see :func:`twig_trees`) and the nodes of levels 12 and up, both written once."""
    twigs = cut(twig_trees(leaf_hashes(log), active.select("shard_id", "sn")))
    roots = twigs.select("shard_id", F.col("twig").alias("nth"), F.col("twig_root").alias("hash"))
    return twigs, cut(roots.select("shard_id", F.lit(12).alias("level"), "nth", "hash").unionByName(upper_nodes(roots)))


def all_nodes(log: DataFrame, active: DataFrame) -> DataFrame:
    """Every node of every shard's tree: ``(shard_id, level, nth, hash)``."""
    twigs, upper = tree(log, active)
    return nodes_of_tree(twigs, upper)


def nodes_of_tree(twigs: DataFrame, upper: DataFrame) -> DataFrame:
    """The two tables of :func:`tree` as ``(shard_id, level, nth, hash)``."""
    return twig_nodes(twigs).where("level < 12").unionByName(upper.select("shard_id", "level", "nth", "hash"))


def updated_twigs(old: DataFrame, log: DataFrame, active: DataFrame, touched: DataFrame) -> DataFrame:
    """Twig roots after a block: only ``touched(shard_id, twig)`` twigs are hashed again, the others are taken from ``old``.

    ``old`` has ``(shard_id, nth, hash)`` of level 12. Liveness bits of an old twig change without any change of its leaves.
    """
    of = lambda df: df.withColumn("twig", F.shiftright("sn", TWIG_SHIFT)).join(touched, ["shard_id", "twig"], "left_semi").drop("twig")
    new = twig_trees(leaf_hashes(of(log)), of(active.select("shard_id", "sn"))).select("shard_id", F.col("twig").alias("nth"), F.col("twig_root").alias("hash"))
    kept = old.join(touched.withColumnRenamed("twig", "nth"), ["shard_id", "nth"], "left_anti")
    return kept.select("shard_id", "nth", "hash").unionByName(new)


def updated_upper(old: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes of levels 12 and up after the twig roots ``roots(shard_id, nth, hash)`` changed or were added, from those before.

    Only ancestors of changed twigs are hashed again, each once: level by level, the parents of what changed below take one child or
    both from there and the other from ``old(shard_id, level, nth, hash)``. A shard whose youngest twig now asks for a higher root gets one.
    """
    both = old.where("level = 12").select("shard_id", "nth").unionByName(roots.select("shard_id", "nth"))
    tops = cut(both.groupBy("shard_id").agg(max_level(F.max("nth")).alias("top")))
    highest = tops.agg(F.max("top")).first()[0] or 12
    tops = F.broadcast(tops)  # a row a shard
    now, fresh = roots.select("shard_id", "nth", "hash"), roots.select("shard_id", F.lit(12).alias("level"), "nth", "hash")
    for level in range(12, int(highest)):
        parents = now.join(tops, "shard_id").where(F.col("top") > level).select("shard_id", F.shiftright("nth", 1).alias("up")).distinct()
        here = old.where(F.col("level") == level).select("shard_id", "nth", F.col("hash").alias("was"))
        kids = parents.select("shard_id", "up", F.explode(F.array(F.col("up") * 2, F.col("up") * 2 + 1)).alias("nth"))
        kids = kids.join(now, ["shard_id", "nth"], "left").join(here, ["shard_id", "nth"], "left").withColumn("hash", F.coalesce("hash", "was", F.lit(null_upper(level))))
        side = lambda s: F.max(F.when(F.col("nth").bitwiseAND(1) == s, F.col("hash")))
        pairs = kids.groupBy("shard_id", "up").agg(side(0).alias("l"), side(1).alias("r"))
        now = cut(pairs.select("shard_id", F.col("up").alias("nth"), node_hash(level, F.col("l"), F.col("r")).alias("hash")))
        fresh = fresh.unionByName(now.select("shard_id", F.lit(level + 1).alias("level"), "nth", "hash"))
    return fresh.unionByName(old.select("shard_id", "level", "nth", "hash").join(fresh.select("shard_id", "level", "nth"), ["shard_id", "level", "nth"], "left_anti"))


def inconsistent(nodes: DataFrame) -> DataFrame:
    """Nodes that aren't the hash of their children: none in a sound tree. Children that aren't stored above twigs are null twigs."""
    kids = nodes.select("shard_id", (F.col("level") + 1).alias("level"), F.shiftright("nth", 1).alias("nth"), F.col("nth").bitwiseAND(1).alias("side"), F.col("hash").alias("kid"))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("kid")))
    pairs = kids.groupBy("shard_id", "level", "nth").agg(side(0).alias("l"), side(1).alias("r"))
    nulls = F.create_map(*[x for lv in range(12, 64) for x in (F.lit(lv), F.lit(null_upper(lv)))])
    child = F.col("level") - 1
    pairs = pairs.withColumn("l", F.coalesce("l", nulls[child])).withColumn("r", F.coalesce("r", nulls[child]))
    expected = F.unhex(F.sha2(F.concat(F.unhex(F.lpad(F.hex(child.cast("long")), 2, "0")), F.col("l"), F.col("r")), 256))
    return nodes.join(pairs, ["shard_id", "level", "nth"]).where(expected != F.col("hash")).select("shard_id", "level", "nth", "hash")
