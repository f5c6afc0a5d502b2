"""Inclusion proofs of log entries and witnesses of many of them, as relations over tree nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statelog.functions.codec import be8, byte, from_le8, le8, sn_to_leaf
from statelog.functions.hashing import null_bits, null_left, null_upper
from statelog.operators.merkle import leaf_hashes
from statelog.operators.ranged import ranged_sums
from statelog.runtime import cut


def null_hash(level: Column, nth: Column) -> Column:
    """Hash of a node that isn't stored: by its level, and below twig roots by the half of the twig it lies in."""
    left = F.create_map(*[x for lv in range(12) for x in (F.lit(lv), F.lit(null_left(lv)))])
    bits = F.create_map(*[x for lv in range(8, 12) for x in (F.lit(lv), F.lit(null_bits(lv)))])
    upper = F.create_map(*[x for lv in range(12, 64) for x in (F.lit(lv), F.lit(null_upper(lv)))])
    width = F.call_function("shiftright", F.lit(4096), F.least(level, F.lit(12)))
    in_bits = F.pmod(nth, width.cast("long")) * 2 >= width
    return F.when(level >= 12, upper[level]).when(in_bits & (level >= 8), bits[level]).otherwise(left[level])


def _with_hash(positions: DataFrame, nodes: DataFrame, nth: str, out: str) -> DataFrame:
    """``positions`` with the hash of the node ``(shard_id, level, nth)``; a node that isn't stored has its null hash."""
    n = nodes.select("shard_id", "level", F.col("nth").alias(nth), F.col("hash").alias(out))
    j = positions.join(n, ["shard_id", "level", nth], "left")
    return j.withColumn(out, F.coalesce(out, null_hash(F.col("level"), F.col(nth))))


#: Type of a proof's step: the part of the path, the node's level and place, its hash, its sibling's, and the sibling's side.
_STEP = "struct<part:string,level:int,nth:bigint,self_hash:binary,peer_hash:binary,peer_at_left:boolean>"


def _twig_steps(s: Column) -> Column:
    """Steps inside a twig (columns ``twig``, ``h0 .. h11``, ``b8 .. b11``) of the entry at place ``s`` in it, up to level 11."""
    shift = lambda n: F.call_function("shiftright", s, F.lit(n))

    def step(part: str, level: int, cells: str, at: Column, nth: Column, null: bytes) -> Column:
        hash_ = lambda i: F.coalesce(F.get(F.col(cells), i), F.lit(null))
        odd = at.bitwiseAND(1)
        return F.struct(F.lit(part).alias("part"), F.lit(level).alias("level"), nth.alias("nth"), hash_(at).alias("self_hash"), hash_(at.bitwiseXOR(1)).alias("peer_hash"), (odd == 1).alias("peer_at_left"))

    twig = F.col("twig")
    steps = [step("left", lv, f"h{lv}", shift(lv), twig * (4096 >> lv) + shift(lv), null_left(lv)) for lv in range(11)]
    steps += [step("right", lv, f"b{lv}", shift(lv), twig * (4096 >> lv) + (2048 >> lv) + shift(lv), null_bits(lv)) for lv in range(8, 11)]
    roots = [F.coalesce(F.get(F.col(c), F.lit(0)), F.lit(null)).alias(name) for c, name, null in (("h11", "self_hash", null_left(11)), ("b11", "peer_hash", null_bits(11)))]
    steps.append(F.struct(F.lit("upper").alias("part"), F.lit(11).alias("level"), (twig * 2).alias("nth"), *roots, F.lit(False).alias("peer_at_left")))
    return F.array(*steps).cast(f"array<{_STEP}>")


def proof_paths(sns: DataFrame, twigs: DataFrame, upper: DataFrame, roots: DataFrame) -> DataFrame:
    """``(shard_id, sn, steps)``: the proof of each ``(shard_id, sn)`` as an array of steps.

    Part ``left`` holds levels 0 to 10 from the leaf, ``right`` levels 8 to 10 from its page of liveness bits, ``upper`` level 11 and up to
    below the root in ``roots(shard_id, level)``. Serial numbers beyond the log are unused leaves, which can be proven too.
    ``twigs`` and ``upper`` are those of :func:`~statelog.operators.merkle.tree`. The asked numbers of a twig, 2048 at most, meet its one row,
    where both hashes of every step lie; the steps above are the same for all of them and are found once a twig.
    """
    asked = sns.groupBy("shard_id", F.shiftright("sn", 11).alias("twig")).agg(F.collect_set(F.col("sn").bitwiseAND(2047).cast("int")).alias("places"))
    asked = asked.join(F.broadcast(roots.select("shard_id", F.col("level").alias("top"))), "shard_id")  # a row a shard
    levels = F.when(F.col("top") > 12, F.sequence(F.lit(12), F.col("top") - 1)).otherwise(F.array().cast("array<int>"))
    above = asked.select("shard_id", "twig", F.explode(levels).alias("level")).withColumn("nth", F.expr("shiftright(twig, level - 12)"))
    above = above.withColumn("parent", F.shiftright("nth", 1))
    side = lambda k: F.max(F.when(F.col("nth").bitwiseAND(1) == k, F.col("hash")))
    pairs = upper.groupBy("shard_id", "level", F.shiftright("nth", 1).alias("parent")).agg(side(0).alias("l"), side(1).alias("r"))
    met = above.join(pairs, ["shard_id", "level", "parent"], "left")
    null, odd = null_hash(F.col("level"), F.col("nth")), F.col("nth").bitwiseAND(1) == 1
    left, right = F.coalesce("l", null), F.coalesce("r", null)
    step = F.struct(F.lit("upper").alias("part"), F.col("level").cast("int").alias("level"), "nth", F.when(odd, right).otherwise(left).alias("self_hash"), F.when(odd, left).otherwise(right).alias("peer_hash"), odd.alias("peer_at_left"))
    ups = met.groupBy("shard_id", "twig").agg(F.array_sort(F.collect_list(step)).alias("ups"))  # at most as many as the tree has levels
    j = asked.select("shard_id", "twig", "places").join(ups, ["shard_id", "twig"], "left").join(twigs, ["shard_id", "twig"], "left")
    ups = F.coalesce("ups", F.array().cast(f"array<{_STEP}>"))
    of = F.transform("places", lambda s: F.struct((F.col("twig") * 2048 + s).alias("sn"), F.concat(_twig_steps(s), ups).alias("steps")))
    return j.select("shard_id", F.explode(of).alias("p")).select("shard_id", "p.sn", "p.steps")


def proof_rows(paths: DataFrame) -> DataFrame:
    """:func:`proof_paths` with a row a step."""
    return paths.select("shard_id", "sn", F.explode("steps").alias("s")).select("shard_id", "sn", "s.*")


def _fold(steps: Column, start: Column) -> Column:
    def step(acc: Column, s: Column) -> Column:
        pair = F.when(s["peer_at_left"], F.concat(s["peer_hash"], acc)).otherwise(F.concat(acc, s["peer_hash"]))
        return F.unhex(F.sha2(F.concat(byte(s["level"]), pair), 256))

    return F.aggregate(steps, start, step)


def _part(name: str) -> Column:
    return F.filter("steps", lambda s: s["part"] == name)


def check_proofs(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """``(shard_id, sn, valid)``: whether leaf and liveness page lead to the shard's root and to each other's half of the twig."""
    g = paths.withColumn("l", _part("left")).withColumn("r", _part("right")).withColumn("u", _part("upper"))
    g = g.withColumn("left_root", _fold(F.col("l"), F.get("l", F.lit(0))["self_hash"])).withColumn("bits_root", _fold(F.col("r"), F.get("r", F.lit(0))["self_hash"]))
    g = g.withColumn("found_root", _fold(F.col("u"), F.col("left_root")))
    fits = (F.col("left_root") == F.get("u", F.lit(0))["self_hash"]) & (F.col("bits_root") == F.get("u", F.lit(0))["peer_hash"])
    return g.join(F.broadcast(roots.select("shard_id", "root_hash")), "shard_id").select("shard_id", "sn", (fits & (F.col("found_root") == F.col("root_hash"))).alias("valid"))


def encode_proofs(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """``(shard_id, proof)``: serial number (8 bytes, least first), leaf hash, peers of the left part, page, peers of the right and upper part, root.

    Sides follow from the bits of the serial number, so they aren't stored.
    """
    joined = lambda a: F.aggregate(a, F.unhex(F.lit("")), lambda acc, s: F.concat(acc, s["peer_hash"]))
    upper = F.filter("steps", lambda s: (s["part"] == "upper") & (s["level"] > 11))
    body = F.concat(le8(F.col("sn")), F.get(_part("left"), F.lit(0))["self_hash"], joined(_part("left")), F.get(_part("right"), F.lit(0))["self_hash"], joined(_part("right")), joined(upper), F.col("root_hash"))
    return paths.join(F.broadcast(roots.select("shard_id", "root_hash")), "shard_id").select("shard_id", body.alias("proof"))


def decode_proofs(encoded: DataFrame) -> DataFrame:
    """``(shard_id, sn, valid)`` of proofs of :func:`encode_proofs`, recomputed from their bytes alone."""
    p = F.col("proof")
    h = lambda i: F.substring(p, F.lit(9) + F.lit(32) * i, F.lit(32))
    n = ((F.length("proof") - 8) / 32).cast("int")
    encoded = encoded.withColumn("sn", from_le8(F.substring(p, 1, 8)))
    sn = F.col("sn")
    side = lambda shift: sn.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), shift)) != 0
    steps = lambda first, count, level, bit: F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((F.lit(level) + i).alias("level"), h(F.lit(first) + i).alias("peer_hash"), side(F.lit(bit) + i).alias("peer_at_left")))
    d = encoded.withColumn("left_root", _fold(steps(1, F.lit(11), 0, 0), h(F.lit(0)))).withColumn("bits_root", _fold(steps(13, F.lit(3), 8, 8), h(F.lit(12))))
    twig = F.unhex(F.sha2(F.concat(byte(F.lit(11)), F.col("left_root"), F.col("bits_root")), 256))
    d = d.withColumn("n", n).withColumn("twig_root", twig)
    root = F.when(F.col("n") == 17, F.col("twig_root")).otherwise(_fold(F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 18, F.lit(0))), lambda i: F.struct((F.lit(12) + i).alias("level"), h(F.lit(16) + i).alias("peer_hash"), side(F.lit(11) + i).alias("peer_at_left"))), F.col("twig_root")))
    return d.select("shard_id", "sn", (root == h(F.col("n") - 1)).alias("valid"))


def witness_positions(sns: DataFrame, roots: DataFrame) -> DataFrame:
    """``(shard_id, level, nth, given)``: nodes that prove all of ``(shard_id, sn)`` at once.

    ``given`` marks the leaves and liveness pages themselves; the others are the siblings on their paths that the paths don't yield.
    """
    at = sns.select("shard_id", "sn").distinct().join(F.broadcast(roots.select("shard_id", F.col("level").alias("top"))), "shard_id")
    leaf = sn_to_leaf(F.col("sn"))
    page = F.shiftleft(F.shiftright("sn", 11), 4) + 8 + F.shiftright("sn", 8).bitwiseAND(7)
    up = lambda nth, level0: F.transform(F.sequence(F.lit(level0), F.col("top") - 1), lambda lv: F.struct(lv.cast("int").alias("level"), F.call_function("shiftright", nth, lv - level0).alias("nth"), (lv == level0).alias("given")))
    own = at.select("shard_id", F.explode(F.concat(up(leaf, 0), up(page, 8))).alias("p")).select("shard_id", "p.*")
    own = cut(own.groupBy("shard_id", "level", "nth").agg(F.max("given").alias("given")))
    peers = own.select("shard_id", "level", F.col("nth").bitwiseXOR(1).alias("nth")).distinct().join(own, ["shard_id", "level", "nth"], "left_anti")
    return own.where("given").unionByName(peers.withColumn("given", F.lit(False)))


def witness(sns: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """:func:`witness_positions` with ``hash`` and ``place``, the order in which a verifier takes them: ``nth`` times 2 ** level."""
    w = _with_hash(witness_positions(sns, roots), nodes, "nth", "hash")
    return w.withColumn("place", F.call_function("shiftleft", F.col("nth"), F.col("level")))


_NULL, _HASH, _ENTRY = 0, 1, 2


def witness_bytes(w: DataFrame, entries: DataFrame) -> DataFrame:
    """``(shard_id, place, bytes)``: each node of a witness serialised; a shard's witness is its rows' bytes in the order of ``place``.

    Level (1 byte), nth (8, most significant first) and kind (1): 0 for a null node, 1 with its hash, 2 with the place (8 bytes) of the
    entry in ``entries(shard_id, sn)`` whose leaf it is, counted from 0 by serial number. A row a node, so a witness of any length
    is spread over partitions.
    """
    listed = entries.select("shard_id", "sn").distinct().withColumn("one", F.lit(1).cast("long"))
    listed = ranged_sums(listed, ["shard_id"], ["sn"], {"one": "entry"}).select("shard_id", F.lit(0).alias("level"), sn_to_leaf(F.col("sn")).alias("nth"), "entry")
    j = w.join(listed, ["shard_id", "level", "nth"], "left")
    is_null = F.col("hash") == null_hash(F.col("level"), F.col("nth"))
    kind = F.when(is_null, _NULL).when(F.col("entry").isNotNull(), _ENTRY).otherwise(_HASH)
    content = F.when(kind == _NULL, F.unhex(F.lit(""))).when(kind == _ENTRY, be8(F.col("entry"))).otherwise(F.col("hash"))
    return j.select("shard_id", "place", F.concat(byte(F.col("level")), be8(F.col("nth")), byte(kind), content).alias("bytes"))


def read_witness(encoded: DataFrame, entries: DataFrame) -> DataFrame:
    """``(shard_id, level, nth, hash)`` of rows of :func:`witness_bytes`; ``entries(shard_id, sn, leaf)`` gives the hashes of listed entries.

    A row of an unknown kind or with an entry that isn't listed has a null hash, which no verification accepts.
    """
    b = F.col("bytes")
    number = lambda at, n: F.conv(F.hex(F.substring(b, at, n)), 16, 10).cast("long")
    w = encoded.select("shard_id", number(1, 1).cast("int").alias("level"), number(2, 8).alias("nth"), number(10, 1).alias("kind"), F.substring(b, 11, 32).alias("content"))
    listed = entries.select("shard_id", "sn", "leaf").dropDuplicates(["shard_id", "sn"]).withColumn("one", F.lit(1).cast("long"))
    listed = ranged_sums(listed, ["shard_id"], ["sn"], {"one": "entry"}).select("shard_id", be8(F.col("entry")).alias("content"), F.lit(_ENTRY).cast("long").alias("kind"), "leaf")
    j = w.join(listed, ["shard_id", "kind", "content"], "left")
    hash_ = F.when(F.col("kind") == _NULL, null_hash(F.col("level"), F.col("nth"))).when(F.col("kind") == _ENTRY, F.col("leaf")).when(F.col("kind") == _HASH, F.col("content"))
    return j.select("shard_id", "level", "nth", hash_.alias("hash"))


def verify_witness(w: DataFrame, roots: DataFrame) -> DataFrame:
    """``(shard_id, valid)``: whether a witness ``(shard_id, level, nth, hash)`` leads to the shard's root and to no other node.

    Level by level from below; at most as many rounds as the tree has levels.
    """
    top = roots.agg(F.max("level")).first()[0] or 12
    w = w.select("shard_id", "level", "nth", "hash")
    now = None
    for level in range(int(top)):
        here = w.where(F.col("level") == level).select("shard_id", "nth", "hash")
        now = here if now is None else now.unionByName(here)
        pair = lambda s: F.max(F.when(F.col("nth").bitwiseAND(1) == s, F.col("hash")))
        # a shard whose root lies at this level keeps it
        tops = F.broadcast(roots.select("shard_id", F.col("level").alias("top")))
        split = now.join(tops, "shard_id")
        done = split.where(F.col("top") <= level).select("shard_id", "nth", "hash")
        up = split.where(F.col("top") > level).groupBy("shard_id", F.shiftright("nth", 1).alias("nth")).agg(pair(0).alias("l"), pair(1).alias("r"))
        now = done.unionByName(up.select("shard_id", "nth", F.unhex(F.sha2(F.concat(F.unhex(F.lit(f"{level:02x}")), F.col("l"), F.col("r")), 256)).alias("hash")))
        if level % 4 == 3:
            now = cut(now)
    ends = now.groupBy("shard_id").agg(F.count("*").alias("n"), F.max("nth").alias("nth"), F.max("hash").alias("hash"))
    ok = (F.col("n") == 1) & (F.col("nth") == 0) & F.col("hash").eqNullSafe(F.col("root_hash"))
    return ends.join(roots, "shard_id").select("shard_id", ok.alias("valid"))


def changed_sns(old_bits: DataFrame, new_bits: DataFrame) -> DataFrame:
    """``(shard_id, sn, active)``: entries whose liveness differs between two sets of ``(shard_id, twig, bits)``."""
    zeros = F.unhex(F.lit("00" * 256))
    j = old_bits.select("shard_id", "twig", F.col("bits").alias("old")).join(new_bits.select("shard_id", "twig", F.col("bits").alias("new")), ["shard_id", "twig"], "full")
    j = j.select("shard_id", "twig", F.coalesce("old", zeros).alias("old"), F.coalesce("new", zeros).alias("new")).where("old <> new")
    b = j.select("shard_id", "twig", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("i"), "old", "new")
    at = lambda c: F.conv(F.hex(F.substring(F.col(c), F.col("i") + 1, F.lit(1))), 16, 10).cast("int")
    b = b.select("shard_id", "twig", "i", at("old").alias("o"), at("new").alias("n")).where("o <> n")
    bit = b.select("shard_id", "twig", "i", "o", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    is_set = lambda c: F.call_function("shiftright", F.col(c), F.col("k")).bitwiseAND(1)
    return bit.where(is_set("o") != is_set("n")).select("shard_id", (F.col("twig") * 2048 + F.col("i") * 8 + F.col("k")).alias("sn"), (is_set("n") == 1).alias("active"))


def block_entries(old: DataFrame, active: DataFrame, effects: DataFrame) -> DataFrame:
    """``(shard_id, sn, part)``: numbers a block may append, entries that its compaction would move, and those whose liveness it looks at.

    ``old`` is the log before the block, ``active`` its live entries, ``effects(shard_id, effect)`` the block's operations without effectless ones.
    CREATE appends one entry and lets two move, WRITE one and one, DELETE one and none; ``appended`` counts moved entries too. ``compacted``
    are the oldest live entries, ``bits`` all from the first of them to the one before the last. Places among live entries are running sums.
    """
    n = lambda e: F.sum((F.col("effect") == e).cast("long"))
    counts = effects.groupBy("shard_id").agg(F.count("*").alias("changes"), (n("create") * 2 + n("write")).alias("moves"))
    counts = cut(counts.join(old.groupBy("shard_id").agg((F.max("sn") + 1).alias("end")), "shard_id"))
    small = F.broadcast(counts)  # a row a shard
    appended = counts.select("shard_id", F.explode(F.sequence("end", F.col("end") + F.col("changes") + F.col("moves") - 1)).alias("sn"), F.lit("appended").alias("part"))
    placed = ranged_sums(active.select("shard_id", "sn", F.lit(1).cast("long").alias("one")), ["shard_id"], ["sn"], {"one": "place"})
    moved = cut(placed.join(small, "shard_id").where(F.col("place") < F.col("moves")).select("shard_id", "sn"))
    span = moved.groupBy("shard_id").agg(F.min("sn").alias("a"), F.max("sn").alias("b")).where("a < b")
    bits = span.select("shard_id", F.explode(F.sequence("a", F.col("b") - 1)).alias("sn"), F.lit("bits").alias("part"))
    return appended.unionByName(moved.withColumn("part", F.lit("compacted"))).unionByName(bits)


def verify_entries(claimed: DataFrame, log: DataFrame, active: DataFrame) -> DataFrame:
    """``claimed(shard_id, sn, leaf, live)`` with ``valid``: whether leaf hash and liveness are those of the log."""
    real = leaf_hashes(log).withColumnRenamed("leaf", "real_leaf")
    live = active.select("shard_id", "sn", F.lit(True).alias("real_live"))
    j = claimed.join(real, ["shard_id", "sn"], "left").join(live, ["shard_id", "sn"], "left")
    same = F.coalesce("real_leaf", F.lit(null_left(0))).eqNullSafe(F.col("leaf")) & (F.coalesce("real_live", F.lit(False)) == F.col("live"))
    return j.select("shard_id", "sn", same.alias("valid"))
