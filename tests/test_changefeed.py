"""Change feeds in any order against a plain dictionary; publishing; the state store; streams."""

import random

import pytest
from pyspark.sql import functions as F

from statelog.operators.changefeed import _pointer, apply_changes, live, publish, read_published, upsert
from statelog.sources.store import StateStore
from statelog.streaming.blocks import ordered_by_shard, stream_blocks, stream_serial_bundles, stream_state

SCHEMA = "height bigint, task_idx int, cset_idx int, op_seq int, op_type int, key binary, value binary, version bigint"


def feed(n=800, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        h, t = 1 + i // 40, i % 40 // 4
        kind = rng.choice([1, 2, 2, 3, 4])
        key = rng.choice([b"hot", b"hot", *[bytes([b]) for b in range(20)]])
        rows.append((h, t, 0, i % 4, kind, key, None if kind == 4 else bytes([rng.randrange(256)]), None if rng.random() < 0.3 else h << 24 | t))
    return rows


def model(rows):
    state = {}
    for h, t, _, s, kind, key, value, _ in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        if kind in (2, 3, 4):
            state[key] = (h << 24 | t, s, kind, value)
    return state


def as_dict(df):
    return {bytes(r.key): (r.version, r.op_seq, r.op_type, None if r.value is None else bytes(r.value)) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_late_and_repeated_changes(spark, seed):
    rows = feed(seed=seed)
    dirty = rows + rows[::3] + [(1, 0, 0, 0, 2, None, b"x", 1), (1, 0, 0, None, 2, b"k", b"x", 1), (1, 0, 0, 0, None, b"k", b"x", 1), (None, None, 0, 0, 2, b"k", b"x", None)]
    random.Random(seed).shuffle(dirty)
    df = spark.createDataFrame(dirty, SCHEMA).withColumn("batch", F.lit(1)).withColumn("state", F.lit(2)).repartition(5)
    state = apply_changes(df, 3)
    assert as_dict(state) == model(rows)
    assert as_dict(live(state)) == {k: v for k, v in model(rows).items() if v[2] != 4}
    assert apply_changes(df.where("false")).collect() == []


def test_upsert_writes_touched_buckets_only(spark, tmp_path):
    rows, folder = feed(seed=4), f"file://{tmp_path}/u"
    df = spark.createDataFrame(rows, SCHEMA)
    assert upsert(df.where("false"), folder, 8).collect() == []
    for part in ("height <= 12", "height > 12", "height > 12"):
        upsert(df.where(part), folder, 8)
    assert as_dict(read_published(spark, folder)) == model(rows)
    was = _pointer(spark, folder)["now"]
    late = [(99, 0, 0, 0, 2, b"hot", b"new", None), (1, 0, 0, 0, 4, bytes([3]), None, None)]
    assert as_dict(upsert(spark.createDataFrame(late, SCHEMA), folder)) == model(rows + late)
    now = _pointer(spark, folder)["now"]
    assert 1 <= sum(was[b] != now[b] for b in now) <= 2 and set(was) == set(now)
    kept = {g.split("/")[0] for g in [*was.values(), *now.values()]}
    assert {p.name for p in (tmp_path / "u").iterdir() if p.name.startswith("gen-")} == kept
    publish(apply_changes(df.where("height <= 12")), f"{folder}2")  # a table written as a whole is parted
    assert as_dict(upsert(df.where("height > 12"), f"{folder}2", 4)) == model(rows)


def test_ties_do_not_depend_on_arrival(spark):
    """Changes with equal place and kind: the greatest value stands, a null one least, in whatever order and split they come."""
    rows = [(1, 0, 0, 0, 2, b"k", v, 1 << 24) for v in (b"a", b"z", None, b"", b"m")] + [(1, 0, 0, 0, 2, b"n", None, 1 << 24)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        for parts in (1, 5):
            got = as_dict(apply_changes(spark.createDataFrame(rows, SCHEMA).repartition(parts), 2))
            assert got == {b"k": (1 << 24, 0, 2, b"z"), b"n": (1 << 24, 0, 2, None)}


def test_a_cluster_must_name_its_shared_folder():
    from statelog import runtime

    class Context:
        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}

        def __init__(self, master):
            self.sparkContext = Context(master)

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]", "k8s://https://host"):
        with pytest.raises(RuntimeError):
            runtime.shared_dir(Session(master))


def test_publish_replaces_in_one_step(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    assert read_published(spark, folder) is None
    for n in (1, 2, 3):
        publish(spark.range(n), folder)
        assert read_published(spark, folder).count() == n
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("gen-")]) == 2


def test_store_commits_rolls_back_and_prunes(spark, tmp_path):
    rows = [r[:7] + (r[0] << 24 | r[1],) for r in feed(160)]
    store = StateStore(spark, f"file://{tmp_path}/s")
    assert store.height == -1 and store.live().count() == 0
    for h in (1, 2, 3, 4):
        block = spark.createDataFrame([r for r in rows if r[0] == h], SCHEMA)
        store.commit(block, h)
        store.commit(block, h)  # a repeated batch
        assert store.height == h
    want = lambda h: {k: v[:2] for k, v in model([r for r in rows if r[0] <= h]).items() if v[2] != 4}
    got = lambda: {bytes(r.key): (r.version, r.op_seq) for r in store.live().collect()}
    assert got() == want(4)
    store.truncate(2)
    assert store.height == 2 and got() == want(2)
    store.prune(2)
    assert store.ops().select("height").distinct().count() == 1 and got() == want(2)


def test_stream_of_files(spark, tmp_path):
    rows = feed(400)
    df = spark.createDataFrame(rows, SCHEMA)
    source = f"{tmp_path}/in"
    for k in range(3):  # late and repeated rows across files
        df.where((F.pmod(F.xxhash64("height", "task_idx", "op_seq"), F.lit(3)) == k) | (F.col("op_seq") == k)).coalesce(1).write.mode("append").parquet(source)
    state = stream_state(spark, source, df.schema, f"file://{tmp_path}/out", f"{tmp_path}/cp", files_a_batch=1)
    assert as_dict(state) == model(rows)
    again = stream_state(spark, source, df.schema, f"file://{tmp_path}/out", f"{tmp_path}/cp")
    assert as_dict(again) == model(rows)


def test_stream_of_blocks(spark, tmp_path):
    rows = feed(120)
    df = spark.createDataFrame(rows, SCHEMA)
    for h in (1, 2, 3):
        df.where(F.col("height") == h).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = StateStore(spark, f"file://{tmp_path}/s")
    stream_blocks(spark, f"{tmp_path}/in", df.schema, store, f"{tmp_path}/cp")
    assert store.height == 3
    assert {bytes(r.key): (r.version, r.op_seq) for r in store.live().collect()} == {k: v[:2] for k, v in model(rows).items() if v[2] != 4}


def test_ordered_by_shard(spark, tmp_path):
    schema = "shard_id int, serial_number bigint, key binary, version bigint, op_seq int, op_type int"
    parts = [[(0, 2, b"c", 3, 0, 2), (0, 0, b"a", 1, 0, 2), (1, 1, b"y", 2, 0, 2)], [(0, 1, b"b", 2, 0, 2), (0, 0, b"a", 1, 0, 2), (None, 0, b"n", 1, 0, 2)], [(1, 0, b"x", 1, 0, 2), (0, 4, b"e", 5, 0, 2)]]
    for k, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = ordered_by_shard(stream).writeStream.format("memory").queryName("released").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.shard_id, r.released, bytes(r.key)) for r in spark.table("released").collect())
    assert got == [(0, 0, b"a"), (0, 1, b"b"), (0, 2, b"c"), (1, 0, b"x"), (1, 1, b"y")]  # 4 waits for 3


def test_stream_serial_bundles(spark, tmp_path):
    schema = "height bigint, tx_idx int, r array<binary>, w array<binary>"
    blocks = [[(1, 0, [b"a"], [b"b"]), (1, 1, [b"a"], [b"c"])], [(2, 0, [b"c"], []), (2, 1, [], [b"d"]), (2, 2, [], [b"d"])]]
    for k, p in enumerate(blocks):
        spark.createDataFrame(p, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = stream_serial_bundles(stream).writeStream.format("memory").queryName("bundles").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("bundles").collect())) == [(0, 2), (1, 2)]
