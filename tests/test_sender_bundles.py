"""Bundles of sender tasks against plain Python."""

import random

from statelog.operators import access as A
from statelog.operators import bundling as B
from statelog.plans import dependency

SETS = "height bigint, tx_idx int, txid string, sender string, r array<binary>, w array<binary>"


def made():
    rng = random.Random(5)
    some = lambda n: [b"%d" % rng.randrange(40) for _ in range(rng.randrange(n))]
    return [(h, i, f"{h:02d}{i:02d}", rng.choice(["a", "a", "b", "c", "d", None]), sorted(set(some(3))), sorted(set(some(3)))) for h in range(1, 9) for i in range(30)]


def tasks_of(rows):
    out = []
    for h in sorted({r[0] for r in rows}):
        by = {}
        for x in rows:
            if x[0] == h:
                by.setdefault(x[3], []).append(x)
        for sender, xs in by.items():
            for k in range(0, len(xs), 3):
                part = xs[k : k + 3]
                out.append((h, sender, k // 3, len(part), {b for x in part for b in x[4]}, {b for x in part for b in x[5]}))
    return out


def bundles(tasks, lanes):
    open_, done = [[] for _ in range(lanes)], []
    hits = lambda a, b: a[4] & b[5] or a[5] & (b[4] | b[5])
    for t in tasks:
        i = next((k for k, b in enumerate(open_) if not any(hits(o, t) for o in b)), None)
        if i is None:
            i = max(range(lanes), key=lambda k: len(open_[k]))
            done.append(open_[i])
            open_[i] = []
        open_[i].append(t)
        if len(open_[i]) >= 64:
            done.append(open_[i])
            open_[i] = []
    now = []
    for t in (t for b in open_ for t in b):
        if any(hits(o, t) for o in now):
            done.append(now)
            now = []
        now.append(t)
    return [sum(t[3] for t in b) for b in [*done, now] if b]


def test_tasks_unite_sets_and_are_bundled(spark):
    rows = made()
    want = tasks_of(rows)
    got = A.task_sets(spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SETS))
    assert [(t.height, t.sender, t.task_no, t.n_txs, set(map(bytes, t.r)), set(map(bytes, t.w))) for t in got.orderBy("pos").collect()] == want
    made_of = B.reorder(got, [(4, False), (8, False)]).orderBy("bundle").collect()
    for lanes in (4, 8):
        n = [b.n_txs for b in made_of if b.lanes == lanes]
        assert n == bundles(want, lanes) and sum(n) == len(rows)


def test_query_is_registered():
    assert "reorder_tlp_tasks" in dependency.QUERIES
