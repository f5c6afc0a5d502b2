"""Cutting ordered transactions into bundles that can run side by side.

Bundling in order needs only each transaction's last earlier collision, which is found in parallel; what is left of the
sequential rule is one pass over two numbers a transaction. Reordering into several open bundles depends on all of their sets,
so it is one ordered stream a configuration; the executor's variant starts afresh each block, so its blocks run side by side.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelog.config import BLOOM_BITS, BLOOM_FUNCS, BUNDLE_MAX, BUNDLE_MIN, BUNDLES, EARLY_WINDOW, SET_MAX
from statelog.runtime import broadcast_if_small, cut

_SHIFT = BLOOM_BITS.bit_length() - 1


def _exits(first: int, last: np.ndarray) -> tuple[list[int], list[int]]:
    """What a stretch of transactions ``first .. first + len(last) - 1`` makes of the bundle that is open before it: ``(limits, leaves)``.

    The first cut is at the first transaction whose last collision isn't before the incoming bundle's start, and from a cut on all that
    follows is the same whatever came in. So only the running maxima of the collisions matter: a bundle that started at or before
    ``limits[k]``, and after the limit before it, leaves as the one that starts at ``leaves[k]``; a later one goes on.
    """
    if not len(last):
        return [], []
    upto = np.maximum.accumulate(last)
    rises = np.flatnonzero(np.r_[True, upto[1:] > upto[:-1]])
    inner = np.flatnonzero(last >= first)
    stop = int(inner[0]) if len(inner) else len(last)
    entries = [int(i) for i in rises if i < stop] + ([stop] if stop < len(last) else [])
    leaves, left_by = [], {}
    hits = last.tolist()
    for e in reversed(entries):  # later entries first: an earlier one mostly falls in with their cuts
        start, mine, end = first + e, [], None
        for i in range(e, len(hits)):
            if i == e or hits[i] >= start:
                start = first + i
                end = left_by.get(start)
                if end is not None:
                    break
                mine.append(start)
        end = start if end is None else end
        left_by.update(dict.fromkeys(mine, end))
        leaves.append(end)
    return [hits[e] for e in entries], leaves[::-1]


def serial_starts(last: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(start, n_txs)`` of the bundles in order, from ``last(pos, last)`` of :func:`~statelog.operators.access.last_collision`.

    A bundle ends before the first transaction that collides with one of it. The rule is sequential, but a stretch of transactions
    maps the bundle that is open before it to the one that is open after it, and that map has few steps. So range partitions work out
    their maps side by side, the maps are chained (a few rows a partition), and the partitions then give out their bundles side by
    side. ``pos`` counts from 0 without gaps. No transactions give no bundles.
    """

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        pos, hit = _columns(batches)
        cols = {"part": np.full(len(pos), part), "pos": pos, "last": hit, "limit": np.full(len(pos), -2), "leaves": np.full(len(pos), -2)}
        if len(pos):
            limits, leaves = _exits(int(pos[0]), hit)
            cols["limit"][: len(limits)], cols["leaves"][: len(leaves)] = limits, leaves
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in cols.values()], list(cols))

    rows = cut(last.select("pos", "last").repartitionByRange(*([partitions] if partitions else []), "pos").sortWithinPartitions("pos").mapInArrow(maps, "part bigint, pos bigint, last bigint, limit bigint, leaves bigint"))
    firsts = rows.groupBy("part").agg(F.min("pos").alias("first"), F.sort_array(F.collect_list(F.when(F.col("leaves") >= 0, F.struct("limit", "leaves")))).alias("steps"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for b in batches:
            parts, opens = [], []
            for part, first, steps in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts.append(part)
                opens.append(-1 if open_ is None else open_)
                open_ = first if open_ is None else open_
                open_ = next((s["leaves"] for s in steps if s["limit"] >= open_), open_)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(opens, pa.int64())], ["part", "incoming"])

    incoming = firsts.repartition(1).sortWithinPartitions("part").mapInArrow(chain, "part bigint, incoming bigint")  # a row a partition

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = None, 0
        for b in batches:
            starts, counts = [], []
            for p, pos, hit, came in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    part, start = p, pos if came < 0 else came
                    starts.append(start)
                    counts.append(0)
                if hit >= start:
                    start = pos
                if not starts or starts[-1] != start:
                    starts.append(start)
                    counts.append(0)
                counts[-1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], ["start", "n"])

    placed = rows.select("part", "pos", "last").join(broadcast_if_small(incoming), "part").select("part", "pos", "last", "incoming")
    inside = placed.repartition("part").sortWithinPartitions("part", "pos").mapInArrow(give, "start bigint, n bigint")
    return inside.groupBy("start").agg(F.sum("n").cast("long").alias("n_txs")).where("n_txs > 0")  # a bundle that runs over partitions has a row in each


def _columns(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    none = np.array([], np.int64)
    return (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])) if got else (none, none)


def tlp(bundles: DataFrame) -> DataFrame:
    """Transactions, bundles and transactions a bundle (null without bundles), in one row."""
    return bundles.agg(F.coalesce(F.sum("n_txs"), F.lit(0)).cast("long").alias("n_txs"), F.count("*").alias("n_bundles")).select("n_txs", "n_bundles", F.round(F.try_divide("n_txs", "n_bundles"), 6).alias("tlp"))


class BloomLanes:
    """Which of the open bundles hold a hash, by parallel Bloom filters: one word a position, one bit a bundle. Hashes are their first eight bytes."""

    #: Hashes whose positions are remembered.
    CACHE = 500_000

    def __init__(self, lanes: int):
        self.reads, self.writes = [0] * BLOOM_BITS, [0] * BLOOM_BITS
        self.own: list[tuple[set, set, list]] = [(set(), set(), [0, 0]) for _ in range(lanes)]
        self.known: dict[bytes, tuple[int, ...]] = {}

    def places(self, hashes: Iterable[bytes]) -> list[tuple[int, ...]]:
        known, out = self.known, []
        if len(known) > self.CACHE:
            known.clear()
        for h in hashes:
            p = known.get(h)
            if p is None:
                k = int.from_bytes(h[:8], "big")
                p = known[h] = tuple(k >> _SHIFT * j & (BLOOM_BITS - 1) for j in range(BLOOM_FUNCS))
            out.append(p)
        return out

    def collides(self, r: Iterable, w: Iterable) -> int:
        mask, reads, writes = 0, self.reads, self.writes
        for a, b, c, d, e in self.places(r):
            mask |= writes[a] & writes[b] & writes[c] & writes[d] & writes[e]
        for a, b, c, d, e in self.places(w):
            mask |= (writes[a] & writes[b] & writes[c] & writes[d] & writes[e]) | (reads[a] & reads[b] & reads[c] & reads[d] & reads[e])
        return mask

    def add(self, i: int, r: Iterable, w: Iterable) -> None:
        bit, own = 1 << i, self.own[i]
        for k, (table, hashes) in enumerate(((self.reads, r), (self.writes, w))):
            for places in self.places(hashes):
                own[2][k] += 1
                own[k].update(places)
                for p in places:
                    table[p] |= bit

    def clear(self, i: int) -> None:
        keep = ~(1 << i)
        for k, table in enumerate((self.reads, self.writes)):
            for p in self.own[i][k]:
                table[p] &= keep
        self.own[i] = (set(), set(), [0, 0])

    def sizes(self, i: int) -> tuple[int, int]:
        return tuple(self.own[i][2])


class _Rows:
    """A batch's table rows by transaction: what to look at, ``look``, and what to set, ``put``, in one array each with offsets."""

    def __init__(self, look: list[tuple[np.ndarray, np.ndarray]], put: list[tuple[np.ndarray, np.ndarray]], n: int):
        self.look, self.look_at = self._by_tx(look, n)
        self.put, self.put_at = self._by_tx(put, n)

    @staticmethod
    def _by_tx(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, list[int]]:
        rows, tx = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return rows[np.argsort(tx, kind="stable")], np.r_[0, np.cumsum(np.bincount(tx, minlength=n))].tolist()


class _Lanes:
    """Which of up to 128 open bundles hold what: tables of bit masks in words of 64 lanes, rows for reads first and for writes after.

    ``exact`` lanes number the hashes of a batch and of the open bundles anew with each batch, so the tables don't grow with the stream.
    Bloom lanes have BLOOM_BITS rows each for reads and writes.
    """

    def __init__(self, lanes: int, bloom: bool):
        self.bloom = bloom
        self.words = -(-lanes // 64)
        self.tables = [np.zeros(2 * BLOOM_BITS if bloom else 0, np.uint64) for _ in range(self.words)]
        self.known = np.array([], np.int64)
        self.own: list[list[np.ndarray]] = [[] for _ in range(lanes)]

    def batch(self, r: tuple[np.ndarray, np.ndarray], w: tuple[np.ndarray, np.ndarray], n: int) -> _Rows:
        """Rows of a batch of hashes and the transactions they belong to."""
        if self.bloom:
            places = [(h.view(np.uint64)[:, None] >> (_SHIFT * np.arange(BLOOM_FUNCS)).astype(np.uint64) & np.uint64(BLOOM_BITS - 1)).astype(np.int64) for h, _ in (r, w)]
            look = [(places[0] + BLOOM_BITS, r[1]), (places[1] + BLOOM_BITS, w[1]), (places[1], w[1])]
            put = [(places[0].ravel(), np.repeat(r[1], BLOOM_FUNCS)), ((places[1] + BLOOM_BITS).ravel(), np.repeat(w[1], BLOOM_FUNCS))]
            return _Rows(look, put, n)
        size = len(self.known)
        held = [self.known[rows % size] for own in self.own for rows in own]
        known = np.unique(np.concatenate([r[0], w[0], *held]))
        to = np.searchsorted(known, self.known)  # of a hash that isn't held any more, anything
        m = len(known)
        self.tables = [np.zeros(2 * m, np.uint64) for _ in range(self.words)]
        for i, own in enumerate(self.own):
            self.own[i] = [to[rows % size] + (rows >= size) * m for rows in own]
            for rows in self.own[i]:
                self.tables[i // 64][rows] |= np.uint64(1 << i % 64)
        self.known = known
        a, b = np.searchsorted(known, r[0]), np.searchsorted(known, w[0])
        return _Rows([(a + m, r[1]), (b + m, w[1]), (b, w[1])], [(a, r[1]), (b + m, w[1])], n)

    def collides(self, rows: np.ndarray) -> int:
        mask = 0
        for k, t in enumerate(self.tables):
            hit = t[rows]
            if self.bloom:
                hit = np.bitwise_and.reduce(hit, axis=1)
            mask |= int(np.bitwise_or.reduce(hit)) << 64 * k
        return mask

    def add(self, i: int, rows: np.ndarray) -> None:
        self.tables[i // 64][rows] |= np.uint64(1 << i % 64)
        if not self.bloom:
            self.own[i].append(rows)

    def clear(self, i: int) -> None:
        t, keep = self.tables[i // 64], np.uint64(~(1 << i % 64) & 0xFFFFFFFFFFFFFFFF)
        if self.bloom:
            t &= keep
            return
        for rows in self.own[i]:
            t[rows] &= keep
        self.own[i] = []

    def distinct(self, i: int) -> int:
        """The greater of the numbers of distinct hashes that a bundle reads and writes."""
        rows = np.unique(np.concatenate(self.own[i]))
        reads = int(np.searchsorted(rows, len(self.known)))
        return max(reads, len(rows) - reads)


class Reorderer:
    """First-fit over N open bundles. ``fold`` gives the bundles that a batch of transactions closes, ``rest`` those at the end.

    ``give_up`` drops a transaction that collides with all bundles while the largest holds fewer than BUNDLE_MIN. With ``compat``, the
    transaction that opens a new bundle in the final merge is lost and the last bundle isn't counted. Hashes are their first eight bytes.
    """

    def __init__(self, lanes: int, bloom: bool = False, give_up: bool = False, compat: bool = False):
        self.lanes, self.give_up, self.compat = lanes, give_up, compat
        self.sets = _Lanes(lanes, bloom)
        #: Transactions of each open bundle: what it counts for, its reads and its writes.
        self.open: list[list] = [[] for _ in range(lanes)]
        self.held = [[0, 0] for _ in range(lanes)]
        self.dropped = 0

    def _close(self, i: int) -> list:
        done = [t[0] for t in self.open[i]]
        self.open[i], self.held[i] = [], [0, 0]
        self.sets.clear(i)
        return done

    def fold(self, txs: list, r: tuple[np.ndarray, np.ndarray], w: tuple[np.ndarray, np.ndarray]) -> list[list]:
        """Take transactions in order; ``r`` and ``w`` are hashes (64-bit) and the ends of each transaction's part of them."""
        ends = [r[1].tolist(), w[1].tolist()]
        tx_of = [np.repeat(np.arange(len(txs)), np.diff(e, prepend=0)) for e in (r[1], w[1])]
        rows = self.sets.batch((r[0], tx_of[0]), (w[0], tx_of[1]), len(txs))
        closed, sets, open_, held, full = [], self.sets, self.open, self.held, 1 << self.lanes
        r0 = w0 = 0
        for k, tx in enumerate(txs):
            r1, w1 = ends[0][k], ends[1][k]
            mask = sets.collides(rows.look[rows.look_at[k] : rows.look_at[k + 1]]) if r1 > r0 or w1 > w0 else 0
            free = ~mask & (mask + 1)
            if free < full:
                i = free.bit_length() - 1
            else:
                sizes = [len(b) for b in open_]
                size = max(sizes)
                if self.give_up and size < BUNDLE_MIN:
                    self.dropped += 1
                    r0, w0 = r1, w1
                    continue
                i = sizes.index(size)
                closed.append(self._close(i))
            sets.add(i, rows.put[rows.put_at[k] : rows.put_at[k + 1]])
            open_[i].append((tx, r[0][r0:r1], w[0][w0:w1]))
            mine = held[i]
            mine[0] += r1 - r0
            mine[1] += w1 - w0
            large = max(mine) > SET_MAX and (sets.bloom or sets.distinct(i) > SET_MAX)
            if large or len(open_[i]) >= BUNDLE_MAX:
                closed.append(self._close(i))
            r0, w0 = r1, w1
        for b in open_:  # what stays open must not hold on to the batch's arrays
            b[:] = [(tx, a.copy(), c.copy()) for tx, a, c in b]
        return closed

    def rest(self) -> list[list]:
        closed, now = [], []
        reads, writes = set(), set()
        for bundle in self.open:
            for tx, r, w in bundle:
                r, w = r.tolist(), w.tolist()
                if not writes.isdisjoint(r) or not writes.isdisjoint(w) or not reads.isdisjoint(w):
                    closed.append(now)
                    now, reads, writes = [], set(), set()
                    if self.compat:
                        continue
                now.append(tx)
                reads.update(r)
                writes.update(w)
        if now and not self.compat:
            closed.append(now)
        return closed


def hashes_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """First eight bytes of the hashes in a list column as 64-bit integers, and where each list ends."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    flat = pc.binary_slice(column.flatten(), 0, 8)
    if len(flat) and pc.min(pc.binary_length(flat)).as_py() < 8:
        return np.array([int.from_bytes(x.ljust(8, b"\0"), "big") for x in flat.to_pylist()], np.uint64).view(np.int64), ends
    data = np.frombuffer(b"".join(flat.to_pylist()), ">u8") if len(flat) else np.array([], ">u8")
    return data.astype(np.uint64).view(np.int64), ends


def reorder(sets: DataFrame, configs: list[tuple[int, bool]], give_up: bool = False, compat: bool = False) -> DataFrame:
    """``(lanes, bloom, bundle, n_txs)``: bundles of each configuration over transactions ``(pos, r, w)`` in order.

    Where ``sets`` has ``n_txs``, its rows are tasks of so many transactions; a bundle's bound of BUNDLE_MAX is one of tasks.

    Where a transaction goes depends on all bundles that are open, and so on all transactions before: each configuration is one ordered
    stream in a partition of its own that keeps its N open bundles only. Eight bytes a hash travel there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, lanes, bloom, bundle = None, 0, False, 0

        def rows(closed: list[list]) -> pa.RecordBatch:
            nonlocal bundle
            n = [sum(c) for c in closed]
            at = list(range(bundle, bundle + len(n)))
            bundle += len(n)
            return pa.RecordBatch.from_arrays([pa.array([lanes] * len(n), pa.int32()), pa.array([bloom] * len(n), pa.bool_()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["lanes", "bloom", "bundle", "n_txs"])

        for b in batches:
            if not b.num_rows:
                continue
            if r is None:
                lanes, bloom = configs[b.column(0)[0].as_py()]
                r = Reorderer(lanes, bloom, give_up, compat)
            yield rows(r.fold(b.column(2).to_pylist(), hashes_of(b.column(3)), hashes_of(b.column(4))))
        if r is not None:
            yield rows(r.rest())

    n_txs = F.col("n_txs") if "n_txs" in sets.columns else F.lit(1)
    short = lambda c: F.transform(c, lambda h: F.substring(h, 1, 8)).alias(c)
    stream = sets.select(F.explode(F.lit(list(range(len(configs))))).alias("config"), "pos", n_txs.cast("long").alias("n_txs"), short("r"), short("w"))
    stream = stream.repartitionById(len(configs), "config").sortWithinPartitions("pos")
    return stream.mapInArrow(run, "lanes int, bloom boolean, bundle bigint, n_txs bigint")


def reorder_tlp(bundles: DataFrame) -> DataFrame:
    """Transactions a bundle of each configuration."""
    g = bundles.groupBy("lanes", "bloom").agg(F.sum("n_txs").alias("n_txs"), F.count("*").alias("n_bundles"))
    return g.withColumn("tlp", F.round(F.try_divide("n_txs", "n_bundles"), 6))


def schedule_block(tasks: list[tuple], lanes: int = BUNDLES) -> tuple[list[tuple], list]:
    """Order of a block's tasks ``(idx, r, w)``: ``(out_idx, idx, bundle start, all-done index)`` of each, and the failed ones.

    A task that collides with all bundles closes the first with more than BUNDLE_MIN tasks, or fails if there is none. The last
    task stays in its bundle. The all-done index is the nearest earlier colliding task in the window before the bundle.
    """
    sets, open_, out, failed = BloomLanes(lanes), [[] for _ in range(lanes)], [], []

    def close(i: int) -> None:
        start = len(out)
        out.extend((start, t) for t in open_[i])
        open_[i] = []
        sets.clear(i)

    for k, task in enumerate(tasks):
        _, r, w = task
        mask = sets.collides(r, w)
        i = (~mask & (mask + 1)).bit_length() - 1
        if i >= lanes:
            i = next((j for j in range(lanes) if len(open_[j]) > BUNDLE_MIN), None)
            if i is None:
                failed.append(task[0])
                continue
            close(i)
        sets.add(i, r, w)
        open_[i].append(task)
        if k < len(tasks) - 1 and (max(sets.sizes(i)) > SET_MAX or len(open_[i]) >= BUNDLE_MAX):
            close(i)
    for i in range(lanes):
        close(i)
    placed = []
    for at, (start, (idx, r, w)) in enumerate(out):
        low = max(0, start - EARLY_WINDOW)
        ready = max(low - 1, 0)
        keys_r, keys_w = {h[:8] for h in r}, {h[:8] for h in w}
        for j in range(start - 1, low - 1, -1):
            _, (_, r2, w2) = out[j]
            other_w = {h[:8] for h in w2}
            if not other_w.isdisjoint(keys_r) or not other_w.isdisjoint(keys_w) or not keys_w.isdisjoint(h[:8] for h in r2):
                ready = j
                break
        placed.append((at, idx, start, ready))
    return placed, failed


def block_schedules(sets: DataFrame, lanes: int = BUNDLES) -> DataFrame:
    """``(height, out_idx, tx_idx, bundle_start, all_done_idx, failed)`` of each block's transactions ``(height, tx_idx, r, w)``.

    Failed tasks have nulls for their place. Blocks are independent and are scheduled one at a time inside range partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        height, tasks, out = None, [], []

        def finish() -> None:
            if tasks:
                placed, failed = schedule_block(tasks, lanes)
                out.extend((height, a, i, s, r, False) for a, i, s, r in placed)
                out.extend((height, None, i, None, None, True) for i in failed)

        def give() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds[i]) for i in range(6)], ["height", "out_idx", "tx_idx", "bundle_start", "all_done_idx", "failed"])

        for b in batches:
            for h, idx, r, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if h != height:
                    finish()
                    height, tasks = h, []
                tasks.append((idx, r, w))
            yield give()
            out = []
        finish()
        yield give()

    ordered = sets.select("height", "tx_idx", "r", "w").repartition("height").sortWithinPartitions("height", "tx_idx")
    return ordered.mapInArrow(run, "height bigint, out_idx int, tx_idx int, bundle_start int, all_done_idx int, failed boolean")


def waves(sets: DataFrame) -> DataFrame:
    """``(height, tx_idx, wave)``: in each block, the earliest round in which a transaction can run, after all it collides with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        height, read, written = None, {}, {}  # greatest wave that read or wrote a hash
        for b in batches:
            got = []
            for h, r, w in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if h != height:
                    height, read, written = h, {}, {}
                n = 1 + max([0, *(written.get(x, 0) for x in r), *(max(written.get(x, 0), read.get(x, 0)) for x in w)])
                for x in r:
                    read[x] = max(n, read.get(x, 0))
                for x in w:
                    written[x] = max(n, written.get(x, 0))
                got.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.int32())], ["height", "tx_idx", "wave"])

    ordered = sets.select("height", "tx_idx", "r", "w").repartition("height").sortWithinPartitions("height", "tx_idx")
    return ordered.mapInArrow(run, "height bigint, tx_idx int, wave int")
