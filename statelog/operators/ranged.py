"""Keyed results without a long task for a key that holds most rows.

Rows are range partitioned on (key, secondary order) at sampled quantiles, so a heavy key is spread over as many partitions
as its share of the rows asks for. Every partition reduces its sorted rows to one partial state for each key, and partial
states of a key that runs over a boundary are stitched together by a small second step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statelog.runtime import cut


def changed(a: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """True where a value differs from the one before it; null equals null. ``before`` precedes the first value."""
    n = len(a)
    out = np.ones(n, dtype=bool)
    if n > 1:
        x, y = a[1:], a[:-1]
        ne = pc.fill_null(pc.not_equal(x, y), True).to_numpy(zero_copy_only=False)
        both = pc.and_(pc.is_null(x), pc.is_null(y)).to_numpy(zero_copy_only=False)
        out[1:] = ne & ~both
    if before is not None:
        first = a[0]
        out[0] = first.is_valid != before.is_valid or (first.is_valid and first.as_py() != before.as_py())
    return out


def one_array(c: pa.ChunkedArray | pa.Array) -> pa.Array:
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


_STATE = "field string, key string, n_rows bigint, n_blocks bigint, first_height bigint, first_pos string, last_height bigint, last_pos string"


def _partition_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial states of a partition sorted by (field, key, height, pos): distinct (height, pos) and distinct heights of each key."""
    names = [f.split()[0] for f in _STATE.split(", ")]
    last = None  # last row seen: field, key, height, pos
    state = None
    for b in batches:
        if not b.num_rows:
            continue
        f, k, h, p = (one_array(b.column(i)) for i in range(4))
        new_key = changed(f, last and last[0]) | changed(k, last and last[1])
        new_block = new_key | changed(h, last and last[2])
        new_pos = new_block | changed(p, last and last[3])
        starts = np.flatnonzero(new_key)
        out = []
        bounds = [*starts.tolist(), b.num_rows]
        if bounds[0] > 0:  # the key of the batch before goes on
            n = bounds[0]
            state[2] += int(new_pos[:n].sum())
            state[3] += int(new_block[:n].sum())
            state[6], state[7] = h[n - 1].as_py(), p[n - 1].as_py()
        if len(starts):
            if state is not None:
                out.append(state)
            rows = np.add.reduceat(new_pos.astype(np.int64), starts)
            blocks = np.add.reduceat(new_block.astype(np.int64), starts)
            ends = np.array(bounds[1:]) - 1
            s, e = pa.array(starts), pa.array(ends)
            states = list(zip(f.take(s).to_pylist(), k.take(s).to_pylist(), rows.tolist(), blocks.tolist(), h.take(s).to_pylist(), p.take(s).to_pylist(), h.take(e).to_pylist(), p.take(e).to_pylist(), strict=True))
            out += states[:-1]
            state = list(states[-1])
        last = (f[-1], k[-1], h[-1], p[-1])
        if out:
            yield _states_batch(names, out)
    if state is not None:
        yield _states_batch(names, [state])


def _states_batch(names: list[str], rows: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(8)], names)


def key_activity(rows: DataFrame) -> DataFrame:
    """Results by key of ``rows(field, key, height, pos)``: transactions, blocks, first and last height.

    ``(height, pos)`` names a transaction; repeated rows count once. A null key is a key of its own. Rows without height or
    position name no transaction and are ignored; no rows give no result. Other columns are ignored.
    """
    rows = rows.select("field", "key", "height", "pos").where(F.col("height").isNotNull() & F.col("pos").isNotNull())
    order = ["field", "key", "height", "pos"]
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_partition_states, _STATE)
    before = Window.partitionBy("field", "key").orderBy("first_height", "first_pos")
    same_block = F.lag("last_height").over(before) == F.col("first_height")
    same_row = same_block & (F.lag("last_pos").over(before) == F.col("first_pos"))
    stitched = parts.select("*", F.coalesce(same_block, F.lit(False)).cast("long").alias("shared_block"), F.coalesce(same_row, F.lit(False)).cast("long").alias("shared_row"))
    return stitched.groupBy("field", "key").agg(
        (F.sum("n_rows") - F.sum("shared_row")).alias("n_txs"),
        (F.sum("n_blocks") - F.sum("shared_block")).alias("n_blocks"),
        F.min("first_height").alias("first_height"),
        F.max("last_height").alias("last_height"),
    )


def ranged_pass(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    lags: Sequence[str] = (),
    lasts: dict[str, list[str]] | None = None,
    sums: dict[str, str] | None = None,
    maxes: dict[str, str] | None = None,
) -> DataFrame:
    """``df`` with values of the rows before, within ``keys`` in ``order``, from one pass over range partitions.

    * ``lags``: ``prev_<v>`` of the row before, null for a key's first row.
    * ``lasts``: for each boolean column, ``last_<v>`` of the latest row before at which it is true, null without one.
    * ``sums``: column and result, the sum over the rows before; a null amount counts as 0.
    * ``maxes``: column and result, the greatest amount (0 to 2 ** 40) of the rows before, -1 without one; nulls don't count.

    As windows without their long task: rows are range partitioned on keys and order and written once, so every later read sees the same
    partitions. Only rows of a partition's first key can depend on other partitions; what the partitions before leave over for it
    is chained from two rows a partition. Result columns that ``df`` already has are replaced. ``order`` has no ties within ``keys``.
    """
    lasts, sums, maxes = lasts or {}, sums or {}, maxes or {}
    carried_of = [(w, v) for w, vs in lasts.items() for v in vs]
    groups = list(lasts)
    df = df.drop(*[f"prev_{v}" for v in lags], *[f"last_{v}" for _, v in carried_of], *sums.values(), *maxes.values())
    names = df.columns
    at, lag_at = [names.index(c) for c in keys], [names.index(v) for v in lags]
    flag_at = {w: names.index(w) for w in lasts}
    value_at = {w: [names.index(v) for v in vs] for w, vs in lasts.items()}
    amounts = [(names.index(a), out, False) for a, out in sums.items()] + [(names.index(a), out, True) for a, out in maxes.items()]
    outs = [*[f"prev_{v}" for v in lags], *[f"last_{v}" for _, v in carried_of], *[out for _, out, _ in amounts]]
    marks = ["_kind", "_part", "_open", *[f"_has{g}" for g in range(len(groups))]]
    like = [F.col(v).alias(f"prev_{v}") for v in lags] + [F.col(v).alias(f"last_{v}") for _, v in carried_of] + [F.lit(0).cast("long").alias(out) for _, out, _ in amounts]
    flags = [F.lit("row").alias("_kind"), F.lit(0).alias("_part"), F.lit(0).alias("_open"), *[F.lit(True).alias(m) for m in marks[3:]]]
    schema = df.select("*", *like, *flags).schema
    schema = type(schema)([type(f)(f.name, f.dataType, True) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before = types = None
        carried: list[list | None] = [None] * len(groups)
        totals = [-1 if largest else 0 for _, _, largest in amounts]
        first_key = True  # still in the partition's first key

        def mark(kind: str, row: list) -> pa.RecordBatch:
            cols = [pa.array([row[i].as_py() if i in at else None], t) for i, t in enumerate(types)]
            cols += [pa.array([row[i].as_py()], types[i]) for i in lag_at]
            for g, w in enumerate(groups):
                cols += [pa.array([None if carried[g] is None else carried[g][k].as_py()], types[i]) for k, i in enumerate(value_at[w])]
            cols += [pa.array([t], pa.int64()) for t in totals]
            cols += [pa.array([kind]), pa.array([part], pa.int32()), pa.array([int(first_key)], pa.int32()), *[pa.array([c is not None]) for c in carried]]
            return pa.RecordBatch.from_arrays(cols, [*names, *outs, *marks])

        for b in batches:
            if not b.num_rows:
                continue
            cols, n = [one_array(c) for c in b.columns], b.num_rows
            new = np.zeros(n, bool)
            for i in at:
                new |= changed(cols[i], None if before is None else before[i])
            head = before is None
            if head:
                types = [c.type for c in cols]
                yield mark("start", [c[0] for c in cols])
                new[0] = False
            begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: the key that was open before the batch
            onward = begin < 0
            open_ = (onward & first_key).astype(np.int32)
            if head:
                open_[0] = 2  # its row before lies in another partition
            got, has = [], []
            mask = pa.array(new)
            for i in lag_at:
                shifted = pa.concat_arrays([pa.array([None if head else before[i].as_py()], types[i]), cols[i][:-1]])
                got.append(pc.if_else(mask, pa.scalar(None, types[i]), shifted))
            for g, w in enumerate(groups):
                true = pc.fill_null(cols[flag_at[w]], False).to_numpy(zero_copy_only=False)
                latest = np.r_[-1, np.maximum.accumulate(np.where(true, np.arange(n), -1))[:-1]]
                inside = latest >= np.maximum(begin, 0)
                missing = ~inside & ~(onward & (carried[g] is not None))
                take = pa.array(np.where(inside, latest + 1, 0), mask=missing)
                for k, i in enumerate(value_at[w]):
                    source = pa.concat_arrays([pa.array([None if carried[g] is None else carried[g][k].as_py()], types[i]), cols[i]])
                    got.append(source.take(take))
                has.append(pa.array(~missing))
                if new.any():
                    carried[g] = None
                seen = np.flatnonzero(true)
                if len(seen) and seen[-1] >= max(begin[-1], 0):
                    carried[g] = [cols[i][int(seen[-1])] for i in value_at[w]]
            for k, (i, _, largest) in enumerate(amounts):
                x = pc.fill_null(cols[i].cast(pa.int64()), -1 if largest else 0).to_numpy(zero_copy_only=False)
                if largest:
                    lift = (begin + 2).astype(np.int64) << 41
                    upto = np.maximum.accumulate(np.r_[(1 << 41) + totals[k], x[:-1] + lift[:-1]])
                    values = np.where(upto >= lift, upto - lift, -1)
                    totals[k] = int(max(values[-1], x[-1]))
                else:
                    running = np.cumsum(x) - x
                    values = np.where(begin >= 0, running - running[np.maximum(begin, 0)], running + totals[k])
                    totals[k] = int(values[-1] + x[-1])
                got.append(pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([*cols, *got, pa.array(["row"] * n), pa.array(np.full(n, part), pa.int32()), pa.array(open_), *has], [*names, *outs, *marks])
            first_key = first_key and not new.any()
            before = [c[-1] for c in cols]
        if before is not None:
            yield mark("stop", before)

    rows = cut(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(run, schema))
    n_lags, n_lasts = len(lags), [len(vs) for vs in lasts.values()]
    chain_names = [*keys, *outs, *marks]
    kinds = {f.name: f.dataType for f in schema.fields}
    incoming_schema = type(schema)([type(schema.fields[0])("_p", kinds["_part"], True), *[type(schema.fields[0])(f"_in_{o}", kinds[o], True) for o in outs]])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = start = None
        for b in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                mine, values, kind, part, single, has = row[: len(keys)], list(row[len(keys) : len(keys) + len(outs)]), *row[len(keys) + len(outs) : len(keys) + len(outs) + 3], row[len(keys) + len(outs) + 3 :]
                if kind == "start":
                    start = mine
                    if state is not None and key == mine:
                        found.append((part, *state[0]))
                    continue
                if single and state is not None and key == start:  # one key alone: what came in goes on
                    old, had = state
                    k, has = n_lags, list(has)
                    for g, width in enumerate(n_lasts):
                        if not has[g]:
                            values[k : k + width], has[g] = old[k : k + width], had[g]
                        k += width
                    for j, (_, _, largest) in enumerate(amounts):
                        values[k + j] = max(values[k + j], old[k + j]) if largest else values[k + j] + old[k + j]
                key, state = mine, (values, has)
            types = [b.schema.field("_part").type, *[b.schema.field(o).type for o in outs]]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], ["_p", *[f"_in_{o}" for o in outs]])

    ends = rows.where("_kind <> 'row'").select(*chain_names).repartition(1).sortWithinPartitions("_part", "_kind")  # two rows a partition
    incoming = F.broadcast(ends.mapInArrow(chain, incoming_schema))  # at most a row a partition
    joined = rows.where("_kind = 'row'").join(incoming, (F.col("_part") == F.col("_p")) & (F.col("_open") > 0), "left")
    done = [F.when(F.col("_open") == 2, F.col(f"_in_prev_{v}")).otherwise(F.col(f"prev_{v}")).alias(f"prev_{v}") for v in lags]
    done += [F.when((F.col("_open") > 0) & ~F.col(f"_has{groups.index(w)}"), F.col(f"_in_last_{v}")).otherwise(F.col(f"last_{v}")).alias(f"last_{v}") for w, v in carried_of]
    for _, out, largest in amounts:
        other = F.coalesce(f"_in_{out}", F.lit(-1 if largest else 0))
        done.append((F.greatest(F.col(out), other) if largest else F.col(out) + other).cast("long").alias(out))
    return joined.select(*names, *done)


def ranged_lag(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``df`` with ``prev_<v>`` of the row before; see :func:`ranged_pass`."""
    return ranged_pass(df, keys, order, lags=values)


def ranged_sums(df: DataFrame, keys: list[str], order: list[str], amounts: dict[str, str]) -> DataFrame:
    """``df`` with, for each column and result of ``amounts``, the sum over the rows before; see :func:`ranged_pass`."""
    return ranged_pass(df, keys, order, sums=amounts)


def ranged_sum(df: DataFrame, keys: list[str], order: list[str], amount: str, out: str) -> DataFrame:
    """:func:`ranged_sums` of one column."""
    return ranged_pass(df, keys, order, sums={amount: out})


def ranged_max(df: DataFrame, keys: list[str], order: list[str], amount: str, out: str) -> DataFrame:
    """``df`` with the greatest ``amount`` (0 to 2 ** 40) of the rows before, -1 where there is none; see :func:`ranged_pass`."""
    return ranged_pass(df, keys, order, maxes={amount: out})


def ranged_last(df: DataFrame, keys: list[str], order: list[str], values: list[str], when: str) -> DataFrame:
    """``df`` with ``last_<v>`` of the latest row before at which ``when`` is true; see :func:`ranged_pass`."""
    return ranged_pass(df, keys, order, lasts={when: values})
