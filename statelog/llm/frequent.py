"""Most frequent items with bounds of their counts, in memory that doesn't grow with the number of distinct items.

A sketch has ROWS rows of WIDTH cells. An item falls into one cell of each row; a cell keeps the total count of its items, the
candidate of a majority vote among them and the surplus of that vote. Cells of two sketches merge by adding totals and
cancelling votes. An item's count lies between bounds that each of its cells gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelog.llm.baskets import items_of
from statelog.runtime import broadcast_if_small, cut

#: An item that holds a share s of the counts in a field is no candidate with a probability of at most (1 / (WIDTH s)) ** ROWS.
ROWS, WIDTH = 4, 4096
_CELLS = "field string, row int, cell int, total bigint, surplus bigint, candidate string, h bigint"
_NAMES = [c.split()[0] for c in _CELLS.split(", ")]
_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]


def _cells_np(h: np.ndarray, row: int, width: int) -> np.ndarray:
    """Cells of hashes in a row. Rows mix the bits anew, so items that share a cell in one row don't tend to in another."""
    z = h.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (row + 1) & 0xFFFFFFFFFFFFFFFF)
    for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(odd)
    return ((z ^ (z >> np.uint64(31))) % np.uint64(width)).astype(np.int64)


class _Sketch:
    """Cells of one field."""

    def __init__(self, rows: int, width: int):
        self.rows, self.width = rows, width
        self.total = np.zeros((rows, width), np.int64)
        self.surplus = np.zeros((rows, width), np.int64)
        self.h = np.zeros((rows, width), np.int64)
        self.candidate = np.full((rows, width), None, dtype=object)

    def add(self, h: np.ndarray, items: np.ndarray, weight: np.ndarray) -> None:
        """Count distinct items with their weights."""
        for r in range(self.rows):
            c = _cells_np(h, r, self.width)
            np.add.at(self.total[r], c, weight)
            order = np.argsort(c, kind="stable")
            sorted_c = c[order]
            first = np.r_[True, sorted_c[1:] != sorted_c[:-1]]
            start = np.maximum.accumulate(np.where(first, np.arange(len(c)), 0))
            turn = np.arange(len(c)) - start
            for t in range(int(turn.max()) + 1 if len(c) else 0):  # one item of each cell at a time
                i = order[turn == t]
                at, s, cand = c[i], self.surplus[r], self.h[r]
                same = (cand[at] == h[i]) & (s[at] > 0)
                left = np.where(same, s[at] + weight[i], s[at] - weight[i])
                new = left < 0
                s[at] = np.abs(left)
                cand[at[new]] = h[i[new]]
                self.candidate[r][at[new]] = items[i[new]]

    def batch(self, field: str) -> pa.RecordBatch:
        r, c = np.nonzero(self.total)
        cols = [pa.array([field] * len(r), pa.string()), pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(self.total[r, c]), pa.array(self.surplus[r, c]), pa.array(self.candidate[r, c], pa.string()), pa.array(self.h[r, c])]
        return pa.RecordBatch.from_arrays(cols, _NAMES)


def _sketch_split(rows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches: dict[str, _Sketch] = {}
        for b in batches:
            if not b.num_rows:
                continue
            for field, part in zip(*_by_field(b), strict=True):
                h, at, n = np.unique(part.column("h").to_numpy(zero_copy_only=False), return_index=True, return_counts=True)
                items = np.array(part.column("item").take(pa.array(at)).to_pylist(), dtype=object)
                sketches.setdefault(field, _Sketch(rows, width)).add(h, items, n.astype(np.int64))
        for field, s in sketches.items():
            yield s.batch(field)

    return run


def _by_field(b: pa.RecordBatch) -> tuple[list[str], list[pa.RecordBatch]]:
    d = b.column("field").dictionary_encode()
    codes = d.indices.to_numpy(zero_copy_only=False)
    names = d.dictionary.to_pylist()
    return names, [b.take(pa.array(np.flatnonzero(codes == k))) for k in range(len(names))]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge equal cells: totals add up, equal candidates add their surpluses, different ones cancel votes."""
    cells: dict[tuple, list] = {}
    for b in batches:
        for field, row, cell, total, surplus, candidate, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
            has = cells.get((field, row, cell))
            if has is None:
                cells[field, row, cell] = [total, surplus, candidate, h]
                continue
            has[0] += total
            if has[2] == candidate:
                has[1] += surplus
            elif surplus > has[1] or (surplus == has[1] and (candidate or "") < (has[2] or "")):
                has[1:] = [surplus - has[1], candidate, h]
            else:
                has[1] -= surplus
    if cells:
        rows = [(*k, *v) for k, v in cells.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], _KINDS[i]) for i in range(7)], _NAMES)


def sketch(items: DataFrame, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """Merged cells of ``items(field, item)``, at most ``rows * width`` a field. Null items don't count."""
    hashed = items.where("item is not null and field is not null").select("field", "item", F.xxhash64("item").alias("h"))
    return merge_sketches(hashed.mapInArrow(_sketch_split(rows, width), _CELLS))


def merge_sketches(cells: DataFrame) -> DataFrame:
    """Cells of several sketches of the same shape as those of one; sketches of separate loads are united first."""
    return cells.select(*_NAMES).repartition("field", "row", "cell").mapInArrow(_merge, _CELLS)


def bounds(items: DataFrame, cells: DataFrame, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """``(field, item, low, high, estimate)`` of distinct ``items(field, item, h)``: their true counts lie in [low, high].

    A cell with total V whose vote has the surplus C gives at most (V + C) / 2 to its candidate and (V - C) / 2 to any other item.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False).astype(np.int64)
            for r in range(rows):
                yield pa.RecordBatch.from_arrays([b.column("field"), b.column("item"), pa.array(np.full(len(h), r), pa.int32()), pa.array(_cells_np(h, r, width).astype(np.int32))], ["field", "item", "row", "cell"])

    at = items.select("field", "item", "h").mapInArrow(places, "field string, item string, row int, cell int")
    j = at.join(cells, ["field", "row", "cell"])
    own = F.col("candidate") == F.col("item")
    high = F.when(own, F.expr("(total + surplus) div 2")).otherwise(F.expr("(total - surplus) div 2"))
    low = F.when(own, F.col("surplus")).otherwise(0)
    out = j.groupBy("field", "item").agg(F.max(low).alias("low"), F.min(high).alias("high"))
    return out.withColumn("estimate", F.expr("(low + high) div 2"))


def _candidates(cells: DataFrame) -> DataFrame:
    return cells.where("surplus > 0").select("field", F.col("candidate").alias("item"), "h").distinct()


def frequent_items(cells: DataFrame, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """:func:`bounds` of each candidate of a merged sketch."""
    return bounds(_candidates(cells), cells, rows, width)


def unseen_items(items: DataFrame, cells: DataFrame, least: float, rows: int = ROWS, width: int = WIDTH) -> DataFrame | None:
    """``(field, item, h)`` of items that may have a count of ``least`` though they are no candidates; None if there can't be any.

    Such an item needs, in every row, a cell with room for it beside the candidate: (V - C) / 2 >= ``least``. A row has fewer of those
    cells than items could reach ``least``, and hardly any item lies in one in every row; those that do are looked up in the data.
    """
    roomy: dict[str, list[set[int]]] = {}
    for r in cells.where(F.expr("(total - surplus) / 2") >= least).select("field", "row", "cell").collect():
        roomy.setdefault(r["field"], [set() for _ in range(rows)])[r["row"]].add(r["cell"])
    lists = {f: [np.array(sorted(c)) for c in by_row] for f, by_row in roomy.items() if all(by_row)}
    if not lists:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for field, part in zip(*_by_field(b), strict=True):
                h = part.column("h").to_numpy(zero_copy_only=False).astype(np.int64)
                keep = np.ones(len(h), bool)
                for r, listed in enumerate(lists[field]):
                    keep &= np.isin(_cells_np(h, r, width), listed)
                yield part.filter(pa.array(keep))

    hashed = items.where(F.col("field").isin(*lists)).where("item is not null").select("field", "item", F.xxhash64("item").alias("h"))
    return hashed.mapInArrow(run, "field string, item string, h bigint").distinct()


def items_with_share(baskets: DataFrame, fields: list[str], share: float, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """``(field, item, low, high, estimate, n)`` of items that at least ``share`` of the baskets hold, n counted exactly.

    Candidates come from the sketch, with those few items that could hide behind them; what has an upper bound of the share is
    counted in a second pass over the baskets. None is missed.
    """
    baskets = cut(baskets.select(*fields))
    n = baskets.count()
    items = items_of(baskets, [], fields)
    cells = cut(sketch(items, rows, width))
    named = _candidates(cells)
    hidden = unseen_items(items, cells, share * n, rows, width)
    if hidden is not None:
        named = named.unionByName(hidden).distinct()
    likely = cut(bounds(named, cells, rows, width).where(F.col("high") >= share * n))
    exact = items.join(broadcast_if_small(likely.select("field", "item")), ["field", "item"], "left_semi").groupBy("field", "item").agg(F.count("*").alias("n"))
    return likely.join(exact, ["field", "item"]).where(F.col("n") >= share * n)
